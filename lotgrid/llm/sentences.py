"""Sentence boundaries across languages and scripts, as code-point offsets.

A document is cut into blocks at blank lines; a block whose line breaks all look like those of a
filled paragraph is one run of text, otherwise every line stands by itself. A pushdown automaton walks
over list marks, terminators, quotes and brackets only, with one stack for all of them: list levels at the
bottom, open quotes and brackets above. A terminator ends a sentence when nothing but list levels is on the
stack and neither an abbreviation (found in tries read backwards), a number nor the following text speaks
against it. Its word lists are closed classes of the languages: abbreviations, function words, months.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Abbreviations after which the sentence goes on.
INNER = (
    "Mr Mrs Ms Dr Prof Rev Hon Gen Capt Sgt Lt Sen Rep Gov Messrs No Nos Fig Figs Sec Secs Ch Art Vol pp p cf e.g i.e viz vs v approx rec "
    "Rm Apt Ste Mt Ft Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec Mon Tue Tues Wed Thu Thur Thurs Fri Sat Sun U.S U.K "
    "Sra Srta Dra Sr Av Avda aprox núm núms pág págs art Ud Uds MM Mme Mlle env chap "
    "Nr Abs z.B d.h u.a bzw ca inkl exkl Hr Fr Str Tel Mio Mrd z d u "
    "ул г д п стр см См т т.е т.к т.д кв им руб тыс млн "
    "κ κα κ.κ π.χ π δηλ αρ σελ "
    "डॉ श्री सुश्री प्रो "
    "د أ م "
).split()
#: Abbreviations that may also end a sentence, by what they stand for.
STREETS = "St Ave Blvd Rd Ln Hwy Ctr Pkwy Sq Pl Ct Dr".split()
FIRMS = "Dept Assn Assoc Bros Co Corp Inc Ltd Jr Sr Esq Cía Ltda S.A".split()
OTHERS = "Dist etc est al sq ft mi in lb min max avg Ph.D M.D B.A cont usw ff dgl ú".split()
#: Legal forms that may follow an abbreviated one.
FORMS = set("LLC LLP LP PLC KG KGaA AG GmbH SE SA Ltd Inc Co Corp".split())
#: What a place is that is named after a street.
PLACES = set("Garage Parking Lot Deck Plaza Church Station School Bridge Hall Tower Mall Market Park Building".split())
#: Function words (articles, pronouns, prepositions, conjunctions, question words, auxiliaries).
OPENERS = set(
    "The A An It Its In On At Our We They Each Every Neither Either Nobody No None One Two Is Are Was Were Why What When Where Who How Which Whose "
    "He She I This That These Those There Here Their His Her My Your You If But And Or So Yet For From By To After Before As All Any Some Many Most Both "
    "Such Then Now Also However Do Does Did Has Have Had Can Could Will Would Should May Might Must Not Only Since While Until Once Although Because "
    "Of With Without During Over Under Between Per Via Everyone Someone Something Nothing See Cf Mr Mrs Ms Dr "
    "La El Los Las Un Una Según Nadie Le Les Il Elle On Une Quel Quelle Pourquoi Die Der Das Ein Eine Warum Am".split()
)
#: Of these, those that no sentence has after a time of day (6 p.m. the gate).
STARTERS = set("the a an our their his her its each every neither nearly one".split())
#: Month names after German ordinals.
MONTHS = set("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‹": "›"}
CLOSE = set(OPEN.values())
CLOSERS = CLOSE | {'"', "'", "’", "”", "“", "»", "›"}
WIDE_STOPS = "。！？｡"
STOPS = ".!?…‼⁇⁈⁉؟۔।॥" + WIDE_STOPS
#: Thai particles that close a sentence before a blank.
THAI_ENDS = ("ครับ", "ค่ะ", "คะ", "นะ", "จ้ะ", "จ้า", "จ๊ะ", "ฮะ")

#: Characters by which careless edits after filling may have shortened a line.
SLACK = 3
LINE = regex.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
SPACE = r"[\s​﻿]"
MARK = regex.compile(r"\s*(?:[-*•·‣▪◦#+]+|\(?\d{1,3}[.)]|\(?[A-Za-z]\)|\(?[ivxIVX]{1,4}\)|\[[ xX]\])\s+")
EVENT = regex.compile(r"[" + regex.escape(STOPS) + r"]+|[;;]|[" + regex.escape("".join(sorted(set(OPEN) | CLOSE | {'"'}))) + r"]|(?<=[฀-๿])[ \t ]+|[\n\r]+")
WORDLIKE = regex.compile(r"[\p{L}\p{N}]")
NEXT = regex.compile(SPACE + r"*")
TOKEN = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’\-]*")
INITIAL = regex.compile(r"\p{Lu}\.(?:" + SPACE + r"|-)")
#: A capitalised word with a number, or a code, as in Table 4 or AB-12.
NUMBERED = regex.compile(r"\p{Lu}\p{Ll}+\.?\s+\d|\p{Lu}{2,}-\d")
#: What follows a word that is no name: another in lower case, or a number.
GOES_ON = regex.compile(r",?\s+[\p{Ll}\d]")
BEFORE_ST = regex.compile(r"([\p{L}\p{M}'’.\-]+)\s+St$")
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}.]+$")


def _trie(words: list[str]) -> dict:
    """Abbreviations read from their last letter to their first."""
    root: dict = {}
    for word in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = True
    return root


INNER_TRIE, STREET_TRIE, FIRM_TRIE, OTHER_TRIE = _trie([*INNER, "mr", "mrs", "dr", "fig"]), _trie(STREETS), _trie(FIRMS), _trie(OTHERS)


def _ends_in(trie: dict, text: str, stop: int, low: int) -> bool:
    """Whether a whole word of the trie ends just before ``stop``."""
    node, i = trie, stop - 1
    while i >= low:
        c = text[i]
        node = node.get(c)
        if node is None:
            return False
        i -= 1
        if "" in node and (i < low or not (text[i].isalnum() or text[i] == ".") or text[i] == "." and text[i + 1 : i + 3].istitle() and text[i - 1 : i].islower()):
            return True
    return False


def _pairs(text: str, events: list) -> dict[int, int]:
    """Matched openers and closers of a run: the place of the opener to that of its closer.

    One stack holds every open quote and bracket. A closer takes the nearest opener that it closes, and
    what had been opened inside and never closed is given up; a closer that closes nothing is a mark like
    any other. Openers left on the stack at the end are none.
    """
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}  # how many openers on the stack wait for each closer
    found = {}

    def close(mark: str, at: int) -> None:
        while stack:
            kind, place = stack.pop()
            held[kind] -= 1
            if kind == mark:
                found[place] = at
                return

    for m in events:
        i = m.start()
        c = text[i]
        if c == '"':
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < len(text) else " "
            if held.get(c) and not before.isspace():
                close(c, i)
            elif not after.isspace() and not held.get(c):
                stack.append((c, i))
                held[c] = held.get(c, 0) + 1
        elif held.get(c):
            close(c, i)
        elif c in OPEN:
            stack.append((OPEN[c], i))
            held[OPEN[c]] = held.get(OPEN[c], 0) + 1
    return found


def _opens(text: str, i: int) -> bool:
    """Whether the text at i can only begin a sentence, even after an abbreviation or an initial."""
    if i >= len(text) or text[i] in "¿¡«„“\"「":
        return True
    if text[i] in "(（":
        return i + 1 < len(text) and (text[i + 1].isupper() or text[i + 1] in "¿¡«„“\"")
    m = TOKEN.match(text, i)
    if not m:
        return False
    word = m.group()
    if len(word) == 1 and text[m.end() : m.end() + 1] == ".":
        return False
    if word in OPENERS or word.split("'")[0].split("’")[0] in OPENERS and "'" in word:
        return True
    return bool(NUMBERED.match(text, i))


def _abbreviated(text: str, i: int, low: int, after: int) -> bool | None:
    """Whether a sentence ends with the abbreviation before the period at i; None where there is none.

    After a firm any capitalised word begins a sentence unless it is a legal form. After a street a word
    does that is no kind of place and goes on in lower case; before a saint's name none does.
    """
    follow = text[after]
    if _ends_in(INNER_TRIE, text, i, low):
        word = LAST_WORD.search(text, max(low, i - 12), i)
        return word is not None and word.group() in ("U.S", "U.K", "руб", "г", "rec") and follow.isupper() and _opens(text, after)
    tail = text[max(low, i - 3) : i]
    if _ends_in(OTHER_TRIE, text, i, low):
        if follow.islower() or follow.isdigit():
            return tail == "min" and follow.islower() and not text[i + 1 : i + 2].isdigit() and TOKEN.match(text, after).group() in STARTERS
        return tail in ("min", "est", " ft", "sq.") and follow not in "(（" or _opens(text, after)
    street, firm = _ends_in(STREET_TRIE, text, i, low), _ends_in(FIRM_TRIE, text, i, low)
    if not street and not firm:
        return None
    if follow.islower() or follow.isdigit():
        return False
    if _opens(text, after):
        return not (street and tail.strip().endswith("St") and _saint(text, i, low) and follow not in "(（")
    m = TOKEN.match(text, after)
    if m is None or not follow.isupper():
        return False
    word = m.group()
    if firm:
        return word not in FORMS
    if word in PLACES or tail.strip().endswith("St") and _saint(text, i, low):
        return False
    return INITIAL.match(text, after) is not None or bool(GOES_ON.match(text, m.end()))


def _saint(text: str, i: int, low: int) -> bool:
    """Whether the St before the period at i stands before a name and not after one."""
    m = BEFORE_ST.search(text, max(low, i - 40), i)
    return m is None or not m.group(1)[0].isupper() or m.start() == low


def _period(text: str, i: int, low: int, after: int, spaced: bool) -> bool:
    """Whether a single period at i, before the text at ``after``, ends a sentence."""
    before = text[i - 1] if i > low else " "
    follow = text[after] if after < len(text) else ""
    if before.isspace() or not follow:
        return not before.isspace()
    if not spaced:
        upper = follow.isupper() and after + 1 < len(text) and (text[after + 1].islower() or text[after + 1].isspace())
        if not upper or not (before.isalnum() or before in ')"%'):
            return False
    if follow in ",;:)]-–—/+=<>|&*%":
        return False
    if follow.islower() and before.isalpha() and (i - 2 < low or not text[i - 2].isalnum()):
        return False
    if before.isupper() and (i - 2 < low or not text[i - 2].isalnum()):  # an initial, or a letter that names something
        return _opens(text, after) and not (i - 2 >= low and text[i - 2] == ".") and TOKEN.match(text, after) is not None
    short = _abbreviated(text, i, low, after)
    if short is not None:
        return short
    word = LAST_WORD.search(text, max(low, i - 12), i)
    if word is not None and word.group().lower().replace(" ", "") in ("a.m", "p.m"):
        m = TOKEN.match(text, after)
        return not (follow.islower() or follow.isdigit()) or m is not None and m.group() in STARTERS
    if before.isdigit():
        m = TOKEN.match(text, after)
        if m is not None and m.group() in MONTHS:
            return False
        if follow.isdigit() and not spaced:
            return False
    if before == "m" and regex.search(r"\b[ap]\.\s?m$", text[max(low, i - 5) : i]):
        return not follow.islower()
    return True


def _run(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Sentences of one run of text, as spans without outer white space."""
    part = text[low:high]
    events = list(EVENT.finditer(part))
    pairs = _pairs(part, events)
    cuts, shut = [], -1
    for k, m in enumerate(events):
        i, j = m.start(), m.end()
        c = part[i]
        if i <= shut:
            if i == shut and c not in ")]}）］】" or i < shut:
                pass
            if i < shut:
                continue
        if i in pairs:
            shut = max(shut, pairs[i])
            continue
        if c in "\n\r":
            if part[max(0, i - 8) : i].rstrip().endswith(THAI_ENDS):
                cuts.append(j)
            continue
        if c in " \t ":
            if part[max(0, i - 8) : i].endswith(THAI_ENDS):
                cuts.append(j)
            continue
        closing = i == shut
        if closing:  # a quotation or bracket ends here: did a sentence end inside it, just before?
            p = i - 1
            while p > 0 and (part[p] in CLOSERS or part[p].isspace()):
                p -= 1
            if part[p] not in STOPS or j < len(part) and part[j] in STOPS + ",;:" + ";":
                continue
            stop, spaced_quote = part[p], True
        elif c in STOPS:
            stop, spaced_quote = part[j - 1], False
            while j < len(part) and part[j] in CLOSERS and part[j] not in '"' and not (j in pairs):
                j += 1
            if j < len(part) and part[j] == '"' and j not in pairs and j not in pairs.values():
                j += 1
        elif c in ";;":
            if c == ";" or i and regex.match(r"[\p{Greek}\d]", part[i - 1]) and (j == len(part) or part[j].isspace()):
                after = NEXT.match(part, j).end()
                if after >= len(part) or not part[after].islower():
                    cuts.append(j)
            continue
        else:
            continue
        after = NEXT.match(part, j).end()
        spaced = after > j
        follow = part[after] if after < len(part) else ""
        if not follow:
            continue
        if closing:
            if stop in WIDE_STOPS or not (follow.isupper() or follow.isdigit() or follow in "¿¡«„“\"(（「"):
                continue
            if not spaced and not follow.isupper():
                continue
            if part[i] in ")）]" and stop == "." and not (part[p] in "!?" or _period(part, p, 0, after, True)):
                continue
            if part[i] in ")）]" and not _bracket_stands_alone(part, pairs, i):
                continue
            cuts.append(j)
            continue
        if all(x in WIDE_STOPS for x in part[i:j]) or stop in WIDE_STOPS:
            cuts.append(j)
        elif part[i:j] == "." or part[i] == "." and part[j - 1] in CLOSERS:
            if _period(part, i, 0, after, spaced):
                cuts.append(j)
        elif stop == "…" or part[i:j].strip("".join(CLOSERS)) in ("..", "...", "....") or set(part[i:j]) == {"…"}:
            if (spaced and not follow.islower() and follow not in ",;:") or (not spaced and follow.isupper()):
                if not ("⺀" <= follow <= "鿿"):
                    cuts.append(j)
        elif stop in "।॥۔؟":
            cuts.append(j)
        elif spaced or follow.isupper() or follow in "¿¡«„“\"(":
            if follow not in ",;:" and not (follow in "—–" and spaced):
                cuts.append(j)
    out, begin = [], 0
    for cut in [*cuts, len(part)]:
        a, b = begin, cut
        begin = cut
        while a < b and (part[a].isspace() or part[a] in "​﻿"):
            a += 1
        while b > a and (part[b - 1].isspace() or part[b - 1] in "​﻿"):
            b -= 1
        if a < b and WORDLIKE.search(part, a, b):
            out.append((low + a, low + b))
    return out


def _bracket_stands_alone(part: str, pairs: dict[int, int], end: int) -> bool:
    """Whether the bracket that closes at ``end`` began where a sentence could begin."""
    start = next((a for a, b in pairs.items() if b == end), -1)
    p = start - 1
    while p >= 0 and (part[p].isspace() or part[p] in CLOSERS):
        p -= 1
    return p < 0 or part[p] in STOPS


def _line_spans(text: str) -> Iterator[list[tuple[int, int]]]:
    """Blocks of lines: the spans of the lines between blank lines."""
    block, at = [], 0
    for m in [*LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        if text[at:end].strip(" \t ​﻿　"):
            block.append((at, end))
        elif block:
            yield block
            block = []
        at = m.end() if m else end
    if block:
        yield block


def _filled(text: str, block: list[tuple[int, int]], min_wrap: int) -> bool:
    """Whether the line breaks could not have come later in a paragraph filled to one width (a third may be edited)."""
    lines = [" ".join(text[a:b].split()) for a, b in block]
    width = max(min_wrap, *map(len, lines)) - SLACK
    early = sum(len(x) + 1 + len(y.split(" ", 1)[0]) <= width for x, y in zip(lines, lines[1:]))
    return early <= (len(lines) - 1) // 3


def sentences(text: str | None, min_wrap: int = 60) -> list[tuple[int, int]]:
    """Start and end (exclusive) of every sentence unit of a text, in code points.

    Null, empty and symbol-only texts have none. Lines that carry a list or heading mark, and lines
    of blocks that are not filled paragraphs, are units of their own (unmarked lines may hold several
    sentences). ``min_wrap`` is the narrowest column that counts as a filled paragraph.
    """
    if not text:
        return []
    blocks = list(_line_spans(text))
    many = [b for b in blocks if len(b) > 1]
    filled = {b[0][0]: _filled(text, b, min_wrap) and not MARK.match(text, b[0][0], b[0][1]) for b in many}
    loose = any(not filled[b[0][0]] for b in many)
    out: list[tuple[int, int]] = []
    for block in blocks:
        if len(block) > 1 and filled[block[0][0]] and not (len(block) == 2 and loose):
            out.extend(_run(text, block[0][0], block[-1][1]))
            continue
        levels: list[int] = []  # the bottom of the stack: columns at which open list entries have their marks
        entry = -1  # the unit of the innermost open entry
        for a, b in block:
            lead = len(text[a:b]) - len(text[a:b].lstrip())
            marked = MARK.match(text, a, b)
            while levels and lead < levels[-1] + (0 if marked else 1):
                levels.pop()
                entry = -1
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
            if not marked and levels and entry >= 0:  # indented under an open entry: its text goes on
                out[entry] = (out[entry][0], b)
                continue
            if marked:
                if not levels or lead > levels[-1]:
                    levels.append(lead)
                entry = -1
                if WORDLIKE.search(text, a, b):
                    entry = len(out)
                    out.append((a, b))
                continue
            found = _run(text, a, b)
            out.extend([(a, b)] if len(found) == 1 else found)  # one unit: the line stands by itself, with what trails it
    return out


def split_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_no (from 1), start_char, end_char of every sentence unit of every document.

    One pass over Arrow batches without a shuffle; whole texts whatever their length; further columns
    are ignored. Documents without a unit give no row; repeated documents give their rows again.
    """
    plain = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([plain.schema["doc_id"], *[T.StructField(c, T.IntegerType()) for c in ("sent_no", "start_char", "end_char")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                rows, number, start, end = [], [], [], []
                for r, text in enumerate(piece.column(1).to_pylist()):
                    for n, (a, b) in enumerate(sentences(text), 1):
                        rows.append(r)
                        number.append(n)
                        start.append(a)
                        end.append(b)
                ids = piece.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int32()) for x in (number, start, end))], ["doc_id", "sent_no", "start_char", "end_char"])

    return plain.where("text is not null").mapInArrow(run, schema)
