"""Variant spellings of owner names: canonical tokens, a sharded trie join for typing errors, and unique completions."""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.operators.skew import MOST, heavy_keys, salted_join
from lotgrid.session import cut, discard

#: Given names and the short forms that stand for them.
GIVEN = {
    "ABIGAIL": "ABBY ABI GAIL ABBIE", "ANTHONY": "TONY ANT ANTH ANTO", "BARBARA": "BARB BARBIE BABS", "BENJAMIN": "BEN BENNY BENJ BENJI",
    "CHARLES": "CHAS CHUCK CHARLIE CHARLEY", "CYNTHIA": "CINDY CYN CYNTH CINDI", "DANIEL": "DAN DANNY DANL", "DEBORAH": "DEB DEBBIE DEBBY DEBRA",
    "DOROTHY": "DOT DOTTIE DOLLY DOTTY DORTHY", "EDWARD": "ED EDDIE EDWD NED EDDY TED TEDDY", "ELIZABETH": "LIZ BETTY ELIZ LIZZIE ELIZA", "FRANCES": "FRAN FRANCIE FRANNIE",
    "FREDERICK": "FRED FREDDY FREDK FREDDIE FREDRICK", "GERALD": "GERRY JERRY GERLD", "GREGORY": "GREG GREGG GREGY", "JAMES": "JIM JIMMY JAS JAMIE",
    "JOSEPH": "JOE JOEY JOS", "JUDITH": "JUDY JUDE JUDI", "KATHERINE": "KATE KATHY KATH KATIE KATHERN", "KENNETH": "KEN KENNY KENN", "LAWRENCE": "LARRY LARS LAWR",
    "LEONARD": "LEN LENNY LEON", "MARGARET": "MAGGIE PEGGY MARGT MEG MARGE", "MICHAEL": "MIKE MICK MICHL MIKEY", "NICHOLAS": "NICK NICHS NICKY NICH", "PAMELA": "PAM PAMMY PAMLA",
    "PATRICIA": "PAT PATTY TRISH PATTI TRICIA", "RAYMOND": "RAY RAYM RAYMD", "REBECCA": "BECKY BECCA REBA", "RICHARD": "DICK RICK RICHD RICH RICKY", "ROBERT": "BOB ROB ROBT BOBBY BERT",
    "SAMUEL": "SAM SAMMY SAML", "SANDRA": "SANDY SANDI SANDIE", "STEPHEN": "STEVE STEPH STEVIE", "SUSAN": "SUE SUSIE SUZY SUSY SUZIE", "THEODORE": "THEO TED TEDDY THEOD",
    "THOMAS": "TOM TOMMY THOS", "TIMOTHY": "TIM TIMMY TIMO", "VICTORIA": "VICKY VICKI TORI VIKKI", "VIRGINIA": "GINNY GINA VIRG", "WALTER": "WALT WALLY WALTR", "WILLIAM": "BILL WM WILL BILLY WILLIE",
}
#: Words of firm names and their abbreviations.
FIRM = {
    "ASSOCIATES": "ASSOC ASSOCS ASSC ASSOCIATE", "BROTHERS": "BROS BRO", "CONSTRUCTION": "CONST CNSTR CONSTR CONSTRUCT", "DEVELOPMENT": "DEV DEVEL DVLPMT DEVELOPMNT DEVT", "ENTERPRISES": "ENT ENTPR ENTERPR ENTERPRISE ENTS",
    "HOLDINGS": "HLDG HLDGS HOLDNGS HOLDING", "INVESTMENTS": "INV INVS INVEST INVSTMTS INVESTMENT INVESTS", "MANAGEMENT": "MGMT MGT MNGMT MGMNT", "PARTNERS": "PTRS PTNRS PARTNRS PTNR", "PROPERTIES": "PROP PROPS PPTYS PROPERTY PPTY",
    "REALTY": "RLTY RLTY", "WAREHOUSE": "WHSE WRHS WAREHSE WHS", "CENTER": "CTR CENTRE CNTR", "CROSSING": "XING CRSSNG CRSG", "RIDGE": "RDG", "RIVER": "RVR RIV", "SQUARE": "SQ SQR", "STREET": "ST STR", "VALLEY": "VLY VAL", "NORTH": "N NO NRTH", "MILL": "ML", "GATE": "GT",
}
#: Legal forms.
LEGAL = {"LLC": "LLC", "LP": "LP", "LTD": "LTD LIMITED", "INC": "INC INCORPORATED", "CORP": "CORP CORPORATION", "CO": "CO COMPANY"}
#: Words for "no owner known".
NOBODY = {"UNKNOWN", "OWNER UNKNOWN", "UNKNOWN OWNER", "N A", "NA", "NONE", "NULL", "SEE FILE", "SEE RECORD", "NOT AVAILABLE", "NOT KNOWN", "UNK", "TBD", "OWNER", "NO OWNER", "VARIOUS", "NAN", "PENDING", "X", "XX", "XXX"}
GENERATION = {"JR": "JR", "SR": "SR", "II": "II", "III": "III", "IV": "IV", "2ND": "II", "3RD": "III"}

NAME_OF: dict[str, tuple[str, ...]] = {}
for _full, _short in GIVEN.items():
    for _s in (_full, *_short.split()):
        NAME_OF[_s] = (*NAME_OF.get(_s, ()), _full)
FIRM_OF = {s: full for full, short in FIRM.items() for s in (full, *short.split())}
LEGAL_OF = {s: full for full, short in LEGAL.items() for s in short.split()}
PLACES = {"CENTER", "CROSSING", "RIDGE", "RIVER", "SQUARE", "STREET", "VALLEY", "NORTH", "MILL", "GATE"}
#: Words between which no typing error is assumed: they are all meant as they stand.
KNOWN = set(FIRM) | set(GIVEN) | set(LEGAL) | set(GENERATION) | {"CITY", "VILLAGE", "TOWNSHIP", "SCHOOLS", "COUNTY", "STATE", "PORT", "AUTHORITY"}

_REWRITES = [
    (re.compile(p), by)
    for p, by in (
        (r"\bC/O\b.*|\bATTN\b.*|%.*", " "), (r"[+]|\bAND\b", " & "), (r"['’`.]", ""), (r"\(([^()]*)\)", r" \1 "), (r"[^A-Z0-9&, ]+", " "), (r"\bL L C\b", "LLC"), (r"\bL L P\b", "LLP"), (r"\bL P\b", "LP"), (r"\bB O E\b", "BOARD OF EDUCATION"),
        (r"\bLTD LIABILITY (?:CO|COMPANY)\b|\bLIMITED LIABILITY (?:CO|COMPANY)\b", "LLC"), (r"\b(?:LTD|LIMITED) PARTNERSHIP\b", "LP"), (r"^C OF\b", "CITY OF"), (r"\b(?:VILL|VLG|VIL)\b", "VILLAGE"), (r"\b(?:TWP|TWNSHP|TWNSP|TOWNSHP)\b", "TOWNSHIP"),
        (r"\bBD\b", "BOARD"), (r"\bOF (?:ED|EDUC)\b", "OF EDUCATION"), (r"\b(?:SCHLS|SCHL|SCHS|SCH|SCHOOL)\b", "SCHOOLS"), (r"\b(?:TRS|TRUSTEE|TRSTEES)\b", "TRUSTEES"),
    )
]
#: Words of public bodies that an automaton looks for beside OF.
ROLES = ("CITY", "VILLAGE", "TOWNSHIP", "COUNTY")
_ROLE_AT = (re.compile(r"^(?:THE )?([A-Z]{3,})(?= OF\b)"), re.compile(r"(?<=, )([A-Z]{3,})(?= OF$)"))
_PUBLIC = re.compile(r"\b(?:CITY|VILLAGE|TOWNSHIP|SCHOOLS|BOARD OF EDUCATION|COUNTY OF|COUNTY|STATE OF|AUTHORITY|TRUSTEES)\b")


def neighbours(root: dict, word: str, bound: int = 1) -> list[str]:
    """Words of a trie within ``bound`` edits (a swap of neighbours is one) of a word.

    The automaton's state is a row of the edit table, advanced letter by letter along the trie and
    dropped as soon as every cell exceeds the bound.
    """
    n = len(word)
    found = []
    stack = [(root, None, "", None, list(range(n + 1)), "")]
    while stack:
        node, _, last, before, row, path = stack.pop()
        for c, child in node.items():
            if c == "":
                if row[n] <= bound:
                    found.append(child)
                continue
            new = [row[0] + 1]
            low = new[0]
            for j in range(1, n + 1):
                v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                    v = min(v, before[j - 2] + 1)
                new.append(v)
                low = v if v < low else low
            if low <= bound:
                stack.append((child, None, c, row, new, path))
    return found


def _insert(root: dict, word: str) -> None:
    node = root
    for c in word:
        node = node.setdefault(c, {})
    node[""] = word


_ROLE_TRIE: dict = {}
for _w in ROLES:
    _insert(_ROLE_TRIE, _w)


def parse(text: str | None) -> tuple[str, str, str, str, str, str, str] | None:
    """kind, key (canonical tokens in order), core, part, extra, surname and first of one owner text; None for nobody.

    Persons: core is surname and given names, part the middle initial, extra the generation.
    Firms: core is every word but the legal form, part the legal form. Public bodies: core is all.
    Word order, case, punctuation, short forms, "the", "of" and care-of notes make no difference.
    """
    if text is None:
        return None
    s = unicodedata.normalize("NFKC", text).upper()
    for pattern, by in _REWRITES:
        s = pattern.sub(by, " ".join(s.split()))
    s = " ".join(s.replace(",", " , ").split()).strip(" ,&")
    for at in _ROLE_AT:
        m = at.search(s)
        if m and m.group(1) not in ROLES and (meant := neighbours(_ROLE_TRIE, m.group(1))):
            s = f"{s[: m.start(1)]}{meant[0]}{s[m.end(1) :]}"
    bare = s.replace(",", " ").split()
    if not bare or " ".join(bare) in NOBODY or not any(c.isalpha() for c in s):
        return None
    words = [w for w in bare if w not in ("THE", "OF", "&")]
    if not words:
        return None
    if _PUBLIC.search(s) and not any(w in LEGAL_OF for w in words):
        body = [w for w in words if w not in ("TRUSTEES", "BOARD", "EDUCATION")]
        if "EDUCATION" in words or "SCHOOLS" in words:
            body = [w for w in body if w != "SCHOOLS"] + ["SCHOOLS"]
        if "TRUSTEES" in words and "TOWNSHIP" not in body:
            body.append("TOWNSHIP")
        key = " ".join(sorted(body))
        return "public", key, key, "", "", "", ""
    legal = LEGAL_OF.get(words[-1]) if len(words) > 1 else None
    if legal and len(words) > 3 and LEGAL_OF.get(words[-2]) == "CO":  # "realty co ltd" is "realty ltd"
        words = [*words[:-2], words[-1]]
    if legal is None and "," in s and len(words) > 1 and words[0] in LEGAL_OF:
        legal = LEGAL_OF[words[0]]
    firm_words = [w for w in words[1:] if w in FIRM_OF and len(w) > 1 and FIRM_OF[w] not in PLACES]
    firm_words += [w for w in words[:1] if w in FIRM_OF and FIRM_OF[w] not in PLACES and len(words) > 2 and w == FIRM_OF[w]]
    if legal or (firm_words and "&" not in s and not any(w in NAME_OF for w in words if w not in FIRM_OF)):
        rest = [w for w in words if LEGAL_OF.get(w) is None or w != words[-1] or legal is None]
        if legal is not None and words[-1] not in LEGAL_OF:
            rest = words[1:]
        canon = sorted(GENERATION.get(w) or (FIRM_OF.get(w, w) if i else w if w not in FIRM else w) for i, w in enumerate(rest))
        core = " ".join(canon)
        return "firm", f"{core} {legal or ''}".strip(), core, legal or "", "", "", ""
    people = [x.split() for x in s.replace(",", " , ").split("&")]
    flat = [w for w in words]
    generation = next((GENERATION[w] for w in reversed(flat) if w in GENERATION and len(flat) > 1), "")
    people = [[w for w in p if w not in GENERATION] for p in people]
    if len(people) > 1:
        tokens = [w for p in people for w in p if w != ","]
        given = [w for w in tokens if w in NAME_OF]
        other = [w for w in tokens if w not in NAME_OF]
        names = [w for w in other if len(w) > 1]
        canon = sorted([NAME_OF[w][0] if len(NAME_OF[w]) == 1 else "?" + w for w in given] + names)
        core = " ".join(canon)
        return "joint", f"{core} {generation}".strip(), core, "", generation, "", ""
    p = people[0]
    comma = p.index(",") if "," in p else -1
    p = [w for w in p if w != ","]
    if not p:
        return None
    if len(p) == 1:
        return "person", " ".join(x for x in (p[0], generation) if x), p[0], "", generation, p[0], ""
    if comma == 1 or (len(p[0]) > 1 and p[0] not in NAME_OF) or (p[0] in NAME_OF and p[1] in NAME_OF and len(p[-1]) == 1):
        surname, given = p[0], p[1:]
    elif p[0] in NAME_OF or len(p[0]) == 1:
        surname, given = p[-1], p[:-1]
    else:
        surname, given = p[0], p[1:]
    if given[0] not in NAME_OF and len(p) > 2 and p[-1] not in NAME_OF and len(p[-1]) > 1 and any(len(w) == 1 for w in p[1:-1]) and comma < 0:
        surname, given = p[-1], p[:-1]  # FRIST M SURNAME, the first name mistyped
    first = given[0]
    full = NAME_OF.get(first, (first,))
    first = full[0] if len(full) == 1 else "?" + first
    middle = given[1][0] if len(given) > 1 else ""
    core = " ".join(sorted([surname, first]))
    return "person", " ".join(x for x in (core, middle, generation) if x), core, middle, generation, surname, first


def trie_join(keys: DataFrame, bound: int = 1, least: int = 4, hot_rows: int = 20_000) -> DataFrame:
    """key_a, key_b (a < b): canonical keys that agree in all tokens but one, and there up to ``bound`` edits.

    keys: kind, key. Each key is sharded once per token of at least ``least`` letters: the shard is
    the kind with its other tokens (so word order never matters) and, since one edit leaves the
    first two or the last two letters of a longer token alone, those letters. Each shard's tokens
    form a trie; every token walks it as an automaton. A shard of over ``hot_rows`` rows is cut into
    chunks of about that many: each row enters one chunk's trie, and the others stream past it, so a
    task holds one chunk and never the shard.
    """
    token = F.explode(F.array_distinct(F.split("key", " ")))
    rest = F.array_join(F.array_sort(F.array_except(F.split("key", " "), F.array("token"))), " ")
    shards = keys.select("kind", "key", token.alias("token")).where((F.length("token") >= least) & ~F.col("token").startswith("?"))
    n = F.length("token")
    zones = F.array_compact(F.array(F.when(n <= 5, F.lit("")), F.when(n >= 5, F.concat(F.lit("<"), F.substring("token", 1, 2))), F.when(n >= 5, F.concat(F.lit(">"), F.expr("right(token, 2)")))))
    shards = shards.select("key", "token", F.xxhash64("kind", rest, F.size(F.split("key", " "))).alias("h"), F.explode(zones).alias("zone")).select("key", "token", F.xxhash64("h", "zone").alias("shard"))
    hot = F.broadcast(heavy_keys(shards, "shard", MOST, hot_rows + 1).select("shard", F.ceil(F.col("lg_n") / hot_rows).cast("int").alias("lg_hot")))
    own = F.pmod(F.xxhash64("token"), F.coalesce(F.col("lg_hot"), F.lit(1)).cast("long")).cast("int")
    spread = shards.join(hot, "shard", "left").select("shard", "token", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.coalesce("lg_hot", F.lit(1)) - 1)).alias("chunk"))
    asked = spread.select("shard", "chunk", (F.col("own") != F.col("chunk")).alias("passing"), "token", "key")
    sorted_ = asked.repartition("shard", "chunk").sortWithinPartitions("shard", "chunk", "passing")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, trie, out = None, {}, None, []

        def walk(token: str, key: str) -> None:
            for other in neighbours(trie, token, bound):
                if other != token and not (token in KNOWN and other in KNOWN):
                    out.extend((key, k) for k in held[other] if key < k)

        def close() -> None:  # the chunk's own rows meet each other
            nonlocal trie
            trie = {}
            if len(held) > 1:
                for token in held:
                    _insert(trie, token)
                for token, names in held.items():
                    for key in names:
                        walk(token, key)

        for frame in frames:
            for shard, chunk, passing, token, key in zip(frame["shard"], frame["chunk"], frame["passing"], frame["token"], frame["key"]):
                if (shard, chunk) != at:
                    if trie is None and at is not None:
                        close()
                    at, held, trie = (shard, chunk), {}, None
                if not passing:
                    held.setdefault(token, []).append(key)
                    continue
                if trie is None:
                    close()
                    for known in held:
                        if known not in trie:
                            _insert(trie, known)
                walk(token, key)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["key_a", "key_b"])
                out.clear()
        if trie is None and at is not None:
            close()
        if out:
            yield pd.DataFrame(out, columns=["key_a", "key_b"])

    return sorted_.mapInPandas(run, "key_a string, key_b string").distinct()


def agree(a: str, b: str, bound: int = 2) -> bool:
    """Whether two keys have the same tokens in some order but for up to ``bound`` edits, no more than half of a token's letters."""
    p, q = Counter(a.split()), Counter(b.split())
    p, q = list((p - q).elements()), list((q - p).elements())
    if len(p) != len(q) or not 1 <= len(p) <= bound:
        return False
    for order in itertools.permutations(q):
        spent = [0 if x == y else next((k for k in range(1, bound + 1) if k <= len(x) / 2 and neighbours(_one(x), y, k)), bound + 1) for x, y in zip(p, order)]
        if sum(spent) <= bound and not any(x in KNOWN and y in KNOWN for x, y in zip(p, order)) and all(x[0] != "?" and len(x) > 1 and len(y) > 1 for x, y in zip(p, order)):
            return True
    return False


@functools.lru_cache(4096)
def _one(word: str) -> dict:
    root: dict = {}
    _insert(root, word)
    return root


def _variants(word: str, edits: int, long: int = 20) -> set[str]:
    """A word and what up to ``edits`` deletions leave of it: words at so many edits have one of them in common. Words of more
    than ``long`` letters, and those that can be at two edits from one, share a mark instead.
    """
    found = {"*"} if len(word) >= long - 1 else set()
    if len(word) <= long:
        last = {word}
        found |= last
        for _ in range(edits):
            last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
            found |= last
    return found


def meeting_keys(kind: str, key: str, core: str, extra: str, surname: str, first: str) -> set[str]:
    """What a key has in common with every key of its kind that context_typos() or context_completions() can link it to.

    A typing error leaves all tokens but one, which is at two edits or less, or all but two, which are at one.
    """
    tokens = key.split()
    found = set()
    for i, one in enumerate(tokens):
        rest = " ".join(sorted(tokens[:i] + tokens[i + 1 :]))
        found |= {f"1 {v}|{rest}" for v in _variants(one, 2)}
        for j in range(i):
            rest = " ".join(sorted(tokens[:j] + tokens[j + 1 : i] + tokens[i + 1 :]))
            found |= {f"2 {'/'.join(sorted((v, w)))}|{rest}" for v in _variants(one, 1) for w in _variants(tokens[j], 1)}
    if kind in ("person", "firm"):
        found.add(f"c {core}|{extra}")
    if kind == "person" and first:
        found.add(f"i {surname}|{first[0]}|{extra}")
    return found


def together(contexts: DataFrame, keys: DataFrame, crowd: int = 50) -> DataFrame:
    """key_a, key_b (both orders) of keys of one kind that were written about the same thing.

    contexts: key, context; keys as in spellings(). Up to ``crowd`` keys of a context are all paired off. Of more, those are paired
    that share one of meeting_keys(), so every pair that context_typos() or context_completions() can
    link is there whatever the crowd; others, which neither would take, are not formed.
    """
    one = contexts.where("context is not null").select("key", "context").distinct()
    counted = one.groupBy("context").agg(F.count("*").alias("n")).where("n > 1")
    some = cut(one.join(counted, "context").join(keys.select("key", "kind", "core", "extra", "surname", "first"), "key"), "contexts")
    rare = some.where(F.col("n") <= crowd).select("context", "kind", "key")
    pairs = rare.withColumnRenamed("key", "key_a").join(rare.withColumnRenamed("key", "key_b"), ["context", "kind"]).where("key_a <> key_b").select("key_a", "key_b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 500):  # a key has hundreds of them
                rows = [(context, kind, key, m) for context, kind, key, *rest in frame.iloc[at : at + 500].itertuples(index=False, name=None) for m in meeting_keys(kind, key, *rest)]
                yield pd.DataFrame(rows, columns=["context", "kind", "key", "m"])

    crowded = some.where(F.col("n") > crowd).select("context", "kind", "key", "core", "extra", "surname", "first")
    met = cut(crowded.mapInPandas(run, "context string, kind string, key string, m string").select("key", F.xxhash64("context", "kind", "m").alias("m")).distinct(), "meeting")
    close = salted_join(met.withColumnRenamed("key", "key_a"), met.withColumnRenamed("key", "key_b"), "m").where("key_a <> key_b").select("key_a", "key_b")
    return pairs.unionByName(close).distinct()


def context_typos(pairs: DataFrame) -> DataFrame:
    """key_a, key_b (a < b) of pairs of together() that agree() up to two edits: in two tokens, in short ones, or in one.

    So little likeness counts only between names written about the same thing.
    """
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    near = pairs.where("key_a < key_b").where((F.abs(F.length("key_a") - F.length("key_b")) <= 2) & (F.levenshtein(letters(F.col("key_a")), letters(F.col("key_b"))) <= 4))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[agree(a, b) for a, b in zip(frame["key_a"], frame["key_b"])]]

    return near.mapInPandas(run, "key_a string, key_b string")


def parse_owners(owners: DataFrame, text_col: str, context: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(owner, n_rows and the parts that parse() finds of each distinct text that names somebody; owner, context).

    The second table holds what each text was written about, once each; it is empty without ``context``.
    """
    plain = owners.select(F.col(text_col).cast("string").alias("owner"), (F.lit(None) if context is None else context).cast("string").alias("context")).where("owner is not null")
    by_context = cut(plain.groupBy("owner", "context").agg(F.count("*").alias("n")), "texts")
    schema = "owner string, n_rows long, kind string, key string, core string, part string, extra string, surname string, first string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(o, n, *p) for o, n in zip(frame["owner"], frame["n_rows"]) if (p := parse(o)) is not None]
            yield pd.DataFrame(rows, columns=["owner", "n_rows", "kind", "key", "core", "part", "extra", "surname", "first"])

    return by_context.groupBy("owner").agg(F.sum("n").alias("n_rows")).mapInPandas(run, schema), by_context.where("context is not null").select("owner", "context")


def _alternatives(keys: DataFrame) -> DataFrame:
    """key, kind, core, part, extra with one row per meaning of a short form of several names (``?TED``)."""
    short = [(("?" + s), full) for s, names in NAME_OF.items() if len(names) > 1 for full in names]
    table = keys.sparkSession.createDataFrame(short, "word string, full string")
    some = keys.where("core like '%?%'").withColumn("word", F.explode(F.filter(F.split("core", " "), lambda w: w.startswith("?"))))
    swapped = F.array_join(F.array_sort(F.transform(F.split("core", " "), lambda w: F.when(w == F.col("word"), F.col("full")).otherwise(w))), " ")
    return some.join(F.broadcast(table), "word").select("kind", "key", swapped.alias("core"), "part", "extra")


def completions(keys: DataFrame, mistyped: DataFrame) -> DataFrame:
    """key, parent: spellings that leave something open and have exactly one fuller spelling.

    A person without the middle initial, a firm without its legal form, an initial for a first name,
    or a short form of several first names: each is looked up in an index that keeps a fuller form only
    where it is the only one, so nothing is linked on a guess and no group is ever paired off. Keys
    in ``mistyped`` (errors of other keys) are no fuller forms.
    """
    solid = keys.where("core not like '%?%' and (kind <> 'person' or length(first) > 1)").join(mistyped.select("key"), "key", "left_anti")
    by_core = solid.groupBy("kind", "core", "extra").agg(F.countDistinct(F.when(F.col("part") != "", F.col("part"))).alias("n_full"), F.max_by(F.when(F.col("part") != "", F.col("key")), F.when(F.col("part") != "", F.col("n_rows"))).alias("full"), F.max(F.when(F.col("part") == "", F.col("key"))).alias("bare"))
    best = F.when(F.col("n_full") == 1, F.col("full"))
    open_part = solid.where("part = '' and kind in ('person', 'firm')").join(by_core, ["kind", "core", "extra"]).select("key", best.alias("parent"))

    alternatives = _alternatives(keys)
    exact = alternatives.where("part <> ''").join(solid.select("kind", "core", "extra", "part", F.col("key").alias("parent")), ["kind", "core", "extra", "part"]).select("key", "parent")
    loose = alternatives.where("part = ''").join(by_core, ["kind", "core", "extra"]).select("key", F.coalesce(best, F.col("bare")).alias("parent"))
    meant = exact.unionByName(loose).where("parent is not null").groupBy("key").agg(F.countDistinct("parent").alias("n"), F.max("parent").alias("parent")).where("n = 1").select("key", "parent")

    people = solid.where("kind = 'person' and part is not null").withColumn("letter", F.substring("first", 1, 1))
    initials = keys.where("kind = 'person' and length(first) = 1").withColumn("letter", F.col("first"))
    same = people.groupBy("surname", "letter", "extra", "part").agg(F.countDistinct("core").alias("n"), F.max_by("key", "n_rows").alias("parent"))
    any_part = people.groupBy("surname", "letter", "extra").agg(F.countDistinct("core").alias("n"), F.max_by("key", F.struct(F.length("part"), "n_rows")).alias("parent"), F.countDistinct(F.when(F.col("part") != "", F.col("part"))).alias("n_parts"))
    with_part = initials.join(same.where("n = 1"), ["surname", "letter", "extra", "part"]).select("key", "parent", F.lit(1).alias("o"))
    without = initials.where("part = ''").join(any_part.where("n = 1 and n_parts <= 1"), ["surname", "letter", "extra"]).select("key", "parent", F.lit(0).alias("o"))
    guessed = without.unionByName(with_part).groupBy("key").agg(F.min_by("parent", "o").alias("parent"))
    return open_part.unionByName(meant).unionByName(guessed).where("parent is not null and parent <> key")


def context_completions(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, parent: open spellings (see completions()) with exactly one fuller spelling written about the same thing."""
    cols = ("core", "part", "extra", "surname", "first")
    side = lambda x: keys.select(F.col("key").alias(f"key_{x}"), F.col("kind").alias(f"kind_{x}"), *[F.col(c).alias(f"{c}_{x}") for c in cols])
    both = pairs.join(side("a"), "key_a").join(side("b"), "key_b").where("extra_a = extra_b and kind_a in ('person', 'firm')")
    same = "core_a = core_b and core_a not like '%?%' and part_a = '' and part_b <> ''"
    initial = "kind_a = 'person' and length(first_a) = 1 and length(first_b) > 1 and surname_a = surname_b and startswith(first_b, first_a) and (part_a = '' or part_a = part_b)"
    return both.where(f"({same}) or ({initial})").groupBy(F.col("key_a").alias("key")).agg(F.min("key_b").alias("parent"), F.count_distinct("key_b").alias("n")).where("n = 1").select("key", "parent")


def spellings(owners: DataFrame, text_col: str, context: Column | None = None) -> DataFrame:
    """owner, owner_key of each distinct text that names somebody: texts with one key name one owner.

    Texts with equal canonical tokens are one. A key at one edit from another (trie_join()) is a typing
    error of it, however often either was written; keys at two edits, or with an edit in a short word, are so
    if both were written about the same ``context`` (context_typos()). completions() adds open spellings with
    one fuller form anywhere, and context_completions() those with one in their context. Every key has at
    most one parent, which is fuller, more frequent or (between equals) of better known words; pointers to
    parents are doubled until none moves. Null, empty and blank texts and words for "unknown" give no row.
    """
    parsed, written = parse_owners(owners, text_col, context)
    parsed = cut(parsed, "owners")
    keys = cut(parsed.groupBy("kind", "key", "core", "part", "extra", "surname", "first").agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_texts")).groupBy("kind", "key").agg(
        F.max_by(F.struct("core", "part", "extra", "surname", "first"), F.struct("n_rows", "core", "surname")).alias("p"), F.sum("n_rows").alias("n_rows"), F.sum("n_texts").alias("n_texts")
    ).select("kind", "key", "p.*", "n_rows", "n_texts"), "keys")
    known = F.size(F.array_intersect(F.split("key", " "), F.array(*[F.lit(w) for w in sorted(KNOWN)])))
    size = keys.select("key", "n_rows", "n_texts", known.alias("known"))
    pairs = trie_join(keys.select("kind", "key"))
    met = None
    if context is not None:
        met = cut(together(written.join(parsed.select("owner", "key"), "owner"), keys), "together")
        pairs = pairs.unionByName(context_typos(met)).distinct()
    side = lambda c: size.select(F.col("key").alias(f"key_{c}"), F.col("n_rows").alias(f"rows_{c}"), F.col("n_texts").alias(f"texts_{c}"), F.col("known").alias(f"known_{c}"))
    order = lambda c: F.struct(f"rows_{c}", f"texts_{c}", f"known_{c}", f"key_{c}")
    smaller = order("a") < order("b")
    typed = pairs.join(side("a"), "key_a").join(side("b"), "key_b").select(F.when(smaller, F.col("key_a")).otherwise(F.col("key_b")).alias("key"), F.when(smaller, F.col("key_b")).otherwise(F.col("key_a")).alias("parent"), F.when(smaller, F.col("rows_b")).otherwise(F.col("rows_a")).alias("w"))
    typed = cut(typed, "typed")
    every = completions(keys, typed.select("key").distinct()).select("key", "parent", F.lit(9e18).cast("long").alias("w")).unionByName(typed)
    if met is not None:
        every = every.unionByName(context_completions(met, keys).select("key", "parent", F.lit(8e18).cast("long").alias("w")))
    parents = cut(every.groupBy("key").agg(F.max_by("parent", F.struct("w", "parent")).alias("parent")), "parents")
    while True:
        up = parents.select(F.col("key").alias("parent"), F.col("parent").alias("above"))
        moved = cut(parents.join(up, "parent", "left").select("key", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        discard(parents)
        parents = moved
        if moved.where("moved").isEmpty():
            break
    return parsed.join(parents, "key", "left").select("owner", F.coalesce("parent", "key").alias("owner_key"))


def same_owner(owners: DataFrame, text_col: str, context: Column | None = None) -> DataFrame:
    """owner_a, owner_b (a < b by code points): every pair of different texts that name the same owner.

    The result itself pairs off the spellings of an owner; one with very many is spread over tasks.
    """
    named = cut(spellings(owners, text_col, context), "spellings")
    some = named.groupBy("owner_key").agg(F.count("*").alias("n")).where("n > 1").select("owner_key")
    left = cut(named.join(some, "owner_key", "left_semi"), "shared")
    right = left.select(F.col("owner").alias("owner_b"), "owner_key")
    return salted_join(left.withColumnRenamed("owner", "owner_a"), right, "owner_key").where("owner_a < owner_b").select("owner_a", "owner_b")
