import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lotgrid.llm.names import _insert, agree, meeting_keys, neighbours, parse, same_owner, trie_join
from pyspark.sql import functions as F


def key(t):
    p = parse(t)
    return p and p[:2]


def test_forms_of_one_owner():
    assert len({key(t) for t in ("CITY OF HALVERWICK", "City  of Halverwick", "HALVERWICK, CITY OF", "HALVERWICK (CITY)", "C OF HALVERWICK", "CTY OF HALVERWICK", "THE CITY OF HALVERWICK")}) == 1
    assert len({key(t) for t in ("KUNKHAM WAREHOUSE III CORP", "Kunkham whse III Corporation", "WAREHOUSE III OF KUNKHAM CORP", "KUNKHAM WAREHOUSE III, CORP.", "KUNKHAM WAREHOUSE III CORP C/O AGENT")}) == 1
    assert len({key(t) for t in ("GAIRBY NICHOLAS I", "GAIRBY, NICHOLAS I", "NICHOLAS IVAN GAIRBY", "Nick I. Gairby", "GAIRBY  NICHOLAS I.")}) == 1
    assert len({key(t) for t in ("FRONEY EDWARD & MICHAEL", "Mike and Edward Froney", "FRONEY, EDWARD + MICHAEL")}) == 1
    assert len({key(t) for t in ("BOARD OF EDUCATION X SCHOOLS", "B O E X SCHOOLS", "X SCHOOLS BD OF ED", "X BOARD OF EDUCATION", "BD OF EDUC X SCHLS")}) == 1
    assert len({key(t) for t in ("SPOLDER TOWNSHIP TRUSTEES", "TOWNSHIP OF SPOLDER", "SPOLDER TWP", "TRUSTEES OF SPOLDER TOWNSHIP")}) == 1


def test_different_owners_and_nobody():
    assert len({key(t) for t in ("X Y DANIEL L JR", "GIENTHAM DANIEL L JR", "GIENTHAM DANIEL L SR", "KUNKHAM WAREHOUSE II CORP", "KUNKHAM WAREHOUSE III CORP", "KUNKHAM WAREHOUSE II LLC")}) == 6
    assert {parse(t) for t in (None, "", "  ", "N/A", "-", "SEE FILE", "Owner Unknown", "unknown", "??")} == {None}
    assert parse("A" * 20_000 + " JOHN") is not None


def distance(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ABC", min_size=1, max_size=7), min_size=1, max_size=25), st.text("ABC", max_size=7), st.integers(0, 2))
def test_automaton_equals_edit_distance(words, word, bound):
    root = {}
    for w in words:
        _insert(root, w)
    assert sorted(neighbours(root, word, bound)) == sorted({w for w in words if distance(w, word) <= bound})


def test_trie_join_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("ABCD") for _ in range(rng.randrange(4, 8)))
    keys = sorted({" ".join(sorted((word(), rng.choice(("X", "Y"))))) for _ in range(400)})
    df = spark.createDataFrame([("person", k) for k in keys], "kind string, key string")
    want = set()
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            p, q = set(a.split()), set(b.split())
            if len(p - q) == 1 == len(q - p) and distance((p - q).copy().pop(), (q - p).copy().pop()) == 1 and len((p - q).pop()) >= 4 and len((q - p).pop()) >= 4:
                want.add((a, b))
    for hot in (20_000, 20):
        assert {tuple(r) for r in trie_join(df, hot_rows=hot).collect()} == want


def test_pairs(spark):
    rows = ["KLASHBY LAWRENCE F"] * 5 + ["KLASHBY LAWRENCE", "LARRY F KLASHBY", "KLASHBBY LAWRENCE F", "KLASHBY LAWRENNCE F", "K UNKNOWN", "L. F KLASHBY", "KLASHBY LAWRENCE F JR", "FLESS RIDGE REALTY LTD", "FLESS RIDGE RLTY CO LTD", "KUNKHAM MILL REALTY CORP", "KUNKHAM MILL REALTY CORP", "KUNKHAM MILL RLTY", "KUNKHAM GATE REALTY CORP", None, "", "N/A"]
    df = spark.createDataFrame([(r, "x") for r in rows], "OWNER string, owner_a string")
    got = {tuple(r) for r in same_owner(df.select("OWNER"), "OWNER").collect()}
    one = ["KLASHBBY LAWRENCE F", "KLASHBY LAWRENCE", "KLASHBY LAWRENCE F", "KLASHBY LAWRENNCE F", "L. F KLASHBY", "LARRY F KLASHBY"]
    assert got == {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]} | {("KUNKHAM MILL REALTY CORP", "KUNKHAM MILL RLTY"), ("FLESS RIDGE REALTY LTD", "FLESS RIDGE RLTY CO LTD")}
    assert same_owner(df.select("OWNER").limit(0), "OWNER").count() == 0


def test_two_edits_and_permutations():
    assert agree("JONH SMTIH", "JOHN SMITH") and agree("LEA JOHN", "LEE JOHN") and agree("KATHERINE OSTROWSKI", "KATHERINE OSTRWSKII")
    assert not agree("JOHN SMITH", "JOHN SMITH") and not agree("J SMITH", "K SMITH") and not agree("JOHN LEE", "JOHN OTT") and not agree("CITY MILL", "PORT MILL")


def test_errors_are_linked_however_often_they_were_written(spark):
    for n in (1, 2, 10):
        rows = ["KLASHBY LAWRENCE F"] * 5 + ["KLASHBBY LAWRENCE F", *["KLASHBBY" + " " * k + ", LAWRENCE F." for k in range(n - 1)]]
        got = {tuple(r) for r in same_owner(spark.createDataFrame([(r,) for r in rows], "OWNER string"), "OWNER").collect()}
        texts = sorted(set(rows))
        assert got == {(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :]}


def test_context_tells_weak_likeness(spark):
    rows = [("JOHN LEE", "p1"), ("JOHN LEE", "p2"), ("JOHN LEA", "p1"), ("JOHN LEW", "p9"), ("OTTER SAMUEL A", "q1"), ("OTTER SAMUEL B", "q2"), ("OTTER SAMUEL", "q2"), ("DRASTANE WALTER", "r1"), ("DRASATNE WLATER", "r1"), ("X", None)]
    df = spark.createDataFrame(rows, "OWNER string, p string")
    got = {tuple(r) for r in same_owner(df, "OWNER", F.col("p")).collect()}
    assert got == {("JOHN LEA", "JOHN LEE"), ("OTTER SAMUEL", "OTTER SAMUEL B"), ("DRASATNE WLATER", "DRASTANE WALTER")}


def test_a_crowded_context_is_one_too(spark):
    crowd = [(f"{a}{b}ORD ROBERT {c}", "p1") for a in "BCDFGHKLM" for b in "AEIOU" for c in "JW"]
    rows = [("JOHN LEE", "p1"), ("JOHN LEE", "p2"), ("JOHN LEA", "p1"), ("OTTER SAMUEL A", "q1"), ("OTTER SAMUEL B", "p1"), ("OTTER SAMUEL", "p1"), ("DRASTANE WALTER", "p1"), ("DRASATNE WLATER", "p1")]
    few = {tuple(r) for r in same_owner(spark.createDataFrame(rows, "OWNER string, p string"), "OWNER", F.col("p")).collect()}
    assert few == {("JOHN LEA", "JOHN LEE"), ("OTTER SAMUEL", "OTTER SAMUEL B"), ("DRASATNE WLATER", "DRASTANE WALTER")}
    got = {tuple(r) for r in same_owner(spark.createDataFrame(rows + crowd, "OWNER string, p string"), "OWNER", F.col("p")).collect()}
    assert few <= got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ABC", min_size=1, max_size=5), min_size=1, max_size=4), st.lists(st.text("ABC", min_size=1, max_size=5), min_size=1, max_size=4))
def test_keys_that_agree_meet(a, b):
    a, b = " ".join(sorted(a)), " ".join(sorted(b))
    meet = meeting_keys("public", a, a, "", "", "") & meeting_keys("public", b, b, "", "", "")
    assert meet or not agree(a, b)


def test_long_and_mistyped_keys_meet():
    rng = random.Random(3)
    for _ in range(400):
        tokens = ["".join(rng.choice("ABCDE") for _ in range(rng.choice((3, 6, 18, 19, 20, 21, 22, 40)))) for _ in range(rng.randrange(1, 4))]
        other = list(tokens)
        for _ in range(2):
            k = rng.randrange(len(other))
            i, w = rng.randrange(len(other[k])), other[k]
            other[k] = rng.choice((w[:i] + w[i + 1 :] or w, w[:i] + "X" + w[i:], w[:i] + "X" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]))
        a, b = " ".join(sorted(tokens)), " ".join(sorted(other))
        assert a == b or not agree(a, b) or meeting_keys("public", a, a, "", "", "") & meeting_keys("public", b, b, "", "", "")
