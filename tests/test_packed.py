import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lotgrid.operators.packed import split_array, split_text, unpack


def by_array(texts):
    parent, ordinal, values = split_array(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for p, o, v in zip(parent, ordinal, values.to_pylist()):
        out[p].append(v)
        assert o == len(out[p])
    return out


def test_known_forms():
    assert split_text('way/1, "relation/2, deck"; node/3') == ["way/1", "relation/2, deck", "node/3"]
    assert split_text('"014 ""old""";;\'x\' y\t[ "a","b" ]') == ['014 "old"', "x", "y", "a", "b"]
    assert split_text("; ,| \n") == [] and split_text("") == []
    assert split_text('5" pipe; "never closed; a') == ['5"', "pipe", '"never', "closed", "a"]
    assert split_text("O'Hare;'it;s'") == ["O'Hare", "it;s"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\"';,|[] \t\n", max_size=24)), max_size=12))
def test_masks_agree_with_the_scan(texts):
    assert by_array(texts) == [split_text(t or "") for t in texts]


def test_operator_edges(spark):
    long = ";".join(f"way/{i}" for i in range(50_000))
    df = spark.createDataFrame([(1, "a;a", "z"), (1, "a;a", "z"), (2, None, None), (3, "", "q"), (4, long, "q"), (None, "b", "q")], "rec_id long, t string, item string")
    rows = unpack(df, ["rec_id"], "t").collect()
    assert sorted((r.item_no, r.item) for r in rows if r.rec_id == 1) == [(1, "a"), (1, "a"), (2, "a"), (2, "a")]
    assert sum(r.rec_id == 4 for r in rows) == 50_000 and [(r.item_no, r.item) for r in rows if r.rec_id is None] == [(1, "b")]
    assert not any(r.rec_id in (2, 3) for r in rows)
    assert unpack(df.limit(0), ["rec_id"], "t").count() == 0
