import random
from datetime import datetime, timedelta

from lotgrid.functions.keys import parcel_key
from lotgrid.operators import orphans
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)


def brute(refs, arrivals):
    first, last = {}, {}
    for k, a, r in arrivals:
        if k is not None and a is not None:
            first[k] = min(first.get(k, a), a)
        if k is not None and r is not None:
            last[k] = max(last.get(k, r), r)
    found = {(t, i) for t, i, k, at in refs if k is not None and at is not None and not (k in first and first[k] <= at and not (k in last and at >= last[k]))}
    still = {(t, i) for t, i, k, at in refs if k is not None and at is not None and (k not in first or k in last and last[k] > first[k] or k in last and last[k] <= at)}
    return found, still


def waits(state):
    gone, ever = F.col("until_ts").isNotNull(), F.expr("from_ts is not null and coalesce(until_ts > from_ts, true)")
    open_ = (F.col("kind") == "dead") | (F.col("kind") == "early") & ~ever | ever & gone
    return state.waiting.where(open_)


def test_later_retirement_takes_the_earlier_back(spark):
    r = spark.createDataFrame([("t", 1, "k", datetime(2024, 3, 15)), ("t", 2, "k", datetime(2024, 2, 1)), ("t", 3, "k", datetime(2024, 12, 1))], "table_name string, rec_id long, key string, at timestamp")
    a = spark.createDataFrame([("k", datetime(2024, 1, 1), datetime(2024, 3, 1)), ("k", datetime(2024, 1, 5), datetime(2024, 11, 1))], "key string, load_ts timestamp, retired_ts timestamp")
    for slices in (1, 3):
        state = orphans.track(r, a, slices)
        assert [tuple(x) for x in orphans.found(state).collect()] == [("t", "2024-12", 3)]
        assert sorted(map(tuple, orphans.snapshots(state).collect())) == [("t", "2024-11", 0, 0, 2, 2), ("t", "2024-12", 1, 0, 0, 3)]


def test_state_equals_brute_force_for_any_slicing(spark):
    rng = random.Random(3)
    day = lambda n: T0 + timedelta(days=rng.randrange(n))
    arrivals = []
    for k in range(30):
        if rng.random() < 0.8:
            a = day(300)
            for _ in range(rng.choice([1, 1, 2, 3])):
                r = a + timedelta(days=rng.randrange(-40, 200)) if rng.random() < 0.5 else None
                arrivals += [(f"k{k}", a, r)] * rng.choice([1, 2]) + ([(f"k{k}", a + timedelta(days=5), r)] if rng.random() < 0.3 else [])
    refs = [("t" if rng.random() < 0.7 else "u", i, f"k{0 if rng.random() < 0.4 else rng.randrange(40)}", day(500)) for i in range(600)]
    refs += [("t", 900, None, T0), ("t", 901, "k1", None)]
    found, _ = brute(refs, arrivals)
    r = spark.createDataFrame(refs, "table_name string, rec_id long, key string, at timestamp").withColumn("lg_salt", F.lit("clash"))
    a = spark.createDataFrame([*arrivals, (None, T0, None)], "key string, load_ts timestamp, retired_ts timestamp")
    seen = None
    for slices in (1, 2, 7):
        state = orphans.track(r, a, slices)
        got = orphans.found(state).collect()
        assert {(x.table_name, x.rec_id) for x in got} == found and len(got) == len(found)
        snap = sorted(map(tuple, orphans.snapshots(state).collect()), key=str)
        assert seen is None or snap == seen
        seen = snap
        waiting = {x.table_name: x.n for x in waits(state).groupBy("table_name").agg(F.sum("n").alias("n")).collect()}
        last = {t: n for t, _, *_, n in snap}
        assert waiting == last
    assert sum(s[2] for s in seen) == len(found)


def test_empty_tables(spark):
    r = spark.createDataFrame([], "table_name string, rec_id long, key string, at timestamp")
    a = spark.createDataFrame([], "key string, load_ts timestamp, retired_ts timestamp")
    state = orphans.track(r, a)
    assert orphans.found(state).count() == 0 and orphans.snapshots(state).count() == 0


def test_parcel_keys(spark):
    same = ["010-002332", "010002332", "01000233200", "10002332", "10-2332", "010 002332", "010–002332", "O1O-OO2332", "PID 010-002332", " 010.002332\t", "010-002332-00", "０１０-００２３３２", "010_002332"]
    none = [None, "", "  ", "N/A", "TBD", "UNKNOWN", "-", "ASM:010-002332"]
    rows = spark.createDataFrame([(x,) for x in [*same, *none, "LOT 7-A"]], "k string").select(parcel_key(F.col("k")).alias("p")).collect()
    got = [r.p for r in rows]
    assert set(got[: len(same)]) == {"010002332"} and set(got[len(same) : -1]) == {None} and got[-1]
