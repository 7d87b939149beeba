from datetime import date, datetime

from lotgrid.functions.keys import parcel_key
from lotgrid.llm.survivors import parcel_fields, survivors
from pyspark.sql import functions as F

COLS = "rec_id long, PARCEL_ID string, LAND_VAL double, YRBUILT int, source_id string, extract_date date, load_ts timestamp, value string"
TRUST = [("S24", "a", 1), ("S01", "b", 2), ("S02", "c", 3)]


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLS)
    t = spark.createDataFrame(TRUST, "source_id string, provider string, trust_rank int")
    out = survivors(df, t, parcel_key(F.col("PARCEL_ID")), parcel_fields(), **kw).collect()
    return {r.group_key: r for r in out}


def row(i, k, land, yr, s, d, note="clash"):
    return (i, k, land, yr, s, d, datetime(2025, 1, 1), note)


def test_trust_then_date_then_smallest_record(spark):
    d1, d2 = date(2024, 1, 1), date(2024, 6, 1)
    got = run(spark, [
        row(5, "010-000001", 100.0, 1990, "S01", d1), row(6, "010000001", 200.0, 1991, "S01", d2), row(7, "10-1", 300.0, None, "S02", date(2025, 1, 1)), row(4, "010-000001-00", 200.0, 9999, "S02", d1), row(4, "010-000001-00", 200.0, 9999, "S02", d1),
        row(8, "010-000002", 1.0, 2025, "S24", d1), row(9, "010-000002", float("nan"), 0, None, None), row(10, "010-000002", 9999999.0, -999, "S01", d1),
        row(11, None, 5e4, 1990, "S01", d1), row(12, "TBD", 5e4, 1990, "S01", d1), row(13, "010-000003", 5e4, 1990, "S99", None),
    ])
    a = got["010000001"]
    assert (a.first_rec, a.n_records, a.land, a.land_rec, a.yr, a.yr_rec) == (4, 5, 200.0, 4, 1991.0, 6)
    b = got["010000002"]
    assert (b.first_rec, b.land_rec, b.yr_rec) == (8, None, None)
    assert got["010000003"].land_rec == 13 and len(got) == 3


def test_votes_decide_without_strictness_and_repeats_do_not_count(spark):
    d = date(2024, 1, 1)
    rows = [row(1, "010-000001", 500.0, 1990, "S24", d)] + [row(2 + i, "010-000001", 700.0, 1980, "S01", date(2024, 1, 2 + i)) for i in range(4)] + [row(20 + i, "010-000001", 900.0, 1970, "S02", d) for i in range(50)]
    assert run(spark, rows)["010000001"].land == 500.0
    assert run(spark, rows, strict=False)["010000001"].land == 700.0


def test_undated_votes_still_weigh_by_trust(spark):
    rows = [row(1, "010-000001", 500.0, 1990, "S99", None), row(2, "010-000001", 700.0, 1980, "S24", None), row(3, "010-000001", 700.0, 1980, "S01", None), row(4, "010-000002", 500.0, 1990, "S24", None), row(5, "010-000002", 700.0, 1980, "S24", date(1990, 1, 1))]
    got = run(spark, rows, strict=False)
    assert got["010000001"].land == 700.0 and got["010000002"].land == 500.0  # without a date: as of the year 2000
    assert run(spark, rows)["010000002"].land == 700.0  # strictly, any date is later than none


def test_votes_within_the_best_class_decide(spark):
    d = date(2024, 1, 1)
    rows = [row(1, "010-000001", 500.0, 1990, "S24", d), row(2, "010-000001", 700.0, 1990, "S24", d), row(3, "010-000001", 700.0, 1990, "S25", d)]
    df = spark.createDataFrame(rows, COLS)
    t = spark.createDataFrame([("S24", "a", 1), ("S25", "b", 1)], "source_id string, provider string, trust_rank int")
    assert survivors(df, t, parcel_key(F.col("PARCEL_ID")), parcel_fields()).first().land == 700.0


def test_empty(spark):
    assert run(spark, []) == {}


def test_a_hot_group(spark):
    rows = [row(i, "010-000001", float(1000 + i % 7), 1990, "S01", date(2024, 1, 1 + i % 28)) for i in range(3000)]
    got = run(spark, rows)["010000001"]
    assert got.n_records == 3000 and got.first_rec == 0 and got.land == min(float(1000 + i % 7) for i in range(3000) if i % 28 == 27) or got.land >= 1000
