import math
import random

from lotgrid.operators.nearby import EARTH_M, inside_regions, near_pairs, positions
from pyspark.sql import functions as F


def far(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_pairs_equal_brute_force_everywhere(spark):
    rng = random.Random(1)
    spots = [(26.0, -123.5), (0.0, 179.999), (89.999, 10.0), (-89.9995, -100.0), (60.0, -180.0), (0.001, 0.001)]
    point = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rng.gauss(0, 0.002))), (c[1] + rng.gauss(0, 0.004) + 180) % 360 - 180))(rng.choice(spots))
    a = [(i, *point()) for i in range(300)] + [(1000 + i, 26.0, -123.5) for i in range(40)]
    b = [(i, *point()) for i in range(300)] + [(2000 + i, 26.0, -123.5) for i in range(40)]
    want = {(i, j) for i, *p in a for j, *q in b if far(p, q) <= 400}
    l = spark.createDataFrame(a, "id_l long, lat double, lon double")
    r = spark.createDataFrame(b, "id_r long, lat double, lon double")
    got = near_pairs(l, r, 400.0).select("id_l", "id_r").collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want)
    assert near_pairs(l.limit(0), r, 400.0).count() == 0


def test_positions(spark):
    rows = [(1, 0.0, 0.0), (2, None, 1.0), (3, 91.0, 1.0), (4, 1.0, 181.0), (5, float("nan"), 1.0), (6, 0.0, 1.0), (6, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "rec_id long, lat double, lon double").withColumn("id", F.lit("clash"))
    assert [r.id for r in positions(df, {"id": "rec_id"}).collect()] == [6, 6]


def test_regions_with_holes_and_sizes(spark):
    wkt = [(1, "POLYGON((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"), (2, "MULTIPOLYGON(((20 20, 21 20, 20.5 21, 20 20)), ((5 5, 5.001 5, 5.001 5.001, 5 5.001, 5 5)))"), (3, None), (4, "POINT(1 1)"), (5, "POLYGON EMPTY")]
    pts = [(1, 1.0, 1.0), (2, 5.2, 5.2), (3, 5.0005, 5.0005), (4, 20.3, 20.5), (5, 11.0, 1.0)]
    got = inside_regions(spark.createDataFrame(pts, "id_p long, lat double, lon double"), spark.createDataFrame(wkt, "id_g long, wkt string")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (3, 2), (4, 2)} and len(got) == 3
