"""Exact small cases of ranking, graph, geometry, aggregate, source, schema and workflow operators."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotgrid.functions import text, units
from lotgrid.operators import aggregates, geometry, graph, ranking
from lotgrid.operators.skew import lookup_join, salted_join
from lotgrid.plans.workflow import Workflow
from lotgrid.sources import readers
from lotgrid.sources.schema import Column, Layer, Violations, checks, conform, difference, run_checks, write_layer


def test_allocation_on_a_street(spark):
    reach = spark.createDataFrame([(1, c, m) for c, m in enumerate([0.0, 1.5, 4.0, 4.5, 7.0])], "src long, cell long, minutes double")
    values = spark.createDataFrame([(1, 0, 100.0), (2, 4, 7.0), (3, None, 5.0)], "src long, own_cell long, v double")
    got = {r.cell: r.v for r in graph.allocate(values, reach).collect()}
    w = [1, 1, 0.6, 0.6, 0.25]
    for c in range(4):
        assert abs(got[c] - 100 * w[c] / sum(w)) < 1e-9
    assert abs(sum(got.values()) - 107) < 1e-9


def test_worked_allocation(spark):
    minutes = [1.0] + [4.0] * 3 + [7.0] * 6
    reach = spark.createDataFrame([(1, c, m) for c, m in enumerate(minutes)], "src long, cell long, minutes double")
    got = {r.cell: round(r.v, 2) for r in graph.allocate(spark.createDataFrame([(1, 0, 100.0)], "src long, own_cell long, v double"), reach).collect()}
    assert got[0] == 23.26 and got[1] == 13.95 and got[9] == 5.81


def test_bands_and_units(spark):
    got = [r.w for r in spark.createDataFrame([(m,) for m in (1.0, 3.0, 4.0, 8.0, 8.5)], "m double").select(units.band_weight(F.col("m")).alias("w")).collect()]
    assert got == [1.0, 1.0, 0.6, 0.25, 0.0]
    with pytest.raises(ValueError):
        units.walk_minutes(F.lit(1.0), 0)


def test_normalise_edges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double")
    got = {r.v: r.n for r in ranking.normalise(df, "v", "n").collect()}
    assert got[1.0] == 0 and got[100.0] == 100 and got[None] == 50
    same = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert {r.n for r in ranking.normalise(same, "v", "n").collect()} == {50.0}


def test_rank_ties_and_weights(spark):
    s = spark.createDataFrame([("b", "x", 1.0), ("a", "x", 1.0), ("c", "x", 0.0)], "id string, criterion string, score double")
    w = spark.createDataFrame([("w", "x", 1.0)], "scenario string, criterion string, weight double")
    got = {r.id: r["rank"] for r in ranking.unique_rank(ranking.composite(s, w), ["scenario"], "composite", "id").collect()}
    assert got == {"a": 1, "b": 2, "c": 3}
    rows = ranking.one_at_a_time({"a": 0.5, "b": 0.3, "c": 0.2}, (0.8, 1.2))
    for name in {r[0] for r in rows}:
        assert abs(sum(r[2] for r in rows if r[0] == name) - 1) < 1e-12
    first = sorted(map(tuple, ranking.drawn_weights(spark, {"a": 0.5, "b": 0.5}, 5, 10.0, 3).collect()))
    assert first == sorted(map(tuple, ranking.drawn_weights(spark, {"a": 0.5, "b": 0.5}, 5, 10.0, 3).collect()))


def test_greedy_and_conflicts(spark):
    p = spark.createDataFrame([("s", i, float(i), 0.0, float(-i)) for i in range(10)], "g string, id long, x double, y double, o double")
    assert sorted(r.id for r in ranking.greedy_spaced(p, "g", "id", "x", "y", "o", 3, 2.0).collect()) == [0, 2, 4]
    n = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "g long, id string, rank long")
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c")], "g long, a string, b string")
    assert {r.id: r.lost_to for r in ranking.resolve_conflicts(n, e).collect()} == {"a": None, "b": "a", "c": None}


def test_components_of_long_chains_and_strangers(spark):
    n = spark.range(0, 60).select(F.col("id"))
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "a long, b long")
    got = {r.id: r.component for r in graph.components(n, e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[51] == 50 and got[45] == 45
    share = graph.largest_component_share(graph.components(n, e)).first().share
    assert abs(share - 41 / 60) < 1e-12


def test_components_of_a_shuffled_path_are_one(spark):
    order = [int(x) for x in np.random.default_rng(1000).permutation(1000)]
    e = spark.createDataFrame(list(zip(order[:-1], order[1:])), "a long, b long")
    got = graph.components(spark.range(1005), e).groupBy("component").count()
    assert {r.component: r["count"] for r in got.collect()} == {0: 1000, 1000: 1, 1001: 1, 1002: 1, 1003: 1, 1004: 1}


def test_paths_equal_dijkstra(spark):
    rng = np.random.default_rng(0)
    raw = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(1, 9, 80))] + [(1, None, 1.0), (3, 3, 1.0)]
    e = graph.undirected(spark.createDataFrame(raw, "a long, b long, w double"))
    d = np.full((30, 30), math.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in raw:
        if b is not None:
            d[a, b], d[b, a] = min(d[a, b], w), min(d[b, a], w)
    for k in range(30):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1, :])
    got = {(r.src, r.node): r.cost for r in graph.bounded_reach(e, spark.createDataFrame([(0, 0), (7, 7)], "src long, node long"), 9.0).collect()}
    assert got == {(s, t): d[s, t] for s in (0, 7) for t in range(30) if d[s, t] <= 9}


def test_reach_follows_paths_of_many_edges(spark):
    e = graph.undirected(spark.createDataFrame([(i, i + 1, 1.0) for i in range(80)], "a long, b long, w double"))
    got = {r.node: r.cost for r in graph.bounded_reach(e, spark.createDataFrame([(0, 0)], "src long, node long"), 70.0).collect()}
    assert got == {i: float(i) for i in range(71)}
    with pytest.raises(ValueError):
        graph.bounded_reach(e.withColumn("w", -F.col("w")), spark.createDataFrame([(0, 0)], "src long, node long"), 70.0)


def test_nearest_finds_outliers(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 0.0), (3, None, 0.0)], "id_a long, x double, y double")
    b = spark.createDataFrame([(1, 0.5, 0.0), (2, math.nan, 0.0)], "id_b long, x double, y double")
    assert sorted(map(tuple, geometry.nearest(a, b, 1.0).collect())) == [(1, 1, 0.5), (2, 1, 8999.5)]
    assert geometry.nearest(a, b.limit(0), 4000.0).count() == 0


def test_constrained_merge(spark):
    n = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (1, 3, "y"), (1, 4, "x")], "g long, id long, kind string")
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 2, 4)], "g long, a long, b long")
    assert {r.id: r.cluster for r in graph.constrained_merge(n, e, "g", "id", ["kind"]).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_hexagons_hold_their_points(spark):
    p = spark.range(0, 500).select(((F.col("id") * 37) % 101 - 50.0).alias("x"), ((F.col("id") * 53) % 97 - 48.0).alias("y"))
    h = geometry.hex_cell(F.col("x"), F.col("y"), 7.0)
    c = p.select("x", "y", h.alias("h")).select("x", "y", "h.q", "h.r", geometry.hex_centre(F.col("h.q"), F.col("h.r"), 7.0).alias("c")).collect()
    assert all(math.hypot(r.x - r.c.x, r.y - r.c.y) <= 7.0 + 1e-9 for r in c)
    cells = spark.createDataFrame([(0, 0), (1, 0), (5, 5)], "q int, r int")
    assert geometry.hex_neighbours(cells).count() == 2


def test_slope_of_a_plane(spark):
    r = spark.range(0, 400).select((F.col("id") % 20).alias("col"), F.floor(F.col("id") / 20).alias("row")).withColumn("value", F.when((F.col("row") == 10) & (F.col("col") == 10), None).otherwise(F.col("col") * 0.5))
    got = {(x.row, x.col): x.slope for x in geometry.horn_slope(r, 10.0).collect()}
    assert abs(got[(5, 5)] - 5.0) < 1e-9 and got[(0, 5)] is None and got[(9, 9)] is None and len(got) == 400


def test_similarity(spark):
    rows = [("main street garage", "garage main street", 1.0), ("lot 4", "lot 5", 0.0), (None, "x", 0.0), ("abc", "abd", 2 / 3)]
    got = [r.s for r in spark.createDataFrame([r[:2] for r in rows], "a string, b string").select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert all(abs(g - w[2]) < 1e-9 for g, w in zip(got, rows))


def test_services_by_date(spark):
    cal = spark.createDataFrame([("WK", 1, 1, 1, 1, 1, 0, 0, "20240101", "20241231"), ("WE", 0, 0, 0, 0, 0, 1, 1, "20240101", "20241231"), ("OLD", 1, 1, 1, 1, 1, 1, 1, "20200101", "20201231")], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string")
    ex = spark.createDataFrame([("WK", "20240704", "2"), ("X", "20240704", "1")], "service_id string, date string, exception_type string")
    names = lambda day: sorted(r.service_id for r in aggregates.active_services(cal, ex, day).collect())
    assert names("20240703") == ["WK"] and names("20240704") == ["X"] and names("20240706") == ["WE"]
    m = spark.createDataFrame([("25:15:00",), ("x",), (None,)], "t string").select(text.to_minutes(F.col("t")).alias("m")).collect()
    assert [r.m for r in m] == [1515.0, None, None]


def test_skewed_joins_lose_nothing(spark):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [("cold", 1), (None, 2)], "k string, v long")
    index = spark.createDataFrame([("hot", "H"), ("cold", "C"), ("none", "N")], "k string, w string")
    got = lookup_join(left, index, "k").groupBy("w").count().collect()
    assert {r.w: r["count"] for r in got} == {"H": 3000, "C": 1, None: 1}
    right = spark.createDataFrame([("hot", i) for i in range(1500)] + [("cold", 3)], "k string, u long")
    assert salted_join(left, right, "k").count() == 3000 * 1500 + 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,x,y\n1,2.5,3\n2,,4\n3,"q",5\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert readers.points_from(df, "x", "y").count() == 1
    with pytest.raises(ValueError):
        readers.map_fields(df, {"ident": "nope"}, ("ident",))
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", "stop_id,stop_name\nA,First\nB,\n")
    assert readers.read_zipped(spark, str(tmp_path / "g.zip"), "stops.txt", ["stop_id", "stop_name", "zone"]).count() == 2
    feats = [{"type": "Feature", "properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {"n": "q"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    rows = {r.geometry_type: r for r in readers.read_geojson(spark, str(tmp_path / "f.geojson")).collect()}
    assert rows["Point"].x == 1 and len(rows["Polygon"].rings[0]) == 4
    src = readers.Source("S01", "p", {"ident": "id", "px": "x"}, "ident")
    assert src.standard(df.unionByName(df)).count() == 3 and readers.Source("S", None, {}, "k").state() == "not configured"
    spark.range(5).select(F.struct(F.col("id").alias("xmin"), F.col("id").alias("xmax"), F.lit(0).alias("ymin"), F.lit(1).alias("ymax")).alias("bbox"), "id").write.parquet(str(tmp_path / "b"))
    assert readers.read_box(spark, str(tmp_path / "b"), (1, 0, 2, 1), ["id"]).count() == 2
    assert readers.read_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0


LAYER = Layer("lots", (Column("lot_id", "TEXT", nullable=False, unique=True), Column("kind", "TEXT", codes=("a", "b")), Column("n", "INTEGER", low=0, high=9)), parents={"kind": ("kinds", "kind")})


def test_conform_reports_everything_at_once(spark):
    bad = spark.createDataFrame([("1", "a", "3"), ("1", "z", "12"), (None, None, "x")], "lot_id string, kind string, n string").withColumn("more", F.lit(1))
    with pytest.raises(Violations) as e:
        conform(bad, LAYER)
    for part in ("unknown column more", "lot_id is null: 1", "lot_id is not unique: 1", "kind is not a known code: 1", "n is out of range: 1"):
        assert part in str(e.value)
    good = conform(spark.createDataFrame([("1", "a", "3")], "lot_id string, kind string, n string"), LAYER)
    assert good.columns == ["lot_id", "kind", "n"] and dict(good.dtypes)["n"] == "bigint"


def test_checks_and_sink(spark, tmp_path):
    spark.createDataFrame([("1", "a", 3), ("1", "z", 12)], "lot_id string, kind string, n int").createOrReplaceTempView("lots")
    spark.createDataFrame([("a",)], "kind string").createOrReplaceTempView("kinds")
    got = {(r.kind, r.what): r.n for r in run_checks(spark, checks([LAYER])).collect()}
    assert got == {("domain", "lots.kind"): 1, ("range", "lots.n"): 1, ("unique", "lots.lot_id"): 1, ("required", "lots.lot_id"): 0, ("orphan", "lots.kind"): 1}
    one = spark.createDataFrame([("1", "a", 3)], "lot_id string, kind string, n int")
    two = one.unionByName(spark.createDataFrame([("2", "b", 4)], "lot_id string, kind string, n int"))
    for df, source in ((two, "S1"), (one, "S2"), (one, "S1")):
        path = write_layer(df, LAYER, str(tmp_path), source, "r1")
    assert spark.read.parquet(path).count() == 2
    assert difference(LAYER.struct(), LAYER.struct()) == [] and difference(LAYER.struct(), one.schema)


def test_workflow():
    w, ran = Workflow(), []
    w.step("a", settings=("k",))(lambda c: ran.append("a"))
    w.step("b", needs=("a",))(lambda c: ran.append("b"))
    assert w.run({"k": 1}) == {"a": "done", "b": "done"} and ran == ["a", "b"]
    assert w.run({"k": 1}) == {"a": "unchanged", "b": "unchanged"} and len(ran) == 2
    w.run({"k": 2}, ["a"])
    assert w.status["b"] == "stale" and Workflow().run({}) == {}
    assert w.run({"k": None})["a"] == "blocked"


def test_streamed_windows_equal_batch(spark, tmp_path):
    from lotgrid.streaming import windows

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in e.dtypes)
    q = windows.windowed_counts(windows.stream_parquet(spark, str(tmp_path / "in"), schema), late="400 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert {(r.window_start, r.event_type, r.n) for r in spark.table("w").collect()} == {(r.window_start, r.event_type, r.n) for r in windows.windowed_counts(e).collect()}
    finally:
        q.stop()


def test_frontage_and_corner(spark):
    lot = spark.createDataFrame([(1, 0.0, 0.0), (2, 500.0, 500.0)], "id long, x double, y double").select("id", geometry.box(F.col("x"), F.col("y"), F.lit(20.0), F.lit(10.0)).alias("ring"))
    streets = spark.createDataFrame([(1, -50.0, -3.0, 80.0, -3.0), (2, -3.0, -50.0, -3.0, 80.0)], "id_s long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r for r in geometry.frontage(lot, streets, 4.0, 1.0).collect()}
    assert 30 <= got[1].frontage <= 34 and got[1].streets == 2 and got[1].corner
    assert (got[2].frontage, got[2].streets, got[2].corner) == (0.0, 0, False)


def test_grid_covers_its_area(spark):
    area = spark.createDataFrame([(0.0, 0.0)], "x double, y double").select(geometry.box(F.col("x"), F.col("y"), F.lit(100.0), F.lit(80.0)).alias("ring"))
    n = geometry.hex_grid(area, 5.0).count()
    assert abs(n * 1.5 * math.sqrt(3) * 25 - 8000) < 900


def test_shared_area_and_shape(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double").select("id", geometry.box(F.col("x"), F.col("y"), F.lit(10.0), F.lit(10.0)).alias("ring"))
    tri = spark.createDataFrame([(1, [(0.0, 0.0), (20.0, 0.0), (0.0, 20.0)])], "id long, t array<struct<x:double,y:double>>")
    r = a.join(tri, "id").select(geometry.shared_area(F.col("ring"), F.col("t")).alias("s"), geometry.rectangularity(F.col("t")).alias("q"), geometry.area(F.col("t")).alias("a")).first()
    assert abs(r.s - 100) < 1e-9 and abs(r.q - 0.5) < 1e-9 and r.a == 200
