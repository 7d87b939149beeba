"""Source rules, code tables, shapes, records and the wired pipeline on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotgrid.functions import rules, text
from lotgrid.operators import areas, codes, geometry, graph, ranking
from lotgrid.plans import pipeline
from lotgrid.session import cut
from lotgrid.sources import adapters, readers, schema

# fixed values: how codes are written and which row of the table they mean
LADDER = [("C4", "C-4", False), ("LC4", "C-4", True), ("UCR-R", "UCR-R", False), ("UCR", "UCR", False), ("LRR", "LRR", False), ("LRRR", "RRR", True), ("LR", "R", True), ("RURAL", "R", False), ("PUD8", "PUD", False), ("LUCRPD", "UCRPD", True), ("ARO", "AR-O", False), ("R2F", "R-2F", False)]
USES = {"C-4": ("ByRight", "High"), "UCR": ("Prohibited", "High"), "C-1": ("Prohibited", "Low"), "DD": ("Unknown", "Medium"), "DD|ParkingZoneA": ("Prohibited", "High"), "DD|ParkingZoneB": ("ByRight", "High"), "overlay:UCO": ("ByRight", "High"), "overlay:NC": ("Unknown", "Low")}


def code_rows(extra=()):
    known = [("City", c, *USES.get(c, ("Prohibited", "High"))) for c in dict.fromkeys([*(r for _, r, _ in LADDER), *USES])]
    return [(j, c, "d", u, k, "r", "o", "v", "n") for j, c, u, k in [*known, ("*", "*", "Unknown", "Low"), *extra]]


def code_table(spark, rows=None):
    return spark.createDataFrame(rows or code_rows(), ", ".join(f"{c} string" for c in codes.COLUMNS))


def test_code_ladder(spark):
    asked = spark.createDataFrame([("City", c) for c, _, _ in LADDER] + [("City", None), (None, "C4"), ("City", "")], "jurisdiction string, code string")
    got = {(r.jurisdiction, r.code): (r.zoning_code, r.limited) for r in codes.match_codes(asked, codes.checked_table(code_table(spark)), {"RURAL": "R"}).collect()}
    assert got == {("City", c): (row, lim) for c, row, lim in LADDER} | {("City", None): (None, None), (None, "C4"): (None, None), ("City", ""): (None, None)}


def test_codes_resolved(spark):
    ask = [
        ("C4", "City", [], None, False, ("ByRight", "Pass")), ("UCR", "City", [], None, False, ("Prohibited", "Fail")), ("C1", "City", [], None, False, ("Prohibited", "Review")), ("LC4", "City", [], None, False, ("ByRight", "Review")),
        ("DD", "City", [], None, False, ("Unknown", "Review")), ("DD", "City", [], "a", False, ("Prohibited", "Fail")), ("DD", "City", None, "B", False, ("ByRight", "Pass")), ("DD", "City", [], "B", True, ("ByRight", "Review")), ("DD", "City", [], "A", True, ("Prohibited", "Review")),
        ("C4", "City", ["overlay:UCO"], None, None, ("ByRight", "Pass")), ("C4", "city ", ["overlay:NC", "nope"], None, False, ("Unknown", "Review")), ("C-4", "Town", ["overlay:NC"], None, True, ("Unknown", "Review")), ("C-4", None, [], None, False, ("Unknown", "Review")), ("ZZ9", "City", [], None, False, ("Unknown", "Review")), (None, "City", [], None, False, ("Unknown", "Review")),
    ]
    df = spark.createDataFrame([(i, c, j, o, z, n) for i, (c, j, o, z, n, _) in enumerate(ask)], "id long, code string, jurisdiction string, overlays array<string>, zone string, near_boundary boolean")
    got = {r.id: r for r in codes.resolve_codes(df.unionByName(df.limit(1)), code_table(spark), {}).collect()}
    assert {i: (r.screen, r.route) for i, r in got.items()} == {i: a[-1] for i, a in enumerate(ask)}
    assert got[3].notes == ["limitation text applies"] and got[10].notes == ["overlay not in table: nope"] and got[11].notes == ["jurisdiction not in table"]
    assert codes.resolve_codes(df.limit(0), code_table(spark), {}).count() == 0


def test_code_table_faults(spark):
    with pytest.raises(codes.CodeTableError, match="2 rows with an unknown commercial_parking_use; 1 rows with an unknown confidence; 1 codes listed twice"):
        codes.checked_table(code_table(spark, code_rows([("X", "A", "Maybe", "High"), ("X", "B", None, "Sure"), ("city", "C4", "ByRight", "High")])))
    with pytest.raises(codes.CodeTableError, match="missing columns"):
        codes.checked_table(code_table(spark).drop("notes"))


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, w):
    return ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))


def test_areas_of_any_shape():
    ell = [ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))]
    holed = [square(0, 0, 4), square(1, 1, 2)]
    parts = [square(0, 0, 1), square(3, 3, 1)]
    assert areas.areas(ell, [square(1, 1, 2)]) == pytest.approx((12, 4, 3))
    assert areas.areas(holed, [square(1, 1, 2)]) == pytest.approx((12, 4, 0))
    assert areas.areas(holed, parts) == pytest.approx((12, 2, 2)) and areas.areas([], []) == (0, 0, 0)
    star = [ring((0, 0), (4, 4), (4, 0), (0, 4))]  # crosses itself
    assert areas.areas(star, [square(0, 0, 4)]) == pytest.approx((8, 16, 8))
    rng = random.Random(4)
    a, b = [ring(*[(rng.random(), rng.random()) for _ in range(7)])], [ring(*[(rng.random(), rng.random()) for _ in range(6)])]

    def inside(shape, x, y):
        return sum((p["y"] > y) != (q["y"] > y) and x < (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"]) + p["x"] for r in shape for p, q in zip(r, [*r[1:], r[0]])) % 2

    n, hits = 150, 0
    for i in range(n):
        for j in range(n):
            hits += inside(a, (i + 0.5) / n, (j + 0.5) / n) and inside(b, (i + 0.5) / n, (j + 0.5) / n)
    assert areas.areas(a, b)[2] == pytest.approx(hits / n / n, abs=0.01)


def test_shapes_that_touch_are_measured_exactly(spark):
    diamond = [ring((10, 0), (12, 2), (10, 4), (8, 2))]
    rows = [(1, diamond), (2, [square(11.5, 3, 2)]), (3, [square(11, 2, 1)]), (4, [square(20, 20, 1)]), (5, [square(21, 21, 1)]), (6, [square(9.9, 1.9, 0.2)]), (7, [])]
    df = spark.createDataFrame(rows, f"id long, shape {areas.SHAPE}")
    assert {tuple(r) for r in areas.close_shapes(df, 5.0).collect()} == {(1, 3), (2, 3), (4, 5), (1, 6)}
    assert {tuple(r) for r in areas.close_shapes(df, 5.0, 1.2).collect()} == {(1, 2), (1, 3), (2, 3), (4, 5), (1, 6), (3, 6)}
    study = spark.createDataFrame([([square(0, 0, 11.5)],), (None,)], f"shape {areas.SHAPE}")
    assert {r.id for r in areas.kept_in_area(df, study, 5.0).collect()} == {1, 2, 3, 6}


def test_repair_and_points(spark):
    rows = [(1, [ring((0, 0), (0, 0), (2, 0), (2, 2), (0, 2), (0, 0)), square(5, 5, 0.001)]), (2, [ring((0, 0), (1, 1))]), (3, None), (4, [square(0, 0, 4), square(1, 1, 2)])]
    df = spark.createDataFrame(rows, f"id long, shape {areas.SHAPE}").withColumn("good", areas.repaired(F.col("shape")))
    got = {r.id: r.good for r in df.collect()}
    assert len(got[1]) == 1 and len(got[1][0]) == 4 and got[2] is None and got[3] is None and len(got[4]) == 2
    p = {r.id: r.p for r in cut(df.where("good is not null"), "good").select("id", areas.inner_point(F.col("good")).alias("p")).collect()}
    assert (p[1].x, p[1].y) == (1.0, 1.0) and not (1 < p[4].x < 3 and 1 < p[4].y < 3)
    line = spark.createDataFrame([(ring((0, 0), (2, 0), (2, 6)),)], "l array<struct<x:double,y:double>>").select(areas.along(F.col("l"), 0.5).alias("m")).first().m
    assert (line.x, line.y) == (2.0, 2.0)


def test_shared_area_of_a_ring_that_is_not_convex(spark):
    ell = ring((0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4))
    df = spark.createDataFrame([(square(1, 1, 2), ell), (square(2, 2, 2), ell), (square(1, 1, 2), square(0, 0, 2))], "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    assert [round(r.s, 9) for r in df.select(geometry.shared_area(F.col("a"), F.col("b")).alias("s")).collect()] == [3.0, 0.0, 1.0]


def test_grid_tiles(spark):
    full = [(q, r) for q in range(5) for r in range(5)]
    one = lambda cells: areas.tiling(spark.createDataFrame(cells, "q int, r int"), 30.0, 1.0).first()
    a, b, c = one(full), one([x for x in full if x != (2, 2)]), one([*full, (0, 0)])
    assert (a.n, a.doubles, a.holes) == (25, 0, 0) and (b.doubles, b.holes) == (0, 1) and (c.doubles, c.holes) == (1, 0)


def test_conflicts_equal_the_plain_loop(spark):
    rng = random.Random(8)
    nodes = [(i, rng.randrange(30)) for i in range(80)]
    edges = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(160)}
    near = {i: {b if a == i else a for a, b in edges if i in (a, b)} for i, _ in nodes}
    kept, want = [], {}
    for i, _ in sorted(nodes, key=lambda n: (n[1], n[0])):
        hit = [k for k in kept if k in near[i]]
        want[i] = hit[0] if hit else None
        kept += [] if hit else [i]
    got = ranking.resolve_conflicts(spark.createDataFrame(nodes, "id long, rank long"), spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {r.id: r.lost_to for r in got.collect()} == want


def test_order_over_ranges(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), i, None if rng.random() < 0.1 else float(rng.randrange(20))) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    a = {(r.g, r.id): r.rank for r in ranking.rank_all(df, ["g"], "v", "id").collect()}
    b = {(r.g, r.id): r.rank for r in ranking.unique_rank(df, ["g"], "v", "id").collect()}
    assert a == b
    low = ranking.bounds(df, "v").first()
    q = df.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.95))).alias("q")).first().q
    assert (low.lo, low.hi) == pytest.approx(tuple(q))
    empty = ranking.bounds(df.limit(0), "v").first()
    assert empty.lo is None and empty.hi is None


def test_merged_records_and_growth(spark):
    cols = "cluster long, id long, name string, operator string, kind string, capacity double, fee string, access string, levels double, source_ids string, polygon boolean"
    rows = [(1, 1, None, "Op", "Unknown", 10.0, "no", "private", None, "w2;w1", True), (1, 2, "Lot", None, "Surface", 30.0, "yes", "Yes", 2.0, "n3", False), (2, 3, None, None, None, None, None, None, None, "w9", True), (3, 4, "A", None, "Garage", 5.0, None, None, None, "a", True), (3, 5, "B", None, "Garage", None, None, None, None, "b", True)]
    got = {r.cluster: r for r in graph.merged_records(spark.createDataFrame(rows, cols), "cluster", "id").collect()}
    a = got[1]
    assert (a.name, a.operator, a.kind, a.capacity, a.fee, a.access, a.levels, a.parts, a.source_ids) == ("Lot", "Op", "Surface", 40.0, "yes", "yes", 2.0, 2, "n3;w1;w2")
    assert got[2].kind == "Unknown" and got[2].capacity is None and got[3].capacity is None and got[3].name == "A"
    p = spark.createDataFrame([(1, "U"), (2, "U"), (3, "U"), (4, "V"), (5, ""), (6, "")], "id long, owner string")
    t = spark.createDataFrame([(1, 2), (2, 4), (4, 3), (5, 6)], "a long, b long")
    s = spark.createDataFrame([("x", 1), ("y", 5), ("z", 99)], "seed string, id long")
    assert {tuple(r) for r in graph.grown_sites(p, t, s).collect()} == {("x", 1), ("x", 2), ("y", 5)}


def test_sheds(spark):
    e = spark.createDataFrame([(1, 2, 3.0), (2, 3, 3.0), (3, 4, 3.0)], "a long, b long, w double")
    got = {tuple(r) for r in pipeline.walksheds_step(e, spark.createDataFrame([("s", 1)], "src string, node long"), [3.0, 6.0]).collect()}
    assert got == {("s", 3.0, 1, 2), ("s", 6.0, 1, 2), ("s", 6.0, 2, 3)}


def test_adapters(spark):
    d = spark.createDataFrame
    a, lost = adapters.jobs(d([("b1", "12", "7", "5"), ("b2", "3", "x", "0"), ("b9", "4", "4", "")], "w_geocode string, C000 string, CNS01 string, CNS02 string"), d([("b1", "26.0", "-123"), ("b2", "", "-1")], "tabblk2020 string, blklatdd string, blklondd string"), ["CNS01", "CNS02"])
    assert [(r.block, r.jobs, json.loads(r.sectors)) for r in a.collect()] == [("b1", 12, {"CNS01": 7, "CNS02": 5})] and tuple(lost.first()) == (2, 7)
    c = adapters.census(d([("g", "-666666666", "5"), ("h", None, "-1"), ("i", "4", "8")], "GEOID string, a string, b string"), {"t": ["a", "b"], "u": ["b"]}, {"r": ("t", "u")}).collect()
    assert [(r.t, r.u, r.r) for r in c] == [(5.0, 5.0, 1.0), (None, None, None), (12.0, 8.0, 1.5)]
    poi = d([("n1", {"amenity": "cafe", "shop": "x", "rooms": "12 rooms"}, 1.0, 2.0), ("n2", {"shop": "bakery"}, 1.0, 2.0), ("n3", {"note": "-"}, 1.0, 2.0)], "element_id string, properties map<string,string>, x double, y double")
    assert [(r.id, r.category, r.rooms) for r in adapters.points_of_interest(poi, ["amenity", "shop"]).collect()] == [("n1", "amenity=cafe", 12.0), ("n2", "shop=bakery", None)]
    lots = poi.select("element_id", F.create_map(F.lit("amenity"), F.lit("parking"), F.lit("levels"), F.lit("3"), F.lit("capacity"), F.lit("about 40")).alias("properties"), F.lit("Point").alias("geometry_type"), "x", "y", F.lit(None).alias("rings"))
    assert {(r.capacity, r.levels) for r in adapters.parking(lots).collect()} == {(40.0, 3.0)}
    f = adapters.floods(d([("Floodway", "T"), (None, "F"), ("x", None)], "ZONE_SUBTY string, SFHA_TF string")).collect()
    assert [(r.floodway, r.high_risk) for r in f] == [(True, True), (False, False), (False, False)]
    assert [r.listed for r in adapters.contaminated(d([("ACRES, X",), ("acre",), (None,)], "PGM_SYS_ACRNM string"), ["acres"]).collect()] == [True, False, False]
    assert [(r.metered, r.permit) for r in adapters.meters(d([("2 hr Meter",), ("permit only",), (None,)], "description string")).collect()] == [(True, False), (False, True), (False, False)]
    assert [(r.station, r.aadt) for r in adapters.traffic(d([("s", "5", "2020", "r"), ("s", "7", "2021", "r"), (None, "1", "2021", "r")], "STATION_ID string, AADT string, YEAR string, ROUTE string")).collect()] == [("s", 7.0)]
    u = adapters.institutions(d([("1",), ("2",)], "UNITID string"), d([("1", "1", "12000"), ("1", "2", "900")], "UNITID string, EFFYLEV string, EFYTOTLT string"), {"EFFYLEV": "1"})
    assert {(r.UNITID, r.enrolment) for r in u.collect()} == {("1", 12000.0), ("2", None)}
    with pytest.raises(ValueError, match="without a code"):
        adapters.overlays(d([("a",), ("z",)], "kind string"), {"a": "A"})
    assert [(r.tile, r.url) for r in adapters.rasters(d([("t", "u1", "2020"), ("t", "u2", "2021")], "tile string, url string, published string")).collect()] == [("t", "u2")]
    pl = d([("1", 0.9, ("Cafe",), ("food", ["x"]), "b"), ("2", 0.1, ("Y",), ("food", ["x"]), "b")], "id string, confidence double, names struct<primary:string>, categories struct<primary:string,alternate:array<string>>, brand string")
    assert [(r.place_id, r.name, r.category) for r in adapters.places(pl).collect()] == [("ovt:1", "Cafe", "food")]
    assert adapters.nested_as_text(pl.select("names", F.array(F.lit("a"), F.lit("b")).alias("l"))).first().l == "a;b"
    b = d([("1", "Polygon", "12", "3", None), ("1", "Polygon", None, "9", None), ("2", "Point", "1", "1", None)], "id string, geometry_type string, height string, num_floors string, rings string")
    assert [(r.id, r.height, r.levels) for r in adapters.buildings(b).collect()] == [("1", 12.0, 3)]


def test_texts_and_configuration(spark):
    one = spark.createDataFrame([("Weekday-Evening", "06", "http://h/q?Token=abc&x=1&key=z"), ("lunch", "3", None), (None, "99", "plain")], "t string, s string, u string")
    got = one.select(text.daypart(F.col("t")).alias("t"), text.state_abbr(F.col("s")).alias("s"), text.redact(F.col("u")).alias("u"), text.why([(F.col("t").isNotNull(), F.lit("told")), (F.col("s") == "06", F.lit("six"))]).alias("w")).collect()
    assert [tuple(r) for r in got] == [("wd_eve", "CA", "http://h/q?Token=***&x=1&key=***", "told; six"), (None, None, None, "told"), (None, None, "plain", "")]
    rules.checked_config({"w": {"a": 0.5, "b": 0.5}}, {"bands": [1, 2]}, {"k": ({"a"}, {"a"})})
    with pytest.raises(ValueError, match="w adds up to 0.9; bands does not ascend; k has"):
        rules.checked_config({"w": {"a": 0.4, "b": 0.5}}, {"bands": [2, 2]}, {"k": ({"a"}, {"b"})})


def test_check_records_gate_and_registry(spark, tmp_path):
    layer = schema.Layer("plots", (schema.Column("pid", "TEXT", nullable=False, unique=True), schema.Column("kind", "TEXT", codes=("a",))))
    spark.createDataFrame([("1", "a"), ("1", "z"), (None, None)], "pid string, kind string").createOrReplaceTempView("plots")
    records = schema.check_records(schema.run_checks(spark, schema.checks([layer])), "r1", {"domain": "warning"})
    assert {r.kind: (r.checks, r.failed, r["rows"]) for r in schema.summary(records).collect()} == {"domain": (1, 1, 1), "unique": (1, 1, 1), "required": (1, 1, 1)}
    failed = schema.write_checks(records, str(tmp_path / "checks"))
    assert failed == 2 and schema.write_checks(records, str(tmp_path / "checks")) == 2 and spark.read.parquet(str(tmp_path / "checks")).count() == 3
    with pytest.raises(schema.Violations):
        schema.gate(failed)
    schema.gate(0)
    x, y = spark.range(3).toDF("a"), spark.range(1, 4).toDF("a")
    assert schema.same_result("q", x, y).first().n == 2 and schema.same_result("q", x, x).first().n == 0
    root = str(tmp_path / "store")
    assert schema.catalogue_difference(spark, root, [layer]) == ["plots was never written"]
    schema.register(spark, root, layer, "r1", 3)
    assert schema.catalogue_difference(spark, root, [layer]) == [] and schema.empty_layers(spark, [layer])["plots"].count() == 0
    wider = schema.Layer("plots", (*layer.columns, schema.Column("area", "REAL")))
    assert schema.catalogue_difference(spark, root, [wider]) == ["plots: area is only in the first"]


def test_backtest(spark):
    obs = [(f"L{i}", "wd_day", i, 10) for i in range(1, 6)] + [("L1", "we_day", 4, 10), ("L1", "we_day", 6, 10)]
    model = [(f"L{i}", "wd_day", i / 8) for i in range(1, 6)] + [("L1", "we_day", 9.0)]
    o, m = spark.createDataFrame(obs, "lot string, daypart string, occupied long, total long"), spark.createDataFrame(model, "lot string, daypart string, ratio double")
    rows, report = pipeline.backtest(o, m)
    r = {x.daypart: x for x in report.collect()}
    assert r["wd_day"].n == 5 and r["wd_day"].rho == pytest.approx(1.0) and r["we_day"].rho is None and r["we_day"].mae == pytest.approx(0.5)
    with pytest.raises(ValueError, match="1 impossible"):
        pipeline.backtest(o.unionByName(spark.createDataFrame([("L9", "wd_day", 11, 10)], o.schema)), m)
    e = pipeline.market_evidence(spark.createDataFrame([("a", 0.9), ("b", 0.6)], "area string, peak double"), 0.85).collect()
    assert [(x.status, x.over) for x in e] == [("at or above", 0.05), ("below", -0.25)]


def test_pipeline_from_tables_to_report(spark, tmp_path):
    root = str(tmp_path)
    put = lambda name, rows, cols: spark.createDataFrame(rows, cols).write.parquet(f"{root}/{name}")
    cells = [(q * 10 + r, q, r) for q in range(4) for r in range(4)]
    put("cells", cells, "cell long, q int, r int")
    put("anchors", [(1, "shop", 100.0, 0), (2, "shop", 300.0, 1), (3, "park", 5.0, 33), (4, "shop", 50.0, None)], "anchor long, category string, size double, cell long")
    put("rates", [("shop", p, 1.0) for p in ("day", "eve")], "category string, daypart string, rate double")
    put("reach", [(c, c, 1.0) for c, _, _ in cells] + [(0, 1, 4.0)], "src long, cell long, minutes double")
    put("facilities", [(1, 1, "A", None, "Surface", 20.0, None, "yes", None, "s1", True, 0.0), (2, 1, "A", None, "Unknown", None, None, None, None, "s2", False, 0.0), (3, 33, "P", None, "Surface", 50.0, None, "private", None, "s3", True, 9.0)], "id long, cell long, name string, operator string, kind string, capacity double, fee string, access string, levels double, source_ids string, polygon boolean, area double")
    put("clusters", [(1, 1), (2, 1)], "id long, cluster long")
    put("edges", [(1, 2, 3.0), (2, 3, 3.0)], "a long, b long, w double")
    put("sources", [("z", 1)], "src string, node long")
    put("sites", [(i, i % 2, 100.0 * i, float(i), [square(i * 3, 0, 4 if i == 3 else 2)]) for i in range(1, 6)], f"id long, cell long, lot_area double, price double, shape {areas.SHAPE}")
    put("weights", [("main", "price", 0.6), ("main", "lot_area", 0.4), ("other", "price", 1.0), ("other", "lot_area", 0.0)], "scenario string, criterion string, weight double")
    config = {"dayparts": ["day", "eve"], "stall_area": 325.0, "efficiency": 0.85, "least_gap": 50.0, "short_dayparts": 2, "zone_cells": 2, "least_area": 150.0, "criteria": {"price": True, "lot_area": False}, "main": "main", "bin": 5.0, "draws": 20, "top": 2, "bands": [3.0, 6.0]}
    flow = pipeline.pipeline(spark, root)
    assert set(flow.run(config).values()) == {"done"}
    read = lambda name: spark.read.parquet(f"{root}/{name}")
    gap = {(r.cell, r.daypart): r.gap for r in read("gap").collect()}
    assert gap[(0, "day")] == pytest.approx(62.5) and gap[(1, "day")] == pytest.approx(300 + 37.5 - 20) and (33, "day") not in gap
    assert {(r.cell, r.zone) for r in read("zones").collect()} == {(0, 0), (1, 0)}
    assert {r.id: r.status for r in read("screened").collect()} == {1: "Fail", 2: "Pass", 3: "Pass", 4: "Pass", 5: "Pass"}
    ranked = {r.id: (r["rank"], r.superseded_by) for r in read("suitability").where("scenario = 'main'").collect()}
    assert sorted(x[0] for x in ranked.values()) == [1, 2, 3, 4] and ranked[4][1] in (None, 3) and (ranked[3][1] == 4) != (ranked[4][1] == 3)
    numbers = json.loads(spark.read.text(f"{root}/report").first()[0])
    assert numbers["gap"] == 4 and numbers["sensitivity"] == 4 and numbers["walksheds"] == 3
    again = pipeline.pipeline(spark, root)
    again.status, again.hashes = dict(flow.status), dict(flow.hashes)
    assert set(again.run(config).values()) == {"unchanged"}
    again.run(config | {"least_gap": 60.0}, ["zones"])
    assert again.status["zones"] == "done" and again.status["screen"] == again.status["suitability"] == again.status["report"] == "stale" and again.status["walksheds"] == "unchanged"


def test_steps_of_other_types_are_no_rows(spark):
    e = spark.createDataFrame([], T.StructType.fromDDL("id long, p_size int"))
    assert pipeline.screen_step(e, [(F.col("p_size") < 1, "x")], []).count() == 0
    assert geometry.hex_neighbours(spark.createDataFrame([], "q int, r int")).count() == 0


def test_grid_without_holes(spark):
    ring_ = [(q, r) for q in range(-2, 3) for r in range(-2, 3) if max(abs(q), abs(r), abs(q + r)) == 2]
    df = spark.createDataFrame([*ring_, (9, 9)], "q int, r int")
    got = {tuple(r) for r in geometry.without_holes(df).collect()}
    assert got == {*ring_, (9, 9)} | {(q, r) for q in range(-1, 2) for r in range(-1, 2) if abs(q + r) <= 1}
    assert geometry.without_holes(df.limit(0)).count() == 0


def test_survey_sample(spark):
    rows = [(i, "s" if i < 12 else "t", i % 4 == 0, float(100 - i), float(i), 0.0) for i in range(16)] + [(90, "s", False, 500.0, None, None)]
    p = spark.createDataFrame(rows, "id long, stratum string, garage boolean, score double, x double, y double")
    strata = spark.createDataFrame([("s", 4, 1), ("t", 1, 1)], "stratum string, n int, garages int")
    manual = spark.createDataFrame([("s", 15)], "stratum string, id long")
    got = {(r.stratum, r.id): (r.role, r["rank"]) for r in ranking.survey_sample(p, strata, manual, 2.0, 2).collect()}
    want = {}
    for s_, n, g in (("s", 4, 1), ("t", 1, 1)):
        chosen = [next(r for r in rows if r[0] == 15)] if s_ == "s" else []
        pool = sorted([r for r in rows if r[1] == s_], key=lambda r: (-r[3], r[0]))
        for cands, limit in (([r for r in pool if r[2]], g), ([r for r in pool if not r[2]], n), (pool, n + 2)):
            for r in cands:
                if len(chosen) < limit and r not in chosen and all(r[4] is None or c[4] is None or abs(r[4] - c[4]) >= 2 for c in chosen):
                    chosen.append(r)
        want |= {(s_, r[0]): ("sample", k + 1) if k < n else ("backup", k + 1 - n) for k, r in enumerate(chosen)}
    assert got == want


def test_readers_split_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\n1,2,3\n2,,3\n")
    assert readers.read_csv(spark, str(tmp_path / "a.csv"), False, "x", "y").first().x == 2.0 and readers.read_csv(spark, str(tmp_path / "a.csv"), False, "x", "y").count() == 1
    with pytest.raises(ValueError, match="no such columns"):
        readers.read_csv(spark, str(tmp_path / "a.csv"), False, "x", "z")
    one = {"type": "Feature", "properties": {"k": "v"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 2]]}}
    (tmp_path / "l.json").write_text(json.dumps(one) + "\n" + json.dumps(one | {"geometry": {"type": "Point", "coordinates": [5, 6]}}) + "\n")
    got = {r.geometry_type: r for r in readers.read_geojson(spark, str(tmp_path / "l.json"), per_line=True).collect()}
    assert [(p.x, p.y) for p in got["LineString"].lines[0]] == [(0.0, 0.0), (1.0, 2.0)] and got["Point"].x == 5.0 and got["Point"].lines is None
    df = spark.createDataFrame([(1, "b", {"m": 1}), (1, "a", {"m": 2}), (2, None, None)], "id long, v string, m map<string,int>")
    src = readers.Source("S", "p", {"id": "id", "v": "v", "m": "m"}, "id", order=("v",))
    assert {(r.id, r.v) for r in src.standard(df).collect()} == {(1, "a"), (2, None)}
    layer = spark.createDataFrame([(1, (0.0, 0.0, 1.0, 1.0)), (2, (5.0, 5.0, 6.0, 6.0))], "id long, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    layer.write.parquet(str(tmp_path / "layer"))
    assert [r.id for r in readers.read_layer(spark, str(tmp_path / "layer"), layer.schema, ["id"], F.col("id") > 0, (4.0, 4.0, 9.0, 9.0)).collect()] == [2]
    assert readers.read_layer(spark, str(tmp_path / "none"), layer.schema, ["id"]).count() == 0


def test_shape_report(spark):
    df = spark.createDataFrame([(1, [square(0, 0, 1)]), (1, [square(0, 0, 1)]), (2, None), (3, [ring((9, 9), (9, 9), (10, 9), (10, 10))])], f"id long, shape {areas.SHAPE}")
    study = spark.createDataFrame([([square(0, 0, 2)],)], f"shape {areas.SHAPE}")
    assert tuple(areas.shape_report(df, study, 5.0).first()) == (4, 1, 1, 1, 1)
