"""Queries of the siting pipeline: demand, supply, gaps, zones, screening, scoring, networks, grids and geometry.

Over the star-schema tables nations stand for cells, regions for districts, customers for demand,
suppliers for supply, parts for candidate sites and order priorities for the five times of the week.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgrid.functions import text, units
from lotgrid.operators import aggregates, areas, geometry, graph, ranking
from lotgrid.session import cut, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PARTS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
WEIGHTS = {"Balanced": {"price": 0.5, "size": 0.3, "use": 0.2}, "Low cost": {"price": 0.8, "size": 0.1, "use": 0.1}, "High use": {"price": 0.2, "size": 0.2, "use": 0.6}}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def gap_table(s: SparkSession, d: str) -> DataFrame:
    """cell, daypart, demand, supply, gap: a union and one aggregation in place of a full outer join.

    Line items are summed per order (and per supplier) before they meet the small tables.
    """
    li = table(s, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("daypart"))
    sold = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    per = sold.groupBy("o_custkey", "l_suppkey", "daypart").agg(F.sum("l_quantity").alias("q"))
    need = per.join(table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cell")), F.col("o_custkey") == F.col("c_custkey")).select("cell", "daypart", F.col("q").alias("demand"), F.lit(0.0).alias("supply"))
    have = per.join(table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell")), F.col("l_suppkey") == F.col("s_suppkey")).select("cell", "daypart", F.lit(0.0).alias("demand"), F.col("q").alias("supply"))
    out = need.unionByName(have).groupBy("cell", "daypart").agg(F.sum("demand").alias("demand"), F.sum("supply").alias("supply"))
    return out.withColumn("gap", F.col("demand") - F.col("supply"))


GAP = """WITH need AS (SELECT c_nationkey AS cell, o_orderpriority AS daypart, sum(l_quantity) AS demand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
have AS (SELECT s_nationkey AS cell, o_orderpriority AS daypart, sum(l_quantity) AS supply FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
gap AS (SELECT cell, daypart, coalesce(demand, 0.0) AS demand, coalesce(supply, 0.0) AS supply, coalesce(demand, 0.0) - coalesce(supply, 0.0) AS gap FROM need FULL JOIN have USING (cell, daypart))
"""


@query(GAP + "SELECT cell, daypart, demand, supply, gap FROM gap")
def gap_by_daypart(s: SparkSession, d: str) -> DataFrame:
    return gap_table(s, d)


@query(GAP + "SELECT cell, daypart, CASE WHEN supply > 0 THEN round(demand / supply, 6) END AS ratio FROM gap")
def gap_ratio(s: SparkSession, d: str) -> DataFrame:
    return gap_table(s, d).select("cell", "daypart", F.when(F.col("supply") > 0, F.round(F.col("demand") / F.col("supply"), 6)).alias("ratio"))


def hot_cells(s: SparkSession, d: str) -> DataFrame:
    n = F.count_if((F.col("gap") > 0) & F.col("daypart").isin("1-URGENT", "2-HIGH", "3-MEDIUM"))
    return gap_table(s, d).groupBy("cell").agg(n.alias("n"), F.sum(F.when(F.col("gap") > 0, F.col("gap"))).alias("short")).where("n >= 2")


@query(GAP + "SELECT cell, count(*) FILTER (gap > 0 AND daypart IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) AS n, sum(gap) FILTER (gap > 0) AS short FROM gap GROUP BY 1 HAVING count(*) FILTER (gap > 0 AND daypart IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) >= 2")
def hot_zone(s: SparkSession, d: str) -> DataFrame:
    return hot_cells(s, d)


@query(GAP + ", hot AS (SELECT cell FROM gap GROUP BY 1 HAVING count(*) FILTER (gap > 0 AND daypart IN ('1-URGENT', '2-HIGH', '3-MEDIUM')) >= 2), marked AS (SELECT cell, cell - row_number() OVER (ORDER BY cell) AS g FROM hot) SELECT cell, min(cell) OVER (PARTITION BY g) AS component FROM marked")
def zone_components(s: SparkSession, d: str) -> DataFrame:
    cells = hot_cells(s, d).select(F.col("cell").cast("long").alias("id"))
    ids = cells.select(F.col("id").alias("a"))
    edges = ids.withColumn("b", F.col("a") + 1).join(cells.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    return graph.components(cells, edges).select(F.col("id").cast("int").alias("cell"), F.col("component").cast("int").alias("component"))


@query(GAP + "SELECT region, max(short) AS worst, count(*) AS cells, max_by(cell, (short, -cell)) AS top_cell FROM (SELECT n_regionkey AS region, cell, sum(gap) FILTER (gap > 0) AS short FROM gap JOIN nation ON cell = n_nationkey GROUP BY 1, 2) WHERE short IS NOT NULL GROUP BY 1")
def district_shortage(s: SparkSession, d: str) -> DataFrame:
    short = gap_table(s, d).groupBy("cell").agg(F.sum(F.when(F.col("gap") > 0, F.col("gap"))).alias("short")).where("short is not null")
    n = table(s, d, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("region"))
    return short.join(F.broadcast(n), "cell").groupBy("region").agg(F.max("short").alias("worst"), F.count("*").alias("cells"), F.max_by("cell", F.struct("short", (-F.col("cell")).alias("k"))).alias("top_cell"))


@query("SELECT c_mktsegment AS category, o_orderpriority AS daypart, sum(o_orderkey % 100)::BIGINT AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY GROUPING SETS ((c_mktsegment, o_orderpriority), (o_orderpriority), ())")
def demand_totals(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("category")), F.col("o_custkey") == F.col("c_custkey")).select("category", F.col("o_orderpriority").alias("daypart"), (F.col("o_orderkey") % 100).alias("v"))
    return o.groupingSets([["category", "daypart"], ["daypart"], []], "category", "daypart").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query("WITH r(seg, part, rate) AS (VALUES ('BUILDING', 'day', 0.5), ('BUILDING', 'night', 0.1), ('MACHINERY', 'day', 0.3), ('MACHINERY', 'night', 0.2)) SELECT c_custkey, part, round(greatest(c_acctbal, 0) * rate * 0.9, 4) AS stalls FROM customer JOIN r ON c_mktsegment = seg")
def demand_rates(s: SparkSession, d: str) -> DataFrame:
    wide = s.createDataFrame([("BUILDING", 0.5, 0.1), ("MACHINERY", 0.3, 0.2)], "seg string, day double, night double")
    rates = wide.unpivot(["seg"], ["day", "night"], "part", "rate")
    c = table(s, d, "customer").join(F.broadcast(rates), F.col("c_mktsegment") == F.col("seg"))
    return c.select("c_custkey", "part", F.round(F.greatest(F.col("c_acctbal"), F.lit(0.0)) * F.col("rate") * 0.9, 4).alias("stalls"))


@query("""WITH reach AS (SELECT c_custkey AS src, (c_nationkey + k) % 25 AS cell, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.6 ELSE 0.25 END::DOUBLE AS w FROM customer, (VALUES (0), (1), (2)) t(k) WHERE c_custkey % 10 <> 0),
share AS (SELECT src, cell, w / sum(w) OVER (PARTITION BY src) AS share FROM reach)
SELECT cell, round(sum(v), 4) AS v FROM (SELECT cell, share * (c_custkey % 50) AS v FROM share JOIN customer ON src = c_custkey UNION ALL SELECT c_nationkey, c_custkey % 50 FROM customer WHERE c_custkey % 10 = 0) GROUP BY 1""")
def allocation_conserving(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer")
    values = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").cast("long").alias("own_cell"), (F.col("c_custkey") % 50).cast("double").alias("v"))
    hops = F.posexplode(F.array(F.lit(2.0), F.lit(4.5), F.lit(7.0))).alias("k", "minutes")
    reach = c.where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("src"), "c_nationkey", hops).select("src", ((F.col("c_nationkey") + F.col("k")) % 25).cast("long").alias("cell"), "minutes")
    return graph.allocate(values, reach).select(F.col("cell").cast("int").alias("cell"), F.round("v", 4).alias("v"))


def ring_edges(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("a"))
    near = n.select("a", ((F.col("a") + 1) % 25).alias("b"), (F.col("a") % 3 + 1).cast("double").alias("w"))
    return graph.undirected(near.unionByName(n.select("a", ((F.col("a") + 7) % 25).alias("b"), F.lit(9.0).alias("w"))))


RING = """WITH RECURSIVE e0 AS (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b, (n_nationkey % 3 + 1)::DOUBLE AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25, 9.0 FROM nation),
e AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM e0 UNION ALL SELECT b, a, w FROM e0) GROUP BY 1, 2),
walk(src, node, cost) AS (SELECT n_nationkey, n_nationkey, 0.0::DOUBLE FROM nation WHERE n_nationkey % 5 = 0 UNION SELECT src, b, cost + w FROM walk JOIN e ON node = a WHERE cost + w <= 10),
reach AS (SELECT src, node, min(cost) AS cost FROM walk GROUP BY 1, 2) """


@query(RING + "SELECT src, node, cost FROM reach")
def bounded_reach(s: SparkSession, d: str) -> DataFrame:
    src = table(s, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_nationkey").cast("long").alias("node"))
    return graph.bounded_reach(ring_edges(s, d), src, 10.0).select(F.col("src").cast("int").alias("src"), F.col("node").cast("int").alias("node"), "cost")


@query(RING + "SELECT node, arg_min(src, (cost, src)) AS src, min(cost) AS cost FROM reach GROUP BY 1")
def nearest_source(s: SparkSession, d: str) -> DataFrame:
    return graph.nearest_source(bounded_reach(s, d)).select("node", "src", "cost")


@query(RING + "SELECT src, round(sum(q)::DOUBLE, 4) AS weighted FROM (SELECT src, CASE WHEN cost <= 3 THEN 1.0 WHEN cost <= 5 THEN 0.6 WHEN cost <= 8 THEN 0.25 ELSE 0 END * (SELECT count(*) FROM customer WHERE c_nationkey = node) AS q FROM reach) GROUP BY 1")
def reach_weighted_demand(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("n"))
    r = bounded_reach(s, d).join(n, "node")
    return r.groupBy("src").agg(F.round(F.sum(units.band_weight(F.col("cost")) * F.col("n")), 4).alias("weighted"))


@query("SELECT max(n)::DOUBLE / sum(n) AS share FROM (SELECT s_nationkey % 4 AS g, count(*) AS n FROM supplier GROUP BY 1)")
def largest_component_share(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 4).alias("g"))
    first = n.groupBy("g").agg(F.min("id").alias("b"))
    edges = n.join(first, "g").select(F.col("id").alias("a"), "b").where("a <> b")
    return graph.largest_component_share(graph.components(n.select("id"), edges))


@query(None)
def dedupe_components(s: SparkSession, d: str) -> DataFrame:
    """Rows only: an order-dependent merge of places close to each other; tests hold it against a plain union-find."""
    k = F.col("s_suppkey")
    p = table(s, d, "supplier").select("s_suppkey", F.when(k % 3 > 0, k % 3).alias("kind"))
    near = geometry.within_radius(sites(s, d, "id_a"), sites(s, d, "id_b"), 9.0).where("id_a < id_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    labels = graph.components(p.select(k.alias("id")), near)
    group = labels.select(F.col("id").alias("s_suppkey"), "component")
    pairs = near.join(group.select(F.col("s_suppkey").alias("a"), F.col("component").alias("g")), "a").select("g", "a", "b")
    return graph.constrained_merge(p.join(group, "s_suppkey").select("s_suppkey", "kind", F.col("component").alias("g")), pairs, "g", "s_suppkey", ["kind"])


# scores


def scores(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    use = table(s, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"))
    p = p.join(use, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", "p_retailprice", "p_size", F.coalesce("q", F.lit(0.0)).alias("q"))
    p = ranking.normalise_all(cut(p, "parts"), {"price": ("p_retailprice", True), "size": ("p_size", False), "use": ("q", False)})
    return p.select(F.col("p_partkey").alias("id"), "price", "size", "use").unpivot(["id"], ["price", "size", "use"], "criterion", "score")


NORM = """WITH base AS (SELECT p_partkey, p_retailprice, p_size::DOUBLE AS p_size, coalesce(q, 0.0) AS q FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON p_partkey = l_partkey),
b AS (SELECT quantile_cont(p_retailprice, 0.05) AS p5, quantile_cont(p_retailprice, 0.95) AS p95, quantile_cont(p_size, 0.05) AS s5, quantile_cont(p_size, 0.95) AS s95, quantile_cont(q, 0.05) AS q5, quantile_cont(q, 0.95) AS q95 FROM base),
sc AS (SELECT p_partkey AS id, 100 - (least(greatest(p_retailprice, p5), p95) - p5) / (p95 - p5) * 100 AS price, (least(greatest(p_size, s5), s95) - s5) / (s95 - s5) * 100 AS size, (least(greatest(q, q5), q95) - q5) / (q95 - q5) * 100 AS use FROM base, b)
"""


@query(NORM + "SELECT id, 'price' AS criterion, round(price, 6) AS score FROM sc UNION ALL SELECT id, 'size', round(size, 6) FROM sc UNION ALL SELECT id, 'use', round(use, 6) FROM sc")
def normalise_criteria(s: SparkSession, d: str) -> DataFrame:
    return scores(s, d).select("id", "criterion", F.round("score", 6).alias("score"))


def scenario_weights(s: SparkSession) -> DataFrame:
    return s.createDataFrame([(n, c, w) for n, ws in WEIGHTS.items() for c, w in ws.items()], "scenario string, criterion string, weight double")


COMPOSITE = NORM + """, w(scenario, wp, ws, wu) AS (VALUES ('Balanced', 0.5, 0.3, 0.2), ('Low cost', 0.8, 0.1, 0.1), ('High use', 0.2, 0.2, 0.6)),
comp AS (SELECT scenario, id, round(price * wp::DOUBLE + size * ws::DOUBLE + use * wu::DOUBLE, 6) AS composite FROM sc, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY composite DESC, id) AS rank FROM comp)
"""


def ranked(s: SparkSession, d: str) -> DataFrame:
    c = ranking.composite(scores(s, d), scenario_weights(s)).withColumn("composite", F.round("composite", 6))
    return ranking.rank_all(c, ["scenario"], "composite", "id")


@query(COMPOSITE + "SELECT scenario, id, composite, rank FROM ranked WHERE rank <= 50")
def composite_rank(s: SparkSession, d: str) -> DataFrame:
    return ranked(s, d).where("rank <= 50").select("scenario", "id", "composite", "rank")


@query(COMPOSITE + "SELECT id, max(rank) FILTER (scenario = 'Balanced') AS balanced, max(rank) FILTER (scenario = 'Low cost') AS low_cost, max(rank) FILTER (scenario = 'High use') AS high_use, bool_and(rank <= 100) AS robust FROM ranked GROUP BY 1")
def scenario_pivot(s: SparkSession, d: str) -> DataFrame:
    r = lambda n: F.max(F.when(F.col("scenario") == n, F.col("rank")))
    return ranked(s, d).groupBy("id").agg(r("Balanced").alias("balanced"), r("Low cost").alias("low_cost"), r("High use").alias("high_use"), F.bool_and(F.col("rank") <= 100).alias("robust"))


OAT_ROWS = [(n, {c: w for n2, c, w in ranking.one_at_a_time(WEIGHTS["Balanced"], (0.8, 1.2)) if n2 == n}) for n in dict.fromkeys(r[0] for r in ranking.one_at_a_time(WEIGHTS["Balanced"], (0.8, 1.2)))]


@query(NORM + ", w(scenario, wp, ws, wu) AS (VALUES " + ", ".join(f"('{n}', {w['price']!r}::DOUBLE, {w['size']!r}::DOUBLE, {w['use']!r}::DOUBLE)" for n, w in OAT_ROWS) + "), r AS (SELECT scenario, id, row_number() OVER (PARTITION BY scenario ORDER BY round(price * wp + size * ws + use * wu, 6) DESC, id) AS rank FROM sc, w) SELECT id, min(rank) AS best, max(rank) AS worst FROM r GROUP BY 1")
def oat_sensitivity(s: SparkSession, d: str) -> DataFrame:
    w = s.createDataFrame(ranking.one_at_a_time(WEIGHTS["Balanced"], (0.8, 1.2)), "scenario string, criterion string, weight double")
    c = ranking.composite(scores(s, d), w).withColumn("composite", F.round("composite", 6))
    return ranking.rank_all(c, ["scenario"], "composite", "id").groupBy("id").agg(F.min("rank").alias("best"), F.max("rank").alias("worst"))


@query(None)
def dirichlet_stability(s: SparkSession, d: str) -> DataFrame:
    """Rows only: the weights are drawn by a seeded generator; tests check that they repeat and add up."""
    w = ranking.drawn_weights(s, WEIGHTS["Balanced"], 100, 50.0, 7)
    top = scores(s, d)
    c = ranking.composite(top, w).withColumn("composite", F.round("composite", 6))
    return ranking.rank_stability(ranking.rank_all(c, ["scenario"], "composite", "id"), 10)


# places


def boxes(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "part").select(c("p_partkey").alias("id"), geometry.box((c("p_partkey") % 50) * 10, F.floor(c("p_partkey") / 50) * 10, 4 + c("p_size") % 13, 5 + c("p_size") % 9).alias("ring"), (4 + c("p_size") % 13).alias("w"), (5 + c("p_size") % 9).alias("h"))


BOXES = "WITH bx AS (SELECT p_partkey AS id, (p_partkey % 50) * 10 AS x0, (p_partkey // 50) * 10 AS y0, (p_partkey % 50) * 10 + 4 + p_size % 13 AS x1, (p_partkey // 50) * 10 + 5 + p_size % 9 AS y1 FROM part) "


@query(BOXES + "SELECT id, CASE WHEN id % 2 = 0 THEN (x1 - x0) * (y1 - y0) ELSE (x1 - x0) * (y1 - y0) / 2.0 END::DOUBLE AS area, round(CASE WHEN id % 2 = 0 THEN 2 * (x1 - x0 + y1 - y0) ELSE x1 - x0 + y1 - y0 + sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) END, 6)::DOUBLE AS length, round(CASE WHEN id % 2 = 0 THEN (x0 + x1) / 2.0 ELSE (x0 + 2.0 * x1) / 3 END, 6)::DOUBLE AS cx, round(CASE WHEN id % 2 = 0 THEN (y0 + y1) / 2.0 ELSE (2.0 * y0 + y1) / 3 END, 6)::DOUBLE AS cy, CASE WHEN id % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS rect FROM bx")
def ring_measures(s: SparkSession, d: str) -> DataFrame:
    r = F.when(F.col("id") % 2 == 0, F.col("ring")).otherwise(F.slice("ring", 1, 3))  # every other one a right-angled triangle
    c = geometry.centroid(r)
    return boxes(s, d).select("id", geometry.area(r).alias("area"), F.round(geometry.perimeter(r), 6).alias("length"), F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(geometry.rectangularity(r), 6).alias("rect"))


@query(BOXES + "SELECT a.id AS id_a, b.id AS id_b, ((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)))::DOUBLE AS shared FROM bx a JOIN bx b ON a.id < b.id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1")
def overlap_pairs(s: SparkSession, d: str) -> DataFrame:
    b = boxes(s, d)
    return geometry.overlaps(b.select(F.col("id").alias("id_a"), F.col("ring").alias("ring_a")), b.select(F.col("id").alias("id_b"), F.col("ring").alias("ring_b")), 20.0).where("id_a < id_b").select("id_a", "id_b", F.round("shared", 6).alias("shared"))


def zones(s: SparkSession) -> DataFrame:
    return s.range(0, 25).select(F.col("id").alias("id_b"), geometry.box((F.col("id") % 5) * 100 + 3, F.floor(F.col("id") / 5) * 100 + 3, F.lit(94), F.lit(90)).alias("ring_b"))


ZONES = BOXES + ", z AS (SELECT k AS id_b, (k % 5) * 100 + 3 AS x0, (k // 5) * 100 + 3 AS y0, (k % 5) * 100 + 97 AS x1, (k // 5) * 100 + 93 AS y1 FROM range(25) t(k)), cut AS (SELECT b.id AS id_a, z.id_b, ((least(b.x1, z.x1) - greatest(b.x0, z.x0)) * (least(b.y1, z.y1) - greatest(b.y0, z.y0)))::DOUBLE AS shared FROM bx b JOIN z ON b.x0 < z.x1 AND z.x0 < b.x1 AND b.y0 < z.y1 AND z.y0 < b.y1) "


@query(ZONES + "SELECT id AS id_a, coalesce(sum(shared), 0)::DOUBLE AS covered FROM bx LEFT JOIN cut ON id = id_a GROUP BY 1")
def covered_area(s: SparkSession, d: str) -> DataFrame:
    a = boxes(s, d).select(F.col("id").alias("id_a"), F.col("ring").alias("ring_a"))
    return geometry.covered_area(a, zones(s), 100.0).select("id_a", F.round("covered", 6).alias("covered"))


@query(ZONES + "SELECT id_a, arg_max(id_b, (shared, -id_b)) AS id_b FROM cut GROUP BY 1")
def largest_overlap(s: SparkSession, d: str) -> DataFrame:
    a = boxes(s, d).select(F.col("id").alias("id_a"), F.col("ring").alias("ring_a"))
    return geometry.largest_overlap(a, zones(s), 100.0)


@query(BOXES + "SELECT b.id AS id_p, z.k AS zone FROM bx b JOIN range(25) z(k) ON b.x0 + 0.5 > (k % 5) * 100 + 3 AND b.x0 + 0.5 < (k % 5) * 100 + 97 AND b.y0 + 0.5 > (k // 5) * 100 + 3 AND b.y0 + 0.5 < (k // 5) * 100 + 93")
def point_in_zone(s: SparkSession, d: str) -> DataFrame:
    p = boxes(s, d).select(F.col("id").alias("id_p"), (F.col("ring")[0]["x"] + 0.5).alias("x"), (F.col("ring")[0]["y"] + 0.5).alias("y"))
    bins = geometry.with_bins(zones(s), "ring_b", 100.0).select(F.col("id_b").alias("zone"), "ring_b", "bx", "by")
    return p.withColumns({"bx": F.floor(F.col("x") / 100.0), "by": F.floor(F.col("y") / 100.0)}).join(bins, ["bx", "by"]).where(geometry.contains(F.col("ring_b"), F.col("x"), F.col("y"))).select("id_p", "zone")


def sites(s: SparkSession, d: str, name: str) -> DataFrame:
    return table(s, d, "supplier").select(F.col("s_suppkey").alias(name), (F.col("s_suppkey") * 37 % 211).cast("double").alias("x"), (F.col("s_suppkey") * 53 % 197).cast("double").alias("y"))


def anchors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("id_a"), (F.col("c_custkey") * 17 % 211).cast("double").alias("x"), (F.col("c_custkey") * 29 % 197).cast("double").alias("y"))


PLACES = "WITH st AS (SELECT s_suppkey AS id_b, s_suppkey * 37 % 211 AS x, s_suppkey * 53 % 197 AS y FROM supplier), an AS (SELECT c_custkey AS id_a, c_custkey * 17 % 211 AS x, c_custkey * 29 % 197 AS y FROM customer), dd AS (SELECT id_a, id_b, sqrt((an.x - st.x) * (an.x - st.x) + (an.y - st.y) * (an.y - st.y)) AS dist FROM an, st) "


@query(PLACES + "SELECT id_a, id_b, round(dist, 6) AS dist FROM dd WHERE dist <= 15")
def radius_join(s: SparkSession, d: str) -> DataFrame:
    return geometry.within_radius(anchors(s, d), sites(s, d, "id_b"), 15.0).select("id_a", "id_b", F.round("dist", 6).alias("dist"))


@query(PLACES + "SELECT id_a, arg_min(id_b, (dist, id_b)) AS id_b, round(min(dist), 6) AS dist FROM dd GROUP BY 1")
def nearest_join(s: SparkSession, d: str) -> DataFrame:
    return geometry.nearest(anchors(s, d), sites(s, d, "id_b"), 10.0).select("id_a", "id_b", F.round("dist", 6).alias("dist"))


@query(PLACES + "SELECT id_a, round(sum(id_b / (dist * dist)) / sum(1 / (dist * dist)), 3) AS rate FROM dd WHERE dist <= 40 AND dist > 0 GROUP BY 1")
def distance_weighted_rate(s: SparkSession, d: str) -> DataFrame:
    known = sites(s, d, "id_b").withColumn("value", F.col("id_b").cast("double"))
    return geometry.weighted_by_distance(anchors(s, d), known, 40.0).select("id_a", F.round("value", 3).alias("rate"))


@query(PLACES + ", h AS (SELECT a.id_b, sum(b.id_b / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) / sum(1 / ((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS v FROM st a, st b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 BETWEEN 0.5 AND 1600 GROUP BY 1) SELECT count(*) AS n, round(avg(abs(v - id_b)), 3) AS mae, round(sqrt(avg((v - id_b) ** 2)), 3) AS rmse FROM h")
def hold_out(s: SparkSession, d: str) -> DataFrame:
    known = sites(s, d, "id_b").withColumn("value", F.col("id_b").cast("double"))
    return geometry.hold_out_error(known, 40.0).select("n", F.round("mae", 3).alias("mae"), F.round("rmse", 3).alias("rmse"))


@query("SELECT x, y, round(100 * sqrt(gx * gx + gy * gy), 9) AS slope FROM (SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, 0.02 * (p_partkey % 50) + 0.01 * (p_partkey // 50) AS gx, 0.5 + 0.01 * (p_partkey % 50) AS gy FROM part) WHERE x BETWEEN 1 AND 48 AND y BETWEEN 1 AND (SELECT max(p_partkey) // 50 - 2 FROM part)")
def raster_slope(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    r = table(s, d, "part").select(F.floor(k / 50).alias("row"), (k % 50).alias("col"), ((k % 50) * (k % 50) * 0.01 + (k % 50) * F.floor(k / 50) * 0.01 + F.floor(k / 50) * 0.5).alias("value"))
    top = r.agg(F.max("row").alias("top"))
    got = geometry.horn_slope(r, 1.0).where("slope is not null").select(F.col("col").alias("x"), F.col("row").alias("y"), F.round("slope", 9).alias("slope"))
    return got.join(F.broadcast(top), F.col("y") <= F.col("top") - 2).where("y >= 1").select("x", "y", "slope")


@query(BOXES + "SELECT z.k AS id, round(avg(b.id), 6) AS mean FROM bx b JOIN range(25) z(k) ON b.x0 + 0.5 > (k % 5) * 100 + 3 AND b.x0 + 0.5 < (k % 5) * 100 + 97 AND b.y0 + 0.5 > (k // 5) * 100 + 3 AND b.y0 + 0.5 < (k // 5) * 100 + 93 GROUP BY 1")
def zonal_means(s: SparkSession, d: str) -> DataFrame:
    r = boxes(s, d).select((F.col("ring")[0]["x"] + 0.5).alias("x"), (F.col("ring")[0]["y"] + 0.5).alias("y"), F.col("id").cast("double").alias("value"))
    return geometry.zonal_mean(r, zones(s).select(F.col("id_b").alias("id"), F.col("ring_b").alias("ring")), 100.0).select("id", F.round("mean", 6).alias("mean"))


@query("SELECT cell, sum(len)::BIGINT * 2 AS feet FROM (SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, min(l_quantity) AS len, least(l_partkey, l_suppkey) % 25 AS cell FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) e WHERE NOT EXISTS (SELECT 1 FROM lineitem m WHERE m.l_returnflag = 'R' AND m.l_discount > 0.09 AND least(m.l_partkey, m.l_suppkey) = u AND greatest(m.l_partkey, m.l_suppkey) = v) GROUP BY 1")
def curb_by_hex(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    seg = li.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "N", "local").alias("cls"), F.col("l_quantity").alias("length"), (F.least("l_partkey", "l_suppkey") % 25).alias("x"), F.lit(0).alias("y"))
    met = li.where("l_returnflag = 'R' and l_discount > 0.09").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return geometry.curb_by_cell(seg, met, F.col("x")).select("cell", F.col("feet").cast("long").alias("feet"))


@query("""WITH p AS (SELECT c_custkey * 17 % 211 AS x, c_custkey * 29 % 197 AS y FROM customer), f AS (SELECT (x * sqrt(3) / 3 - y / 3.0) / 12 AS q, y * 2 / 3.0 / 12 AS r FROM p), g AS (SELECT *, -q - r AS s, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM f),
h AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - s) AS ds FROM g) SELECT CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END::INT AS q, CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END::INT AS r, count(*) AS n FROM h GROUP BY 1, 2""")
def hex_counts(s: SparkSession, d: str) -> DataFrame:
    """Points per hexagon; tests check besides that every point lies in its own cell."""
    p = anchors(s, d)
    h = geometry.hex_cell(F.col("x"), F.col("y"), 12.0)
    return p.select(h.alias("h")).groupBy("h.q", "h.r").agg(F.count("*").alias("n"))


@query(None)
def name_similarity(s: SparkSession, d: str) -> DataFrame:
    """Rows only: token-set ratios of suppliers next to each other; tests hold the ratio against known values."""
    n = table(s, d, "supplier").select("s_suppkey", text.norm_name(F.col("s_name")).alias("n"))
    other = n.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("n").alias("m"))
    return n.join(other, "s_suppkey").select("s_suppkey", F.round(text.similarity(F.col("n"), F.col("m")), 6).alias("score"))


@query("SELECT 'lineitem' AS layer, sum(l_quantity) AS total_in, sum(l_quantity) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders)) AS total_out, round(sum(l_quantity) FILTER (l_orderkey IN (SELECT o_orderkey FROM orders)) / sum(l_quantity), 9) AS share FROM lineitem")
def conservation_check(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", "l_quantity")
    kept = li.join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return aggregates.conservation(li, kept, "l_quantity").select(F.lit("lineitem").alias("layer"), "total_in", "total_out", F.round("share", 9).alias("share"))


@query(BOXES + "SELECT a.id AS a, b.id AS b FROM bx a JOIN bx b ON a.id < b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1")
def touching_parcels(s: SparkSession, d: str) -> DataFrame:
    return areas.close_shapes(boxes(s, d).select("id", F.array("ring").alias("shape")), 20.0)


@query(BOXES.replace("WITH bx", "WITH RECURSIVE bx") + ", e AS (SELECT a.id AS a, b.id AS b FROM bx a JOIN bx b ON a.id <> b.id AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 JOIN part p ON p.p_partkey = a.id JOIN part q ON q.p_partkey = b.id AND p.p_brand = q.p_brand), r AS (SELECT id AS root, id FROM bx UNION SELECT r.root, e.b FROM r JOIN e ON r.id = e.a), m AS (SELECT id, min(root) AS site FROM r GROUP BY 1) SELECT site, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1")
def same_owner_sites(s: SparkSession, d: str) -> DataFrame:
    """Touching parcels of one owner, joined to sites."""
    own = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("owner"))
    pairs = areas.close_shapes(boxes(s, d).select("id", F.array("ring").alias("shape")), 20.0)
    same = pairs.join(own.select(F.col("id").alias("a"), F.col("owner").alias("oa")), "a").join(own.select(F.col("id").alias("b"), F.col("owner").alias("ob")), "b").where("oa = ob and oa <> ''").select("a", "b")
    return graph.components(own.select("id"), same).groupBy(F.col("component").alias("site")).agg(F.count("*").alias("n")).where("n > 1")


@query(PLACES + "SELECT DISTINCT id_a FROM dd WHERE dist <= 6")
def within_any_radius(s: SparkSession, d: str) -> DataFrame:
    return geometry.within_radius(anchors(s, d), sites(s, d, "id_b"), 6.0).select("id_a").distinct()


@query("SELECT n_nationkey AS cell FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier WHERE regexp_matches(s_name, '[37]$') AND s_acctbal > 2000) OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE list_has_any(string_split(c_mktsegment || ';' || c_custkey, ';'), ['7', '11']))")
def paid_market_mask(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "supplier").where(F.col("s_name").rlike("[37]$") & (F.col("s_acctbal") > 2000)).select(F.col("s_nationkey").alias("cell"))
    b = table(s, d, "customer").where(F.arrays_overlap(F.split(F.concat_ws(";", "c_mktsegment", F.col("c_custkey").cast("string")), ";"), F.array(F.lit("7"), F.lit("11")))).select(F.col("c_nationkey").alias("cell"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("cell")).join(a.unionByName(b).distinct(), "cell", "left_semi")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT k, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS change FROM a FULL JOIN b USING (k) WHERE coalesce(b.n, 0) <> coalesce(a.n, 0)")
def run_comparison(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    n = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("before"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("after"))
    return n.where("before <> after").select("k", "before", "after", (F.col("after") - F.col("before")).alias("change"))


@query("SELECT l_orderkey, sum(l_quantity) > 150 AS impossible, CASE WHEN sum(l_quantity) <= 150 THEN round(sum(l_quantity) / 150, 6) END AS occupancy FROM lineitem GROUP BY 1")
def observed_occupancy(s: SparkSession, d: str) -> DataFrame:
    n = F.sum("l_quantity")
    return table(s, d, "lineitem").groupBy("l_orderkey").agg((n > 150).alias("impossible"), F.when(n <= 150, F.round(n / 150, 6)).alias("occupancy"))


@query(PLACES + ", sg AS (SELECT id_b AS id_s, x AS x1, y AS y1, x + 10 + id_b % 7 AS x2, y + id_b % 11 AS y2 FROM st), t AS (SELECT id_a, id_s, an.x, an.y, x1, y1, x2, y2, greatest(0, least(1, ((an.x - x1) * (x2 - x1) + (an.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM an, sg) SELECT id_a AS id_p, id_s, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 6) AS dist FROM t WHERE sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) <= 5.05")
def near_street(s: SparkSession, d: str) -> DataFrame:
    """Points within a distance of line segments."""
    k = F.col("id_s")
    streets = sites(s, d, "id_s").select("id_s", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 10 + k % 7).alias("x2"), (F.col("y") + k % 11).cast("double").alias("y2"))
    return geometry.near_segments(anchors(s, d).withColumnRenamed("id_a", "id_p"), streets, 5.05, 12.0).select("id_p", "id_s", F.round("dist", 6).alias("dist"))


@query("WITH b AS (SELECT n_nationkey % 5 * 100.0 AS x0, n_nationkey // 5 * 100.0 AS y0 FROM nation), c AS (SELECT q.q, r.r, 7 * sqrt(3) * (q.q + r.r / 2.0) AS x, 10.5 * r.r AS y FROM range(-40, 50) q(q), range(-2, 50) r(r)) SELECT DISTINCT q::INT AS q, r::INT AS r FROM c, b WHERE x > x0 + 1 AND x < x0 + 91 AND y > y0 + 1 AND y < y0 + 81")
def grid_of_area(s: SparkSession, d: str) -> DataFrame:
    """Hexagons whose centre lies in any of the areas."""
    n = F.col("n_nationkey")
    area = table(s, d, "nation").select(geometry.box(n % 5 * 100.0 + 1, F.floor(n / 5) * 100.0 + 1, F.lit(90.0), F.lit(80.0)).alias("ring"))
    return geometry.hex_grid(area, 7.0)


@query("SELECT event_id, round((hour(ts) + 20) * 60 + minute(ts) + second(ts) / 60.0, 6) AS minutes FROM events")
def clock_minutes(s: SparkSession, d: str) -> DataFrame:
    """Times of day of a timetable, whose hours may pass 24."""
    ts = F.col("ts")
    clock = F.format_string("%02d:%02d:%02d", F.hour(ts) + 20, F.minute(ts), F.second(ts))
    return table(s, d, "events").select("event_id", F.round(text.to_minutes(clock), 6).alias("minutes"))
