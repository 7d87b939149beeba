"""Queries of source records, code tables, merged records, shapes and the pipeline's steps, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions import text
from lotgrid.functions.keys import parcel_key, parcel_key_sql
from lotgrid.operators import aggregates, areas, codes, geometry, graph, ranking
from lotgrid.plans import pipeline
from lotgrid.session import table
from lotgrid.sources import adapters

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: A code table in the layout of the configuration: jurisdiction, code, use, confidence.
ZONING = (
    ("*", "*", "Unknown", "Low"), ("North", "C-4", "ByRight", "High"), ("North", "C2", "Prohibited", "Low"), ("North", "R-3", "Prohibited", "High"), ("North", "PUD", "Unknown", "Medium"),
    ("North", "M", "Conditional", "Medium"), ("North", "overlay:UCO", "Conditional", "Medium"), ("North", "overlay:NC", "Prohibited", "High"),
)
ALIASES = {"M1": "M"}


def code_table(s: SparkSession) -> DataFrame:
    rows = [(j, c, c.lower(), u, k, "reason", "section", "2024-01-01", "") for j, c, u, k in ZONING]
    return s.createDataFrame(rows, ", ".join(f"{c} string" for c in codes.COLUMNS))


def _zoned(s: SparkSession, d: str) -> DataFrame:
    """Parcels as questions to the code table: the first digit of the last block tells jurisdiction, prefix and overlay."""
    p = table(s, d, "parcels")
    k = F.col("rec_id") % 7
    return p.select(
        F.col("rec_id").alias("id"), F.when(k == 0, F.lit(None)).when(k == 1, "South").otherwise("North").alias("jurisdiction"), F.when(k == 2, F.concat(F.lit("L"), "zoning_code")).otherwise(F.col("zoning_code")).alias("code"),
        F.when(k == 3, F.array(F.lit("overlay:UCO"))).when(k == 4, F.array(F.lit("overlay:NC"), F.lit("overlay:ZZ"))).otherwise(F.array().cast("array<string>")).alias("overlays"), F.lit(None).cast("string").alias("zone"), (k == 5).alias("near_boundary"),
    )


_ZONE_SQL = """WITH t(key, code, use, conf) AS (VALUES ('C4', 'C-4', 'ByRight', 'High'), ('C2', 'C2', 'Prohibited', 'Low'), ('R3', 'R-3', 'Prohibited', 'High'), ('PUD', 'PUD', 'Unknown', 'Medium'), ('M', 'M', 'Conditional', 'Medium')),
q AS (SELECT rec_id AS id, rec_id % 7 AS k, regexp_replace(upper(CASE WHEN rec_id % 7 = 2 THEN 'L' || zoning_code ELSE zoning_code END), '[ -]', '', 'g') AS c FROM parcels),
f AS (SELECT id, k, c, regexp_replace(c, '^L', '') AS b, c LIKE 'L%' AS lim FROM q),
g AS (SELECT id, k, lim, regexp_replace(CASE WHEN b = 'M1' THEN 'M' ELSE b END, '^(PUD|PC)[0-9]+$', '\\1') AS key FROM f),
m AS (SELECT g.id, g.k, t.code, coalesce(t.use, 'Unknown') AS use, coalesce(t.conf, 'Low') AS conf, g.lim AND t.code IS NOT NULL AS lim, t.code IS NOT NULL AS hit FROM g LEFT JOIN t ON g.key = t.key AND g.k > 1),
r AS (SELECT *, CASE WHEN lim THEN 2 WHEN use IN ('ByRight', 'Conditional') THEN 1 WHEN use = 'Unknown' OR conf = 'Low' THEN 2 ELSE 3 END AS route0, CASE use WHEN 'ByRight' THEN 1 WHEN 'Conditional' THEN 2 WHEN 'Unknown' THEN 3 ELSE 4 END AS rk FROM m),
o AS (SELECT *, CASE WHEN k = 3 THEN 2 WHEN k = 4 THEN 4 ELSE 0 END AS ork, CASE WHEN k = 3 THEN 1 WHEN k = 4 THEN 3 ELSE 0 END AS oroute FROM r)
SELECT id, CASE WHEN ork > rk THEN CASE WHEN k = 3 THEN 'Conditional' ELSE 'Prohibited' END ELSE use END AS screen, CASE WHEN ork > rk THEN CASE WHEN k = 3 THEN 'Medium' ELSE 'High' END ELSE conf END AS confidence,
CASE WHEN k = 5 THEN 'Review' ELSE CASE greatest(route0, oroute) WHEN 1 THEN 'Pass' WHEN 2 THEN 'Review' ELSE 'Fail' END END AS route, coalesce(code, '*') AS matched_code,
concat_ws('; ', CASE WHEN k < 2 THEN 'jurisdiction not in table' END, CASE WHEN lim THEN 'limitation text applies' END, CASE WHEN k > 1 AND NOT hit THEN 'code not in table' END, CASE WHEN k = 5 THEN 'near a boundary' END, CASE WHEN k = 4 THEN 'overlay not in table: overlay:ZZ' END) AS notes,
CASE WHEN lim THEN 'limited' WHEN k = 5 THEN 'boundary' WHEN k < 2 THEN 'jurisdiction' WHEN k = 4 THEN 'overlay' ELSE 'unknown' END AS tag FROM o"""


@query(_ZONE_SQL)
def zoning_resolve(s: SparkSession, d: str) -> DataFrame:
    out = codes.resolve_codes(_zoned(s, d), code_table(s), ALIASES)
    return out.select("id", "screen", "confidence", "route", "matched_code", F.array_join("notes", "; ").alias("notes"), codes.reason_tag(F.col("notes")).alias("tag"))


OWNERS = [("CITY|COUNTY|TOWNSHIP|SCHOOL|VILLAGE|STATE OF", "Public"), ("LLC|INC|CORP|LTD|CO$|LP$", "Corporate")]
CLASSES = (("400", "SurfaceParking", "N"), ("455", "SurfaceParking", "Y"), ("510", "Residential", "N"), ("520", "Residential", "N"))


@query(f"""WITH lots AS (SELECT {parcel_key_sql('parcel_id')} AS k, sum(lot_sqft) AS lot, count(*) AS parts FROM parcels GROUP BY 1 HAVING k IS NOT NULL),
a AS (SELECT {parcel_key_sql('PARCEL_ID')} AS k, LUC, OWNER, LAND_VAL, BLDG_VAL, YRBUILT, rec_id FROM cama QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1),
x(code, cls) AS (VALUES ('400', 'SurfaceParking'), ('455', 'SurfaceParking'), ('510', 'Residential'), ('520', 'Residential')),
n AS (SELECT *, trim(regexp_replace(regexp_replace(upper(coalesce(OWNER, '')), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS o FROM lots LEFT JOIN a USING (k))
SELECT k AS parcel_id, round(lot, 2) AS lot_sqft, parts, coalesce(cls, 'Other') AS land_use_class, coalesce(LUC = '455', false) AS auto, CASE WHEN o = '' THEN 'Unknown' WHEN regexp_matches(o, 'CITY|COUNTY|TOWNSHIP|SCHOOL|VILLAGE|STATE OF') THEN 'Public' WHEN regexp_matches(o, 'LLC|INC|CORP|LTD|CO$|LP$') THEN 'Corporate' ELSE 'Private' END AS owner_type,
round(BLDG_VAL / nullif(LAND_VAL, 0), 6) AS improvement_ratio, CASE WHEN YRBUILT > 0 THEN YRBUILT END AS year_built FROM n LEFT JOIN x ON n.LUC = x.code""")
def assessor_parcels(s: SparkSession, d: str) -> DataFrame:
    raw = table(s, d, "parcels").select(parcel_key(F.col("parcel_id")).alias("parcel_id"), "lot_sqft")
    a = table(s, d, "cama").select(parcel_key(F.col("PARCEL_ID")).alias("parcel_id"), F.col("LUC").alias("code"), F.col("LAND_VAL").alias("land"), F.col("BLDG_VAL").alias("building"), F.col("OWNER").alias("owner"), F.col("YRBUILT").alias("year"), F.col("rec_id").alias("rec"))
    got = adapters.parcels(raw, a, s.createDataFrame(CLASSES, "county_code string, land_use_class string, auto string"), OWNERS, [])
    return got.select("parcel_id", F.round("lot_sqft", 2).alias("lot_sqft"), "parts", "land_use_class", "auto", "owner_type", F.round("improvement_ratio", 6).alias("improvement_ratio"), "year_built")


@query("SELECT venue_id, rec_id, CASE WHEN seats >= 0 THEN seats END AS seats, CASE WHEN events_per_year >= 0 THEN events_per_year END AS events FROM venues QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY load_ts DESC, rec_id) = 1")
def venues_standard(s: SparkSession, d: str) -> DataFrame:
    return adapters.venues(table(s, d, "venues")).select("venue_id", "rec_id", "seats", F.col("events_per_year").alias("events"))


@query("SELECT rec_id, CASE WHEN beds >= 0 THEN beds END AS beds FROM hospitals_cms")
def hospitals_standard(s: SparkSession, d: str) -> DataFrame:
    return adapters.hospitals(table(s, d, "hospitals_cms")).select("rec_id", "beds")


@query("""WITH o AS (SELECT o_custkey AS unit, sum(CASE WHEN o_totalprice >= 200000 THEN o_totalprice - 200000 END) AS a FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT unit, round(a, 2) AS total, round(a / nullif(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0), 6) AS share FROM o JOIN customer ON unit = c_custkey""")
def census_sums(s: SparkSession, d: str) -> DataFrame:
    """Orders of every fourth key as counts by quarter of a unit, customers as the whole: below zero means not stated."""
    o = table(s, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("unit"), (F.col("o_totalprice") - 200000).alias("v"))
    summed = o.groupBy("unit").agg(F.sum(F.when(F.col("v") >= 0, F.col("v"))).alias("a"))
    raw = summed.join(table(s, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("w")), "unit")
    got = adapters.census(raw, {"total": ["a"], "whole": ["w"]}, {"share": ("total", "whole")}, "unit")
    return got.select("unit", F.round("total", 2).alias("total"), F.round("share", 6).alias("share"))


@query("""WITH r AS (SELECT p_partkey AS id, p_partkey % 97 AS cluster, CASE WHEN p_size % 3 > 0 THEN p_name END AS name, CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 2 = 0 THEN 'Garage' ELSE 'Surface' END ELSE 'Unknown' END AS kind, CASE WHEN p_size % 4 > 0 THEN p_size * 10.0 END AS cap, CASE WHEN p_size = 7 THEN 'yes' WHEN p_size % 3 = 1 THEN 'no' END AS fee, CASE WHEN p_size % 6 = 0 THEN 'private' WHEN p_size % 6 = 1 THEN 'yes' END AS access, p_size % 8 < 2 AS polygon FROM part),
k AS (SELECT cluster, kind FROM (SELECT cluster, kind, count(*) AS n FROM r WHERE kind <> 'Unknown' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY n DESC, kind) = 1)
SELECT r.cluster, arg_min(name, id) FILTER (name IS NOT NULL) AS name, CASE WHEN count(cap) = count(*) THEN sum(cap) WHEN count(cap) > 0 AND count(*) FILTER (polygon) <= 1 THEN max(cap) END::DOUBLE AS capacity, CASE WHEN count(*) FILTER (fee = 'yes') > 0 THEN 'yes' ELSE arg_min(fee, id) FILTER (fee IS NOT NULL) END AS fee,
coalesce(CASE WHEN count(*) FILTER (access = 'yes') > 0 THEN 'yes' END, arg_min(access, id) FILTER (access IS NOT NULL)) AS access, count(*) AS parts, coalesce(any_value(k.kind), 'Unknown') AS kind FROM r LEFT JOIN k ON r.cluster = k.cluster GROUP BY r.cluster""")
def merged_supply(s: SparkSession, d: str) -> DataFrame:
    z, none = F.col("p_size"), F.lit(None)
    r = table(s, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97).alias("cluster"), F.when(z % 3 > 0, F.col("p_name")).alias("name"), none.cast("string").alias("operator"), F.when(z % 5 > 0, F.when(z % 2 == 0, "Garage").otherwise("Surface")).otherwise("Unknown").alias("kind"),
        F.when(z % 4 > 0, z * 10.0).alias("capacity"), F.when(z == 7, "yes").when(z % 3 == 1, "no").alias("fee"), F.when(z % 6 == 0, "private").when(z % 6 == 1, "yes").alias("access"), none.cast("double").alias("levels"), F.lit("s").alias("source_ids"), (z % 8 < 2).alias("polygon"),
    )
    return graph.merged_records(r, "cluster", "id").select("cluster", "name", "capacity", "fee", "access", "parts", "kind")


_L = """WITH l AS (SELECT p_partkey AS id, (p_partkey % 40) * 7.0 AS x, (p_partkey // 40) * 7.0 AS y, 4.0 + p_size % 6 AS w FROM part), b AS (SELECT id, x + 2 AS x, y + 2 AS y, 3.0 + id % 4 AS w FROM l)
"""


def _shapes(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """L-shapes (a square with its upper right quarter cut out, as a hole or as a corner) and squares over them."""
    k = F.col("p_partkey")
    p = table(s, d, "part").select(k.alias("id"), ((k % 40) * 7.0).alias("x"), (F.floor(k / 40) * 7.0).alias("y"), (F.col("p_size") % 6 + 4.0).alias("w"))
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    corner = F.array(F.array(pt(x, y), pt(x + w, y), pt(x + w, y + w / 2), pt(x + w / 2, y + w / 2), pt(x + w / 2, y + w), pt(x, y + w)))
    hole = F.array(geometry.box(x, y, w, w), geometry.box(x + w / 2, y + w / 2, w / 2, w / 2))
    v = (F.col("id") % 4 + 3.0)
    return p.select(F.col("id").alias("id_a"), F.when(F.col("id") % 2 == 0, corner).otherwise(hole).alias("shape_a")), p.select(F.col("id").alias("id_b"), F.array(geometry.box(x + 2, y + 2, v, v)).alias("shape_b"))


@query(_L + """, o AS (SELECT l.id AS id_a, b.id AS id_b, l.w * l.w * 0.75 AS area_a, b.w * b.w AS area_b, greatest(0, least(l.x + l.w, b.x + b.w) - greatest(l.x, b.x)) * greatest(0, least(l.y + l.w, b.y + b.w) - greatest(l.y, b.y)) - greatest(0, least(l.x + l.w, b.x + b.w) - greatest(l.x + l.w / 2, b.x)) * greatest(0, least(l.y + l.w, b.y + b.w) - greatest(l.y + l.w / 2, b.y)) AS shared
FROM l JOIN b ON l.x < b.x + b.w AND b.x < l.x + l.w AND l.y < b.y + b.w AND b.y < l.y + l.w) SELECT id_a, id_b, round(area_a, 6) AS area_a, round(area_b, 6) AS area_b, round(shared, 6) AS shared FROM o WHERE shared > 0""")
def shape_overlaps(s: SparkSession, d: str) -> DataFrame:
    left, right = _shapes(s, d)
    return areas.intersections(left, right, 16.0).select("id_a", "id_b", *[F.round(c, 6).alias(c) for c in ("area_a", "area_b", "shared")])


@query(None)
def resolve_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Rows only: which of the sites on the same land stays, best price first; tests hold the rounds against the plain loop."""
    left, _ = _shapes(s, d)
    sites = left.select(F.col("id_a").alias("id"), F.col("shape_a").alias("shape"))
    price = table(s, d, "part").select(F.col("p_partkey").alias("id"), (-F.col("p_retailprice")).alias("rank"))
    return ranking.resolve_conflicts(price, areas.substantial_overlaps(sites, 16.0))


@query("""WITH b AS (SELECT c_mktsegment AS grp, o_totalprice AS x, (o_orderkey * 37 % 101)::DOUBLE AS y FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY x) + (count(*) OVER (PARTITION BY grp, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY grp ORDER BY y) + (count(*) OVER (PARTITION BY grp, y) - 1) / 2.0 AS ry FROM b)
SELECT grp, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""")
def rank_correlation(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp")), F.col("o_custkey") == F.col("c_custkey")).select("grp", F.col("o_totalprice").alias("x"), (F.col("o_orderkey") * 37 % 101).cast("double").alias("y"))
    return ranking.spearman(o, "grp", "x", "y").select("grp", "n", F.round("rho", 6).alias("rho"))


_ROLES = """WITH r(category, daypart, rate) AS (VALUES ('BUILDING', 'day', 0.5), ('BUILDING', 'eve', 0.25), ('MACHINERY', 'day', 2.0)),
reach AS (SELECT n_nationkey AS src, n_nationkey AS cell, 1.0 AS w FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 1, 0.6 FROM nation WHERE n_nationkey % 5 < 4 UNION ALL SELECT n_nationkey, n_nationkey + 5, 0.25 FROM nation WHERE n_nationkey < 20),
sh AS (SELECT src, cell, w / sum(w) OVER (PARTITION BY src) AS share FROM reach)
"""


def _reach(s: SparkSession, d: str) -> DataFrame:
    """Nations as cells of a grid five wide: the own cell, the next one at four minutes and the one below at eight."""
    n = F.col("n_nationkey")
    rows = F.array_compact(F.array(F.struct(n.alias("cell"), F.lit(1.0).alias("minutes")), F.when(n % 5 < 4, F.struct((n + 1).alias("cell"), F.lit(4.0).alias("minutes"))), F.when(n < 20, F.struct((n + 5).alias("cell"), F.lit(8.0).alias("minutes")))))
    return table(s, d, "nation").select(n.alias("src"), F.explode(rows).alias("c")).select("src", "c.*")


def _demand(s: SparkSession, d: str) -> DataFrame:
    anchors = table(s, d, "customer").select(F.col("c_custkey").alias("anchor"), F.col("c_mktsegment").alias("category"), F.abs("c_acctbal").alias("size"), F.col("c_nationkey").alias("cell"))
    rates = s.createDataFrame([("BUILDING", "day", 0.5), ("BUILDING", "eve", 0.25), ("MACHINERY", "day", 2.0)], "category string, daypart string, rate double")
    return pipeline.demand_step(anchors, rates, _reach(s, d))[0]


_DEMAND = _ROLES + ", dem AS (SELECT sh.cell, daypart, sum(abs(c_acctbal) * rate * share) AS demand FROM customer JOIN r ON c_mktsegment = category JOIN sh ON sh.src = c_nationkey GROUP BY 1, 2)"


@query(_DEMAND + " SELECT cell, daypart, round(demand, 4) AS demand FROM dem")
def demand_allocated(s: SparkSession, d: str) -> DataFrame:
    return _demand(s, d).select("cell", "daypart", F.round("demand", 4).alias("demand"))


@query(_DEMAND + """, sup AS (SELECT sh.cell, d.daypart, sum(s_acctbal * share) AS supply FROM supplier JOIN sh ON sh.src = s_nationkey, (VALUES ('day'), ('eve')) d(daypart) WHERE s_suppkey % 10 > 0 GROUP BY 1, 2)
SELECT cell, daypart, round(coalesce(demand, 0), 4) AS demand, round(coalesce(supply, 0), 4) AS supply, round(coalesce(demand, 0) - coalesce(supply, 0), 4) AS gap FROM dem FULL JOIN sup USING (cell, daypart)""")
def gap_allocated(s: SparkSession, d: str) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    f = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("cell"), F.col("s_name").alias("name"), none("string").alias("operator"), F.lit("Surface").alias("kind"), F.col("s_acctbal").alias("capacity"), none("string").alias("fee"), F.when(F.col("s_suppkey") % 10 == 0, "private").otherwise("yes").alias("access"), none("double").alias("levels"), F.lit("s").alias("source_ids"), F.lit(True).alias("polygon"), F.lit(0.0).alias("area"))
    supply, _ = pipeline.supply_step(f, f.select("id", F.col("id").alias("cluster")), _reach(s, d), ["day", "eve"], 325.0, 0.85, [(F.col("access") == "private", "private")])
    return pipeline.gap_step(_demand(s, d), supply).select("cell", "daypart", *[(F.round(c, 4) + 0.0).alias(c) for c in ("demand", "supply", "gap")])


@query("SELECT p_partkey AS id, CASE WHEN p_size < 10 OR p_brand = 'Brand#11' THEN 'Fail' WHEN p_retailprice > 1500 THEN 'Review' ELSE 'Pass' END AS status, concat_ws('; ', CASE WHEN p_size < 10 THEN 'too small' END, CASE WHEN p_brand = 'Brand#11' THEN 'excluded' END, CASE WHEN p_retailprice > 1500 THEN 'dear' END) AS reasons FROM part")
def site_screen(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    got = pipeline.screen_step(table(s, d, "part").withColumnRenamed("p_partkey", "id"), [(c("p_size") < 10, "too small"), (c("p_brand") == "Brand#11", "excluded")], [(c("p_retailprice") > 1500, "dear")])
    return got.select("id", "status", F.array_join("reasons", "; ").alias("reasons"))


@query("""WITH p AS (SELECT p_partkey AS id, p_retailprice AS price, p_size::DOUBLE AS size FROM part), q AS (SELECT quantile_cont(price, 0.05) AS pl, quantile_cont(price, 0.95) AS ph, quantile_cont(size, 0.05) AS sl, quantile_cont(size, 0.95) AS sh FROM p)
SELECT id, 'price' AS criterion, round(100 - (least(greatest(price, pl), ph) - pl) / (ph - pl) * 100, 6) AS score FROM p, q UNION ALL SELECT id, 'size', round((least(greatest(size, sl), sh) - sl) / (sh - sl) * 100, 6) FROM p, q""")
def site_criteria(s: SparkSession, d: str) -> DataFrame:
    sites = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return pipeline.criteria_step(sites, {"price": True, "size": False}).select("id", "criterion", (F.round("score", 6) + 0.0).alias("score"))


@query("SELECT k, before::BIGINT AS before, after::BIGINT AS after, (after - before)::BIGINT AS change FROM (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS before, count(*) FILTER (o_orderpriority = '1-URGENT') AS after FROM orders GROUP BY 1) WHERE before <> after")
def runs_compared(s: SparkSession, d: str) -> DataFrame:
    one = lambda cond: table(s, d, "orders").where(cond).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return aggregates.compare_runs(one("o_orderstatus = 'F'"), one("o_orderpriority = '1-URGENT'"), "k", "n")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'wd_day' WHEN o_orderstatus = 'O' THEN 'we_eve' END AS part, CASE WHEN o_custkey % 60 = 39 THEN 'OH' WHEN o_custkey % 60 = 6 THEN 'CA' WHEN o_custkey % 60 = 7 THEN NULL ELSE 'x' END AS state FROM orders WHERE o_custkey % 60 IN (6, 7, 39)")
def labels_normalised(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where("o_custkey % 60 in (6, 7, 39)")
    said = F.when(F.col("o_orderstatus") == "F", "Weekday - Day").when(F.col("o_orderstatus") == "O", " weekend  EVENING").otherwise("some day")
    return o.select("o_orderkey", text.daypart(said).alias("part"), text.state_abbr(F.format_string("%02d", F.col("o_custkey") % 60)).alias("state"))
