"""Queries of filters, rules, joins, aggregates, ranks and set operators over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgrid.functions import rules, text, units
from lotgrid.operators import aggregates, ranking
from lotgrid.session import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c):  # noqa: ANN001, ANN201
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


# filters, projections, rules


@query("SELECT p_partkey, round(p_retailprice / nullif(cast(p_size - 1 AS DOUBLE), 0), 6) + 0.0 AS ratio FROM part")
def guarded_ratio(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", r6(rules.ratio(F.col("p_retailprice"), F.col("p_size") - 1)).alias("ratio"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '(?i)0[1-3]$') THEN 'Public' WHEN regexp_matches(s_name, '(?i)[4-6]$') THEN 'Corporate' ELSE 'Unknown' END AS owner_type FROM supplier")
def owner_classify(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", rules.first_match(F.col("s_name"), [("0[1-3]$", "Public"), ("[4-6]$", "Corporate")], "Unknown").alias("owner_type"))


@query("SELECT s_suppkey, CASE WHEN regexp_matches(s_name, '(?i)[5-9]$') THEN 'B' WHEN regexp_matches(s_name, '(?i)[0-6]$') THEN 'A' ELSE 'none' END AS owner_type FROM supplier")
def owner_overrides(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", rules.last_match(F.col("s_name"), F.lit("none"), [("[0-6]$", "A"), ("[5-9]$", "B")]).alias("owner_type"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '(?i)1[1-3]$') THEN 'brand' WHEN p_size < 5 THEN 'small' END AS reason FROM part WHERE regexp_matches(p_brand, '(?i)1[1-3]$') OR p_size < 5")
def exclusion_rules(s: SparkSession, d: str) -> DataFrame:
    why = rules.first_reason([(F.col("p_brand").rlike("(?i)1[1-3]$"), "brand"), (F.col("p_size") < 5, "small")])
    return table(s, d, "part").select("p_partkey", why.alias("reason")).where("reason is not null")


@query("""WITH r(pri, k, v, cat) AS (VALUES (1, 'type', 'STANDARD*', 'retail'), (2, 'type', 'PROMO*', 'office'), (3, 'type', '*', 'other'))
SELECT p_partkey, min_by(cat, pri) AS category FROM part JOIN r ON p_type LIKE replace(v, '*', '%') GROUP BY p_partkey""")
def category_rules(s: SparkSession, d: str) -> DataFrame:
    rule = s.createDataFrame([(1, "STANDARD%", "retail"), (2, "PROMO%", "office"), (3, "%", "other")], "pri int, v string, cat string")
    return table(s, d, "part").select("p_partkey", "p_type").join(F.broadcast(rule), F.expr("p_type like v")).groupBy("p_partkey").agg(F.min_by("cat", "pri").alias("category"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' THEN 'a=' || c_mktsegment END, CASE WHEN c_nationkey < 9 THEN 'n=' || c_nationkey END, 'none') AS category FROM customer")
def first_tag(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", rules.first_tag([("a", F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")), ("n", F.col("c_nationkey") < 9, F.col("c_nationkey"))], "none").alias("category"))


@query("SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'public' WHEN c_acctbal > 5000 AND c_mktsegment <> 'MACHINERY' THEN 'private' WHEN c_acctbal < 0 THEN 'unknown' ELSE 'private' END AS access FROM customer")
def private_flags(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "customer").select("c_custkey", rules.decide([(c("c_nationkey") < 5, "public"), ((c("c_acctbal") > 5000) & (c("c_mktsegment") != "MACHINERY"), "private"), (c("c_acctbal") < 0, "unknown")], "private").alias("access"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer")
def sentinel_null(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Surface' WHEN 'O' THEN 'Garage' ELSE 'Unknown' END AS kind FROM orders WHERE o_orderpriority <> '5-LOW'")
def enum_map(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").where("o_orderpriority <> '5-LOW'").select("o_orderkey", rules.mapped(F.col("o_orderstatus"), {"F": "Surface", "O": "Garage"}, "Unknown").alias("kind"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_size > 25 END, false) AS flag FROM part")
def null_false(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", F.coalesce(F.when(F.col("p_size") > 10, F.col("p_size") > 25), F.lit(False)).alias("flag"))


@query(r"SELECT p_partkey, regexp_matches(p_type, '(?i)\b(?:TIN|STEEL)(?:\W|$)') AS paid FROM part")
def whole_word_operator(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", rules.whole_word(F.col("p_type"), ["TIN", "STEEL"]).alias("paid"))


@query("SELECT o_orderkey, list_has_any(string_split(o_orderstatus || ';' || o_orderpriority, ';'), ['P', '1-URGENT']) AS hit FROM orders")
def multi_value_hit(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", rules.any_of(F.concat_ws(";", "o_orderstatus", "o_orderpriority"), ["P", "1-URGENT"]).alias("hit"))


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN least(greatest(c_acctbal, 100.0), 5000.0) END AS v FROM customer")
def clip_cap(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_custkey", rules.clip(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), 100.0, 5000.0).alias("v"))


@query("""SELECT p_partkey, reasons, CASE WHEN size_small OR brand THEN 'Fail' WHEN pricey THEN 'Review' ELSE 'Pass' END AS status FROM (
SELECT p_partkey, p_size < 10 AS size_small, p_brand = 'Brand#11' AS brand, p_retailprice > 1500 AS pricey,
concat_ws('; ', CASE WHEN p_size < 10 THEN 'too small: ' || p_size END, CASE WHEN p_brand = 'Brand#11' THEN 'excluded brand' END, CASE WHEN p_retailprice > 1500 THEN 'review price' END) AS reasons FROM part)""")
def screen_reasons(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    small, brand, pricey = c("p_size") < 10, c("p_brand") == "Brand#11", c("p_retailprice") > 1500
    listed = F.array_compact(F.array(F.when(small, F.concat(F.lit("too small: "), c("p_size").cast("string"))), F.when(brand, F.lit("excluded brand")), F.when(pricey, F.lit("review price"))))
    return table(s, d, "part").select("p_partkey", F.array_join(listed, "; ").alias("reasons"), F.when(small | brand, "Fail").when(pricey, "Review").otherwise("Pass").alias("status"))


@query("SELECT p_partkey, floor(p_size * 1000.0 * (1 - 0.1) * 0.85 / 325) AS stalls, CASE WHEN p_size > 25 THEN 'existing' ELSE 'new' END AS kind FROM part")
def stall_estimate(s: SparkSession, d: str) -> DataFrame:
    lot = F.col("p_size") * 1000.0
    return table(s, d, "part").select("p_partkey", rules.stalls(lot, 0.1, 0.85, 325.0).alias("stalls"), F.when(F.col("p_size") > 25, "existing").otherwise("new").alias("kind"))


@query("SELECT s_suppkey, trim(regexp_replace(regexp_replace(upper(s_name), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS owner_norm, nullif(trim(regexp_replace(regexp_replace(replace(lower(s_name), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), '') AS name_norm FROM supplier")
def name_norm(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "supplier").select("s_suppkey", text.norm_owner(F.col("s_name")).alias("owner_norm"), text.norm_name(F.col("s_name")).alias("name_norm"))


@query(r"SELECT p_partkey, regexp_replace(upper(p_type), '[\s\-]', '', 'g') AS code, try_cast(nullif(regexp_extract(p_brand, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS num FROM part")
def tag_numbers(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select("p_partkey", text.key_code(F.col("p_type")).alias("code"), text.first_number(F.col("p_brand")).alias("num"))


@query(r"SELECT event_id, regexp_replace('http://x/?a=1&key=' || user_id || '&token=' || event_id, '(?i)([?&](?:key|api_key|apikey|token|access_token)=)[^&\s]+', '\1***', 'g') AS url FROM events")
def redact_secrets(s: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("http://x/?a=1&key="), F.col("user_id").cast("string"), F.lit("&token="), F.col("event_id").cast("string"))
    return table(s, d, "events").select("event_id", text.redact(url).alias("url"))


@query("SELECT p_partkey, round(p_size / 0.3048, 6) AS feet, round(p_size * 1000 / 4046.8564224, 6) AS acres, round(p_size * 10 / 1.3 / 60.0, 6) AS minutes, CASE WHEN p_size <= 3 THEN 1.0 WHEN p_size <= 5 THEN 0.6 WHEN p_size <= 8 THEN 0.25 ELSE 0.0 END::DOUBLE AS weight, CASE WHEN p_size > 40 THEN p_size::DOUBLE ELSE greatest(round_even(p_size / 3.5, 0), 1.0) END AS floors FROM part")
def unit_conversions(s: SparkSession, d: str) -> DataFrame:
    z = F.col("p_size").cast("double")
    levels = F.when(F.col("p_size") > 40, F.col("p_size"))
    return table(s, d, "part").select("p_partkey", F.round(units.feet(z), 6).alias("feet"), F.round(units.acres(z * 1000), 6).alias("acres"), F.round(units.walk_minutes(z * 10, 1.3), 6).alias("minutes"), units.band_weight(z).alias("weight"), units.floors(levels, z, 3.5).alias("floors"))


@query("SELECT o_orderkey, round(((degrees(atan2(o_totalprice - 100000, o_custkey - 500)) % 180) + 180) % 180, 6) AS bearing FROM orders")
def bearings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select("o_orderkey", F.round(units.bearing((F.col("o_custkey") - 500).cast("double"), F.col("o_totalprice") - 100000), 6).alias("bearing"))


# joins


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def lookup_inner(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(s, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON c_custkey = o_custkey")
def left_zero_fill(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where("o_orderpriority = '1-URGENT'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 300000)")
def anti_join(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").join(table(s, d, "orders").where("o_custkey is not null and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT n_nationkey, p AS daypart FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders)")
def frame_by_daypart(s: SparkSession, d: str) -> DataFrame:
    parts = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")])  # five fixed dayparts, exploded in place of a cross join
    return table(s, d, "nation").select("n_nationkey", F.explode(parts).alias("daypart"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity <= 10 THEN 'near' WHEN l_quantity <= 25 THEN 'mid' WHEN l_quantity <= 40 THEN 'far' ELSE 'out' END AS band FROM lineitem")
def band_lookup(s: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(q <= 10, "near").when(q <= 25, "mid").when(q <= 40, "far").otherwise("out").alias("band"))


# aggregates


@query("SELECT c_nationkey, sum(c_acctbal) IS NOT NULL AS has_sum, count(*) AS n, count(DISTINCT c_mktsegment) AS n_seg, round(avg(c_acctbal), 6) AS mean, round(median(c_acctbal), 6) AS med, round(quantile_cont(c_acctbal, 0.9), 6) AS p90 FROM customer GROUP BY 1")
def group_statistics(s: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.sum(b).isNotNull().alias("has_sum"), F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("n_seg"), F.round(F.avg(b), 6).alias("mean"), F.round(F.median(b), 6).alias("med"), F.round(F.percentile(b, 0.9), 6).alias("p90"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus <> 'O') AS first_stated FROM orders GROUP BY 1")
def first_non_null(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")))
    return o.groupBy("o_custkey").agg(aggregates.first_stated("v", F.col("o_orderkey")).alias("first_stated"))


@query("SELECT c_nationkey, c_mktsegment AS top FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def most_frequent_segment(s: SparkSession, d: str) -> DataFrame:
    return aggregates.most_frequent(table(s, d, "customer"), ["c_nationkey"], "c_mktsegment", "top")


@query("SELECT o_custkey, CASE WHEN count(cap) = count(*) THEN sum(cap)::BIGINT WHEN count(cap) > 0 AND sum(poly) <= 1 THEN max(cap) END AS capacity FROM (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS cap, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS poly FROM orders) GROUP BY 1")
def capacity_rules(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").withColumn("cap", F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")))
    return o.groupBy("o_custkey").agg(aggregates.stated_capacity("cap", F.col("o_orderpriority") == "1-URGENT").alias("capacity"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1")
def joined_strings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(aggregates.joined_values("o_orderpriority").alias("priorities"))


@query("SELECT user_id, departures, round(120.0::DOUBLE / nullif(departures, 0), 6) AS headway, coalesce(120.0::DOUBLE / nullif(departures, 0) <= 15, false) AS frequent FROM (SELECT user_id, count(*) FILTER (m >= 420 AND m < 540) AS departures FROM (SELECT user_id, hour(ts) * 60 + minute(ts) AS m FROM events) GROUP BY 1)")
def peak_headway(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("user_id", (F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    return aggregates.peak_headway(e, "user_id", "m", 420, 540, 15).withColumn("headway", F.round("headway", 6))


@query("SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END)::BIGINT AS stated_sum, max(o_orderpriority) AS latest, bool_or(o_orderstatus = 'F') AS any_f FROM orders GROUP BY 1")
def min_count_sum(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey"))).alias("stated_sum"), F.max("o_orderpriority").alias("latest"), F.bool_or(F.col("o_orderstatus") == "F").alias("any_f"))


@query("SELECT n AS c_nationkey, arg_max(k, (v, -k)) AS top_anchor, round(max(v) / sum(v), 6) AS share FROM (SELECT c_nationkey AS n, c_custkey AS k, sum(o_totalprice) AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1")
def top_anchor_share(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("v")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return v.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("v", (-F.col("c_custkey")).alias("k"))).alias("top_anchor"), F.round(F.max("v") / F.sum("v"), 6).alias("share"))


@query("SELECT c_nationkey, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal * c_custkey END) / nullif(sum(CASE WHEN c_acctbal > 0 THEN c_custkey END), 0), 4) AS wmean FROM customer GROUP BY 1")
def weighted_means(s: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.round(aggregates.weighted_mean(v, F.col("c_custkey").cast("double")), 4).alias("wmean"))


@query("SELECT o_custkey, avg(v) AS mean_parts FROM (SELECT o_custkey, unnest([CASE WHEN o_orderstatus = 'F' THEN 10 END, CASE WHEN o_orderpriority = '1-URGENT' THEN 20 END, o_orderkey % 7]) AS v FROM orders) WHERE v IS NOT NULL GROUP BY 1")
def mean_of_parts(s: SparkSession, d: str) -> DataFrame:
    parts = F.array(F.when(F.col("o_orderstatus") == "F", 10), F.when(F.col("o_orderpriority") == "1-URGENT", 20), (F.col("o_orderkey") % 7).cast("int"))
    return table(s, d, "orders").select("o_custkey", F.explode(F.array_compact(parts)).alias("v")).groupBy("o_custkey").agg(F.avg("v").alias("mean_parts"))


@query("SELECT c_nationkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def pivot_counts(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW")).join(table(s, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    wide = o.groupBy("c_nationkey").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.count(F.lit(1)))
    return wide.select("c_nationkey", *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(n) for p, n in (("1-URGENT", "urgent"), ("2-HIGH", "high"), ("5-LOW", "low"))])


@query("SELECT o_custkey, o_orderstatus AS category, round_even(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2 HAVING round_even(sum(o_totalprice), 2) <> 0")
def components_json(s: SparkSession, d: str) -> DataFrame:
    j = aggregates.breakdown(table(s, d, "orders"), ["o_custkey"], "o_orderstatus", "o_totalprice")
    return j.select("o_custkey", F.explode(F.from_json("components", "map<string,double>")).alias("category", "v"))


@query("""WITH e AS (SELECT c_mktsegment AS grp, p - o AS e FROM (SELECT c_mktsegment, o_totalprice / 500000 AS o, (o_orderkey % 100) / 100.0 AS p FROM orders JOIN customer ON o_custkey = c_custkey))
SELECT grp, count(e) AS n, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(sqrt(avg(e * e)), 6) AS rmse, round(avg((abs(e) <= 0.15)::INT), 6) AS within FROM e GROUP BY GROUPING SETS ((grp), ())""")
def validation_metrics(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").join(table(s, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("grp")), F.col("o_custkey") == F.col("c_custkey"))
    m = aggregates.error_metrics(o.select("grp", (F.col("o_totalprice") / 500000).alias("o"), ((F.col("o_orderkey") % 100) / 100.0).alias("p")), "grp", "o", "p")
    return m.select("grp", "n", *[F.round(c, 6).alias(c) for c in ("mae", "bias", "rmse", "within")])


@query("SELECT o_orderpriority AS part, count(DISTINCT o_custkey) AS n_lots, CASE WHEN count(DISTINCT o_custkey) >= 5 THEN round_even(median(o_totalprice / nullif(o_orderkey, 0)), 4) END AS factor FROM orders GROUP BY 1")
def calibration_factors(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_orderpriority").alias("part"), "o_custkey", "o_totalprice", F.col("o_orderkey").cast("double").alias("k"))
    return aggregates.calibration(o, "part", "o_custkey", "o_totalprice", "k")


@query("SELECT split_part(unnest(string_split(rs, '; ')), ':', 1) AS reason, count(*) AS n FROM (SELECT concat_ws('; ', CASE WHEN p_size < 10 THEN 'small:' || p_size END, CASE WHEN p_retailprice > 1500 THEN 'price' END) AS rs FROM part) WHERE rs <> '' GROUP BY 1")
def reason_counts(s: SparkSession, d: str) -> DataFrame:
    listed = F.array_compact(F.array(F.when(F.col("p_size") < 10, F.concat(F.lit("small:"), F.col("p_size").cast("string"))), F.when(F.col("p_retailprice") > 1500, F.lit("price"))))
    return table(s, d, "part").select(F.explode(listed).alias("r")).groupBy(F.split_part("r", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT key, sum(val)::BIGINT AS total FROM (SELECT unnest(['C000', 'CNS']) AS key, unnest([o_orderkey % 10, o_orderkey % 3]) AS val FROM orders) GROUP BY 1")
def sector_sums(s: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.create_map(F.lit("C000"), F.col("o_orderkey") % 10, F.lit("CNS"), F.col("o_orderkey") % 3))
    return table(s, d, "orders").select(F.explode(F.from_json(j, "map<string,double>")).alias("key", "val")).groupBy("key").agg(F.sum("val").cast("long").alias("total"))


@query("SELECT p_partkey, round(least(coalesce(own, med), 0.6), 6) AS share FROM (SELECT p_partkey, p_brand, CASE WHEN p_size > 20 THEN least(greatest(p_size / 50.0, 0.0), 1.0) END AS own FROM part) LEFT JOIN (SELECT p_brand AS b, median(least(greatest(p_size / 50.0, 0.0), 1.0)) AS med FROM part WHERE p_size > 20 GROUP BY 1) ON p_brand = b")
def parcel_estimate(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 20, F.col("p_size").cast("double")).alias("cov"), F.lit(50.0).alias("tot"))
    return aggregates.class_shares(p, "p_brand", "cov", "tot", 0.6).select("p_partkey", F.round("share", 6).alias("share"))


# windows, ranks, top-k


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part")
def unique_rank(s: SparkSession, d: str) -> DataFrame:
    return ranking.unique_rank(table(s, d, "part"), ["p_brand"], "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "rank")


@query("SELECT p_partkey, round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0) / count(*) OVER (), 9) AS pct FROM part")
def pct_rank_avg_ties(s: SparkSession, d: str) -> DataFrame:
    return ranking.percent_rank_average(table(s, d, "part").select("p_partkey", "p_size"), "p_size", "pct").select("p_partkey", F.round("pct", 9).alias("pct"))


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def keep_first(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    return ranking.keep_first(c, ["c_nationkey"], [-F.col("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey) AS n_cell, floor(c_acctbal * 100 / count(*) OVER (PARTITION BY c_nationkey)) AS part FROM customer")
def group_total_rows(s: SparkSession, d: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("c_nationkey"))
    return table(s, d, "customer").select("c_custkey", n.alias("n_cell"), F.floor(F.col("c_acctbal") * 100 / n).cast("double").alias("part"))


@query("SELECT c_custkey, printf('A%06d', row_number() OVER (ORDER BY c_custkey)) AS anchor_id FROM customer")
def surrogate_ids(s: SparkSession, d: str) -> DataFrame:
    return ranking.numbered(table(s, d, "customer").select("c_custkey"), "A", 6, ["c_custkey"], "anchor_id")


@query("SELECT p_partkey, CASE WHEN r = 1 THEN p_brand ELSE p_brand || ' (' || r || ')' END AS label FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)")
def duplicate_suffix(s: SparkSession, d: str) -> DataFrame:
    return ranking.numbered_duplicates(table(s, d, "part"), "p_brand", "p_partkey", "label").select("p_partkey", "label")


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_nationkey DESC, c_custkey LIMIT 10")
def top_ten(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), F.desc("c_nationkey"), "c_custkey").limit(10)


@query("SELECT o_custkey, round((sum(t) + (3 - count(*)) * 50.0) / 3, 6) AS access FROM (SELECT o_custkey, o_orderkey % 97 AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3 GROUP BY 1")
def topk_anchors_padded(s: SparkSession, d: str) -> DataFrame:
    top = ranking.top_per_group(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", 3)
    return top.groupBy("o_custkey").agg(F.round((F.sum(F.col("o_orderkey") % 97) + (3 - F.count("*")) * 50.0) / 3, 6).alias("access"))


@query(None)
def greedy_selection(s: SparkSession, d: str) -> DataFrame:
    """Rows only: a sequential choice; tests/test_operators.py holds it against known choices."""
    p = table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal", (F.col("s_suppkey") % 37).cast("double").alias("x"), (F.col("s_suppkey") % 23).cast("double").alias("y"))
    return ranking.greedy_spaced(p, "s_nationkey", "s_suppkey", "x", "y", "s_acctbal", 3, 5.0).select("s_nationkey", "s_suppkey")


# set operators


@query("SELECT c_custkey AS k, c_acctbal AS bal, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, NULL, p_brand FROM part")
def union_by_name(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand")), allowMissingColumns=True)


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v FROM lineitem")
def unordered_pairs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("u"), F.greatest("l_partkey", "l_suppkey").alias("v")).distinct()


@query("(SELECT 'left' AS side, c_nationkey AS k FROM (SELECT c_nationkey FROM customer WHERE c_acctbal < -500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000)) UNION ALL (SELECT 'right', s_nationkey FROM (SELECT s_nationkey FROM supplier WHERE s_acctbal < 3000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal < -500))")
def symmetric_difference(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "customer").where("c_acctbal < -500").select(F.col("c_nationkey").alias("k"))
    b = table(s, d, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).select(F.lit("left").alias("side"), "k").unionByName(b.subtract(a).select(F.lit("right").alias("side"), "k"))
