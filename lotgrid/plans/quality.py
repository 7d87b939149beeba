"""Queries of data-quality checks, code ladders, parameterised SQL and idempotent sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions import rules, text
from lotgrid.operators import orphans
from lotgrid.session import shared_dir, table
from lotgrid.sources.schema import Column, Layer, checks, run_checks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LAYERS = [
    Layer("dq_orders", (Column("o_orderkey", "INTEGER", nullable=False, unique=True), Column("o_orderpriority", "TEXT", codes=("1-URGENT", "2-HIGH", "3-MEDIUM")), Column("o_totalprice", "REAL", low=1000, high=400000)), parents={"o_custkey": ("dq_customer", "c_custkey")}),
    Layer("dq_lineitem", (Column("l_orderkey", "INTEGER", nullable=False), Column("l_quantity", "REAL", low=2, high=49)), parents={"l_partkey": ("dq_part", "p_partkey")}),
]


def _checked(s: SparkSession, d: str, kind: str) -> DataFrame:
    for name in ("orders", "lineitem", "customer", "part"):
        df = table(s, d, name)
        df = df.where("c_custkey % 10 <> 3") if name == "customer" else df.where("p_partkey % 10 <> 3") if name == "part" else df
        df.createOrReplaceTempView(f"dq_{name}")
    return run_checks(s, [c for c in checks(LAYERS) if c[0] == kind]).select("what", "n")


@query("SELECT 'dq_orders.o_orderpriority' AS what, count(*) AS n FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def dq_domain(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d, "domain")


@query("SELECT 'dq_orders.o_totalprice' AS what, count(*) AS n FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 400000 UNION ALL SELECT 'dq_lineitem.l_quantity', count(*) FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49")
def dq_range(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d, "range")


@query("SELECT 'dq_orders.o_orderkey' AS what, count(*) FILTER (o_orderkey IS NULL) AS n FROM orders UNION ALL SELECT 'dq_lineitem.l_orderkey', count(*) FILTER (l_orderkey IS NULL) FROM lineitem")
def dq_required(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d, "required")


@query("SELECT 'dq_orders.o_orderkey' AS what, count(o_orderkey) - count(DISTINCT o_orderkey) AS n FROM orders")
def dq_unique(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d, "unique")


@query("SELECT 'dq_orders.o_custkey' AS what, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3) UNION ALL SELECT 'dq_lineitem.l_partkey', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 <> 3)")
def dq_orphans(s: SparkSession, d: str) -> DataFrame:
    return _checked(s, d, "orphan")


@query("SELECT m AS member, count(*) AS n FROM (SELECT unnest(string_split(o_orderpriority || ';' || o_orderstatus, ';')) AS m FROM orders) WHERE m NOT IN ('1-URGENT', '2-HIGH', 'F') GROUP BY 1")
def dq_members(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "orders").select(F.explode(F.split(F.concat_ws(";", "o_orderpriority", "o_orderstatus"), ";")).alias("member"))
    known = s.createDataFrame([("1-URGENT",), ("2-HIGH",), ("F",)], "member string")
    return m.join(F.broadcast(known), "member", "left_anti").groupBy("member").agg(F.count("*").alias("n"))


@query("SELECT 'customer' AS layer, count(*) AS n, count(*) - count(DISTINCT c_custkey) AS repeated, count(*) FILTER (c_acctbal IS NULL) AS missing, count(*) FILTER (c_nationkey NOT BETWEEN 0 AND 20) AS outside FROM customer")
def dq_layer(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(s, d, "customer").agg(F.lit("customer").alias("layer"), F.count("*").alias("n"), (F.count("*") - F.count_distinct("c_custkey")).alias("repeated"), F.count_if(c("c_acctbal").isNull()).alias("missing"), F.count_if(~c("c_nationkey").between(0, 20)).alias("outside"))


LADDER = (("STANDARDTIN", "A", "Permitted"), ("STANDARD", "B", "Review"), ("PROMO", "C", "Prohibited"))


@query("WITH t(code, grp, use) AS (VALUES ('STANDARDTIN', 'A', 'Permitted'), ('STANDARD', 'B', 'Review'), ('PROMO', 'C', 'Prohibited')), k AS (SELECT p_partkey, regexp_replace(upper(p_type), '[ -]', '', 'g') AS k1, regexp_extract(upper(p_type), '^([A-Z]+)', 1) AS k2 FROM part) SELECT p_partkey, coalesce(a.grp, b.grp) AS grp, coalesce(a.use, b.use) AS use FROM k LEFT JOIN t a ON a.code = k1 LEFT JOIN t b ON b.code = k2")
def code_ladder(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").select("p_partkey", "p_type")
    t = s.createDataFrame(LADDER, "code string, grp string, use string")
    return rules.match_ladder(p, "p_partkey", [text.key_code(F.col("p_type")), F.regexp_extract(F.upper("p_type"), "^([A-Z]+)", 1)], t, "code").select("p_partkey", "grp", "use")


@query("SELECT o_custkey, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 END) WHEN 1 THEN 'F' WHEN 2 THEN 'O' WHEN 3 THEN 'P' END AS status FROM orders GROUP BY 1")
def worst_of(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").groupBy("o_custkey").agg(rules.worst(F.col("o_orderstatus"), ["F", "O", "P"]).alias("status"))


@query("SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice >= 100000 AND c_mktsegment = 'BUILDING' GROUP BY 1")
def named_parameters(s: SparkSession, d: str) -> DataFrame:
    return s.sql(
        "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = :status THEN o_totalprice ELSE 0 END), 2) AS done, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_totalprice >= :low AND c_mktsegment = :segment GROUP BY o_orderpriority",
        args={"status": "F", "low": 100000, "segment": "BUILDING"}, orders=table(s, d, "orders"), customer=table(s, d, "customer"),
    )


@query("SELECT o_orderstatus AS slice, count(*) * CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS n FROM orders GROUP BY 1")
def slice_upsert(s: SparkSession, d: str) -> DataFrame:
    """Write all slices, then one again: only that one is replaced, and nothing is doubled."""
    path = f"{shared_dir(s)}/slices-{uuid.uuid4().hex}"
    n = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("slice")).agg(F.count("*").alias("n"))
    for part in (n, n.where("slice = 'F'").select("slice", (F.col("n") * 2).alias("n"))):
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(path)
    return s.read.parquet(path).select("slice", "n")


@query("WITH refs AS (SELECT o_custkey AS k, o_orderdate AS ts FROM orders), par AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 4 <> 0) SELECT strftime(ts, '%Y-%m') AS period, count(*) AS opened FROM refs ANTI JOIN par USING (k) GROUP BY 1")
def orphan_periods(s: SparkSession, d: str) -> DataFrame:
    refs = table(s, d, "orders").select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("rec_id"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderdate").cast("timestamp").alias("at"))
    par = table(s, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.lit("1900-01-01").cast("timestamp").alias("load_ts"), F.lit(None).cast("timestamp").alias("retired_ts"))
    return orphans.snapshots(orphans.track(refs, par, slices=1)).select("period", "opened")
