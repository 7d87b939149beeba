"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions.keys import parcel_key, parcel_key_sql
from lotgrid.operators import nearby, orphans, packed
from lotgrid.session import table


def reference_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    one = lambda name, col: table(spark, d, name).select(F.lit(name).alias("table_name"), "rec_id", parcel_key(F.col(col)).alias("key"), F.col("load_ts").alias("at"))
    refs = one("cama", "PARCEL_ID").unionByName(one("candidateparcels", "parcel_id"))
    return refs, table(spark, d, "parcels").select(parcel_key(F.col("parcel_id")).alias("key"), "load_ts", "retired_ts")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.found(orphans.track(*reference_events(spark, d)))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return orphans.snapshots(orphans.track(*reference_events(spark, d)))


def p3_found(spark: SparkSession, d: str, radius_m: float = 400.0) -> DataFrame:
    sample, venues, hospitals = (nearby.positions(table(spark, d, t), {"id": "rec_id"}) for t in ("round1_sample", "venues", "hospitals_cms"))
    as_side = lambda df, name, *kinds: df.select(F.col("id").alias(name), "lat", "lon", F.explode(F.array(*map(F.lit, kinds))).alias("kind"))
    left = as_side(sample, "id_l", "sample_venue", "sample_hospital").unionByName(as_side(venues, "id_l", "venue_hospital"))
    right = as_side(venues, "id_r", "sample_venue").unionByName(as_side(hospitals, "id_r", "sample_hospital", "venue_hospital"))
    near = nearby.near_pairs(left, right, radius_m, group="kind").select("kind", F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b"))
    within = nearby.inside_regions(sample.withColumnRenamed("id", "id_p"), table(spark, d, "submarkets").select(F.col("submarket_id").alias("id_g"), "wkt"))
    within = within.select(F.lit("sample_submarket").alias("kind"), F.least("id_p", "id_g").alias("id_a"), F.greatest("id_p", "id_g").alias("id_b"))
    return near.unionByName(within)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, col: packed.unpack(table(spark, d, name), ["rec_id"], col).select(F.lit(name).alias("table_name"), "rec_id", "item_no", "item")
    return one("round1_sample", "osm_ids").unionByName(one("candidateparcels", "member_parcel_ids"))


QUERIES = {"p2_found": p2_found, "p2_snapshots": p2_snapshots, "p3_found": p3_found, "p6_found": p6_found}

_REFS = f"""WITH refs AS (SELECT 'cama' AS table_name, rec_id, {parcel_key_sql('PARCEL_ID')} AS k, load_ts FROM cama UNION ALL SELECT 'candidateparcels', rec_id, {parcel_key_sql('parcel_id')}, load_ts FROM candidateparcels),
par AS (SELECT {parcel_key_sql('parcel_id')} AS k, min(load_ts) AS f, max(retired_ts) AS u FROM parcels GROUP BY 1)
"""
_PLACE = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"
_PAIRS = "SELECT '{kind}' AS kind, least(a.rec_id, b.rec_id) AS id_a, greatest(a.rec_id, b.rec_id) AS id_b FROM (SELECT * FROM {a} WHERE " + _PLACE + ") a, (SELECT * FROM {b} WHERE " + _PLACE + ") b WHERE 2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 400"
_INSIDE = """SELECT 'sample_submarket' AS kind, least(p.rec_id, e.id) AS id_a, greatest(p.rec_id, e.id) AS id_b FROM (SELECT * FROM round1_sample WHERE """ + _PLACE + """) p, (
SELECT id, ring, split_part(trim(t), ' ', 1)::DOUBLE AS x1, split_part(trim(t), ' ', 2)::DOUBLE AS y1, split_part(trim(n), ' ', 1)::DOUBLE AS x2, split_part(trim(n), ' ', 2)::DOUBLE AS y2 FROM (
SELECT id, ring, t, lead(t) OVER (PARTITION BY id, ring ORDER BY o) AS n FROM (SELECT id, ring, unnest(string_split(r, ',')) AS t, unnest(range(len(string_split(r, ',')))) AS o FROM (
SELECT submarket_id AS id, unnest(regexp_extract_all(wkt, '\\(([^()]+)\\)', 1)) AS r, unnest(range(len(regexp_extract_all(wkt, '\\(([^()]+)\\)', 1)))) AS ring FROM submarkets))) WHERE n IS NOT NULL) e
WHERE (e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < (e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1 GROUP BY p.rec_id, e.id HAVING count(*) % 2 = 1"""

ORACLE: dict[str, str] = {
    "p2_found": _REFS + "SELECT table_name, strftime(load_ts, '%Y-%m') AS period, rec_id FROM refs LEFT JOIN par USING (k) WHERE k IS NOT NULL AND load_ts IS NOT NULL AND (f IS NULL OR load_ts < f OR coalesce(load_ts >= u, false))",
    "p2_snapshots": _REFS + """, r AS (SELECT table_name, load_ts AS came, f, u, f IS NULL OR load_ts < f AS early, f IS NOT NULL AND load_ts >= f AND coalesce(load_ts >= u, false) AS dead, f IS NOT NULL AND coalesce(u > f, true) AS ever FROM refs LEFT JOIN par USING (k) WHERE k IS NOT NULL AND load_ts IS NOT NULL),
e AS (SELECT table_name, came AS t, 1 AS o, 0 AS s, 0 AS p FROM r WHERE early OR dead UNION ALL SELECT table_name, f, 0, 1, 0 FROM r WHERE early AND ever UNION ALL SELECT table_name, u, 0, 0, 1 FROM r WHERE ever AND NOT dead AND u IS NOT NULL),
m AS (SELECT table_name, strftime(t, '%Y-%m') AS period, sum(o)::BIGINT AS opened, sum(s)::BIGINT AS resolved, sum(p)::BIGINT AS reopened FROM e GROUP BY 1, 2)
SELECT *, sum(opened - resolved + reopened) OVER (PARTITION BY table_name ORDER BY period)::BIGINT AS open_at_end FROM m""",
    "p3_found": " UNION ALL ".join([_PAIRS.format(kind="sample_venue", a="round1_sample", b="venues"), _PAIRS.format(kind="sample_hospital", a="round1_sample", b="hospitals_cms"), _PAIRS.format(kind="venue_hospital", a="venues", b="hospitals_cms"), _INSIDE]),
}
