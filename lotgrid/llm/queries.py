"""Queries of the operators of this package, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotgrid.functions.keys import parcel_key, parcel_key_sql
from lotgrid.llm import entities, names, packing, sentences, survivors, tokens
from lotgrid.session import table


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "cama"), table(spark, d, "source_trust"), parcel_key(F.col("PARCEL_ID")), survivors.parcel_fields())


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rec = lambda c: F.coalesce(F.col(c), F.lit(-1)).cast("long")
    return p1_survivors(spark, d).where("n_records >= 2").select(F.col("first_rec").alias("group_rec"), rec("land_rec").alias("land_rec"), rec("yr_rec").alias("yr_rec"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.same_owner(table(spark, d, "cama"), "OWNER", parcel_key(F.col("PARCEL_ID")))


def p4_spellings(spark: SparkSession, d: str) -> DataFrame:
    return names.spellings(table(spark, d, "cama"), "OWNER", parcel_key(F.col("PARCEL_ID")))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    return entities.links(table(spark, d, "round1_sample"), table(spark, d, "supplyfacilities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_links(spark, d).select(F.col("sid").alias("sample_facility_id"), F.col("uid").alias("supply_facility_id"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")), table(spark, d, "containers"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_packed(spark, d), table(spark, d, "containers"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_documents(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p4_found": p4_found, "p4_spellings": p4_spellings, "p5_found": p5_found, "p5_links": p5_links, "p7_ids": p7_ids, "p8_packed": p8_packed, "p8_fill": p8_fill, "p9_found": p9_found}
_CAMA = f"""WITH c AS (SELECT {parcel_key_sql('PARCEL_ID')} AS k, rec_id, source_id, coalesce(trust_rank, 2000000000) AS r, coalesce(extract_date, DATE '0001-01-01') AS d, CASE WHEN NOT isnan(LAND_VAL) THEN round(LAND_VAL, 2) END AS land, YRBUILT::DOUBLE AS yr,
coalesce(NOT isnan(LAND_VAL) AND LAND_VAL > 1 AND NOT regexp_matches(try_cast(LAND_VAL AS BIGINT)::VARCHAR, '^9{{5,}}$'), false) AS land_ok, coalesce(YRBUILT >= {survivors.FIRST_YEAR} AND YRBUILT <= year(coalesce(extract_date, load_ts::DATE)), false) AS yr_ok FROM cama LEFT JOIN source_trust USING (source_id)),
g AS (SELECT k, min(rec_id) AS first_rec, count(*) AS n_records FROM c WHERE k IS NOT NULL GROUP BY 1),
land_w AS (SELECT k, land AS v FROM (SELECT k, land, r, d, count(DISTINCT coalesce(source_id, '')) AS n FROM c WHERE land_ok GROUP BY ALL) JOIN (SELECT k, land, min(rec_id) AS f FROM c GROUP BY ALL) USING (k, land) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, d DESC, n DESC, f) = 1),
yr_w AS (SELECT k, yr AS v FROM (SELECT k, yr, r, d, count(DISTINCT coalesce(source_id, '')) AS n FROM c WHERE yr_ok GROUP BY ALL) JOIN (SELECT k, yr, min(rec_id) AS f FROM c GROUP BY ALL) USING (k, yr) QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, d DESC, n DESC, f) = 1),
s AS (SELECT g.k AS group_key, g.first_rec, g.n_records, land_w.v AS land, (SELECT min(rec_id) FROM c WHERE c.k = g.k AND c.land = land_w.v) AS land_rec, yr_w.v AS yr, (SELECT min(rec_id) FROM c WHERE c.k = g.k AND c.yr = yr_w.v) AS yr_rec FROM g LEFT JOIN land_w USING (k) LEFT JOIN yr_w USING (k))
"""
ORACLE: dict[str, str] = {
    "p1_survivors": _CAMA + "SELECT * FROM s",
    "p1_found": _CAMA + "SELECT first_rec AS group_rec, coalesce(land_rec, -1) AS land_rec, coalesce(yr_rec, -1) AS yr_rec FROM s WHERE n_records >= 2",
}
