"""Codes looked up in a configured table: the ladder of forms a code may take, overlays, and the table's own checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.functions.text import key_code

#: Uses from the least to the most restrictive, confidences and routes likewise.
USES = ("ByRight", "Conditional", "Unknown", "Prohibited")
CONFIDENCE = ("High", "Medium", "Low")
ROUTES = ("Pass", "Review", "Fail")
COLUMNS = ("jurisdiction", "zoning_code", "district_name", "commercial_parking_use", "confidence", "confidence_reason", "ordinance_citation", "verified_date", "notes")


class CodeTableError(ValueError):
    """Everything that is wrong with a code table."""


def checked_table(table: DataFrame) -> DataFrame:
    """jurisdiction, key, zoning_code, use, confidence of a code table; every fault raises CodeTableError.

    Columns must be complete, uses and confidences known, and codes unique per jurisdiction once case,
    blanks and hyphens are gone. The table is configuration, a few hundred rows.
    """
    missing = [c for c in COLUMNS if c not in table.columns]
    if missing:
        raise CodeTableError(f"missing columns {missing}")
    out = table.select(F.lower(F.trim("jurisdiction")).alias("jurisdiction"), key_code(F.trim("zoning_code")).alias("key"), F.trim("zoning_code").alias("zoning_code"), F.col("commercial_parking_use").alias("use"), "confidence")
    row = out.agg(F.count_if(~F.coalesce(F.col("use").isin(*USES), F.lit(False))).alias("use"), F.count_if(~F.coalesce(F.col("confidence").isin(*CONFIDENCE), F.lit(False))).alias("confidence"), (F.count("*") - F.count_distinct("jurisdiction", "key")).alias("double")).first()
    faults = [f"{n} rows with an unknown commercial_parking_use" for n in [row.use] if n] + [f"{n} rows with an unknown confidence" for n in [row.confidence] if n] + [f"{n} codes listed twice" for n in [row.double] if n]
    if faults:
        raise CodeTableError("; ".join(faults))
    return out


def ladder(code: Column, aliases: dict[str, str], suffixed: tuple[str, ...] = ("PUD", "PC"), prefix: str = "L") -> Column:
    """The keys under which a code is looked up, in order, as an array of (key, limited).

    As written, by its alias, and without the number behind a planned district; then the same without one
    prefix letter, without two, and so on as long as there are any: those are limited codes.
    """
    k = key_code(code)
    named = F.create_map(*[F.lit(x) for a, b in (aliases or {"": ""}).items() for x in (key_code_text(a), key_code_text(b))])
    forms = lambda base, limited: F.array(*[F.struct(c.alias("key"), limited.alias("limited")) for c in (base, F.coalesce(F.try_element_at(named, base), base), F.regexp_replace(base, rf"^({'|'.join(suffixed)})\d+$", "$1"))])
    letters = F.length(F.regexp_extract(k, f"^({prefix}*)", 1))
    deepest = F.least(letters, F.length(k) - 1)
    tries = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(deepest, F.lit(0))), lambda i: forms(F.substr(k, i + 1), i > 0)))
    return F.when(F.length(k) > 0, tries)


def key_code_text(text: str) -> str:
    return "".join(text.upper().replace("-", "").split())


def match_codes(codes: DataFrame, table: DataFrame, aliases: dict[str, str], jurisdiction: str = "jurisdiction", code: str = "code") -> DataFrame:
    """The distinct (jurisdiction, code) of ``codes`` with the table row of the first key that it holds: key, zoning_code, use, confidence, limited.

    Each distinct pair is resolved once, whatever the number of rows; nulls match nothing. Pairs without
    a row keep nulls. table is that of checked_table().
    """
    pairs = codes.select(jurisdiction, code).distinct()
    tries = pairs.select("*", F.posexplode(ladder(F.col(code), aliases)).alias("step", "t")).select(jurisdiction, code, "step", "t.*")
    rows = F.broadcast(table.withColumnRenamed("jurisdiction", "lg_j"))  # configuration
    hits = tries.join(rows, (F.lower(F.trim(jurisdiction)) == F.col("lg_j")) & (tries["key"] == rows["key"])).select(jurisdiction, code, "step", rows["key"], "zoning_code", "use", "confidence", "limited")
    best = hits.groupBy(jurisdiction, code).agg(F.min_by(F.struct("key", "zoning_code", "use", "confidence", "limited"), "step").alias("m"))
    return pairs.join(best.select(F.col(jurisdiction).alias("lg_j"), F.col(code).alias("lg_c"), "m.*"), (F.col("lg_j") == F.col(jurisdiction)) & (F.col("lg_c") == F.col(code)), "left").drop("lg_j", "lg_c")


def route(use: Column, confidence: Column) -> Column:
    return F.when(use.isin("ByRight", "Conditional"), "Pass").when((use == "Unknown") | (confidence == "Low"), "Review").otherwise("Fail")


def worst_of(values: Column, order: tuple[str, ...]) -> Column:
    """The entry of an array that comes last in ``order``; null for an empty one."""
    place = F.array_max(F.transform(values, lambda v: F.array_position(F.array(*map(F.lit, order)), v)))
    return F.try_element_at(F.array(*map(F.lit, order)), F.nullif(place, F.lit(0)).cast("int"))


def resolve_codes(df: DataFrame, table: DataFrame, aliases: dict[str, str], ident: str = "id", zoned: str = "DD", zone_row: str = "DD|ParkingZone") -> DataFrame:
    """ident, screen, confidence, route, matched_code, notes: what the table says about each row of df.

    df: ident, jurisdiction, code, overlays (array), zone, near_boundary. A jurisdiction without rows gets the
    ``*`` row and nothing else. The code's row is found by match_codes(); the row of code ``zoned`` gives
    way to that of the zone, where there is one; codes without a row get the jurisdiction's ``*`` row, then
    the general one. A limited code is for review. Each overlay may make the use stricter (and then
    brings its confidence) and the route too; near a boundary it is for review in any case. Only distinct combinations
    are resolved and then joined back; nulls in any column are missing information, repeated rows stay.
    """
    rows = checked_table(table)
    parts = ["jurisdiction", "code", "overlays", "zone", "near_boundary"]
    known = df.select(ident, *parts).withColumn("lg_q", F.xxhash64(*[F.col(c) for c in parts], *[F.col(c).isNull() for c in parts]))
    asked = known.select("lg_q", *parts).dropDuplicates(["lg_q"])
    matched = match_codes(asked, rows, aliases)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    q = asked.join(matched.withColumnsRenamed({"jurisdiction": "lg_mj", "code": "lg_mc"}), same("jurisdiction", "lg_mj") & same("code", "lg_mc"), "left")
    stated = lambda key: F.broadcast(rows.where(F.col("key") == key).select(F.col("jurisdiction").alias("lg_j"), F.struct("zoning_code", "use", "confidence").alias("r")))
    juris = F.lower(F.trim(F.coalesce("jurisdiction", F.lit(""))))
    listed = F.broadcast(rows.select(F.col("jurisdiction").alias("lg_j")).distinct().withColumn("lg_listed", F.lit(True)))
    q = q.join(listed, juris == F.col("lg_j"), "left").drop("lg_j")
    zones = F.broadcast(rows.where(F.col("key").startswith(key_code_text(zone_row))).select(F.col("jurisdiction").alias("lg_j"), F.col("key").alias("lg_zk"), F.struct("zoning_code", "use", "confidence").alias("lg_zone")))
    q = q.join(zones, (juris == F.col("lg_j")) & (F.col("key") == key_code_text(zoned)) & (F.col("lg_zk") == F.concat(F.lit(key_code_text(zone_row)), F.upper("zone"))), "left").drop("lg_j", "lg_zk")
    q = q.join(stated("*").withColumnRenamed("r", "lg_own"), (juris == F.col("lg_j")) & (F.col("lg_j") != "*"), "left").drop("lg_j")
    q = q.join(F.broadcast(stated("*").where("lg_j = '*'").select(F.col("r").alias("lg_any"), F.lit(True).alias("lg_t"))), F.lit(True) == F.col("lg_t"), "left").drop("lg_t")
    own = F.when(F.col("key").isNotNull(), F.struct("zoning_code", "use", "confidence"))
    listed_, general = F.coalesce("lg_listed", F.lit(False)) & (juris != ""), F.col("lg_any")
    base = F.when(listed_, F.coalesce("lg_zone", own, F.col("lg_own"), general)).otherwise(general)
    q = q.withColumn("b", base).withColumn("found", listed_ & F.col("key").isNotNull()).withColumn("listed", listed_)
    laid = q.where("listed").select("lg_q", juris.alias("lg_j"), F.posexplode("overlays").alias("n", "o")).withColumn("lg_k", key_code(F.col("o")))
    over = laid.join(F.broadcast(rows.withColumnsRenamed({"jurisdiction": "lg_oj", "key": "lg_ok"})), (F.col("lg_j") == F.col("lg_oj")) & (F.col("lg_k") == F.col("lg_ok")), "left")
    rank = F.array_position(F.array(*map(F.lit, USES)), F.col("use"))
    strict = over.groupBy("lg_q").agg(
        F.max_by(F.struct("use", "confidence"), F.when(F.col("use").isNotNull(), F.struct(rank.alias("r"), (-F.col("n")).alias("n")))).alias("worst"), F.collect_list(F.when(F.col("use").isNotNull(), route(F.col("use"), F.col("confidence")))).alias("routes"),
        F.array_sort(F.collect_list(F.when(F.col("use").isNull() & F.col("o").isNotNull(), F.concat(F.lit("overlay not in table: "), "o")))).alias("unknown"),
    )
    q = q.join(strict, "lg_q", "left")
    use, conf = F.coalesce("b.use", F.lit("Unknown")), F.coalesce("b.confidence", F.lit("Low"))
    place = lambda c: F.array_position(F.array(*map(F.lit, USES)), c)
    stricter = F.coalesce(place(F.col("worst.use")) > place(use), F.lit(False))
    limited = F.col("found") & F.coalesce("limited", F.lit(False))
    first = F.when(F.col("b").isNull() | limited, "Review").otherwise(route(use, conf))
    near = F.col("listed") & F.coalesce("near_boundary", F.lit(False))
    out = F.when(near, "Review").otherwise(worst_of(F.concat(F.array(first), F.coalesce("routes", F.array().cast("array<string>"))), ROUTES))
    notes = F.array_compact(F.concat(F.array(F.when(~F.col("listed"), "jurisdiction not in table"), F.when(limited, "limitation text applies"), F.when(F.col("listed") & ~F.col("found"), "code not in table"), F.when(near, "near a boundary")), F.coalesce("unknown", F.array().cast("array<string>"))))
    done = q.select("lg_q", F.when(stricter, F.col("worst.use")).otherwise(use).alias("screen"), F.when(stricter, F.col("worst.confidence")).otherwise(conf).alias("confidence"), out.alias("route"), F.col("b.zoning_code").alias("matched_code"), notes.alias("notes"))
    return known.select(ident, "lg_q").join(done, "lg_q").drop("lg_q")


def reason_tag(notes: Column) -> Column:
    """One word of why a code is for review, from its notes, the weightiest first."""
    has = lambda text: F.exists(notes, lambda n: n.contains(text))
    return F.when(has("limitation"), "limited").when(has("boundary"), "boundary").when(has("jurisdiction"), "jurisdiction").when(has("overlay"), "overlay").otherwise("unknown")
