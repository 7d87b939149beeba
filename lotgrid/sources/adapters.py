"""What each kind of source needs beyond its mapping: one function from raw texts to the layer's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.functions import rules, text
from lotgrid.operators.ranking import keep_first


def stated(c: Column, low: float = 0.0) -> Column:
    """A number that is not below ``low``: sources write negative numbers for missing ones."""
    v = c.try_cast("double")
    return F.when(v >= low, v)


def parcels(raw: DataFrame, assessor: DataFrame, crosswalk: DataFrame, owners: list[tuple[str, str]], overrides: list[tuple[str, str]]) -> DataFrame:
    """parcel_id and the assessor's columns, one row per parcel: lot areas of its parts added up.

    raw: parcel_id, lot_sqft; assessor: parcel_id, code, land, building, owner, year, rec; crosswalk: county_code,
    land_use_class, auto (Y/N), a short list. The first assessor record counts, codes without a class are
    Other, owners are classed by the first rule that fits (blank ones are Unknown) and then by overrides, of which
    the last counts. The improvement ratio is null without a land value.
    """
    lots = raw.where("parcel_id is not null").groupBy("parcel_id").agg(F.sum("lot_sqft").alias("lot_sqft"), F.count("*").alias("parts"))
    first = keep_first(assessor.where("parcel_id is not null"), ["parcel_id"], [F.col("rec")])
    named = text.norm_owner(F.col("owner"))
    kind = F.when(named == "", "Unknown").otherwise(rules.first_match(named, owners, "Private"))
    known = F.broadcast(crosswalk.select(F.col("county_code").alias("code"), "land_use_class", (F.upper("auto") == "Y").alias("auto")))
    return lots.join(first, "parcel_id", "left").join(known, "code", "left").select(
        "parcel_id", "lot_sqft", "parts", "code", F.coalesce("land_use_class", F.lit("Other")).alias("land_use_class"), F.coalesce("auto", F.lit(False)).alias("auto"), "owner",
        rules.last_match(named, kind, overrides).alias("owner_type"), "land", rules.ratio(F.col("building"), F.col("land")).alias("improvement_ratio"), F.when(F.col("year") > 0, F.col("year")).alias("year_built"),
    )


def buildings(raw: DataFrame) -> DataFrame:
    """id, height, levels, geometry kind kept for areas only, one row per id (the tallest)."""
    areas = raw.where(F.col("geometry_type").isin("Polygon", "MultiPolygon") & F.col("id").isNotNull())
    return keep_first(areas.select("id", stated(F.col("height")).alias("height"), stated(F.col("num_floors")).cast("int").alias("levels"), "rings"), ["id"], [-F.coalesce("height", F.lit(-1.0))])


def places(raw: DataFrame, least: float = 0.5, prefix: str = "ovt:") -> DataFrame:
    """place_id, name, category, brand, confidence of places at least so sure; nested names and categories are taken apart."""
    return raw.where(F.col("confidence") >= least).select(F.concat(F.lit(prefix), "id").alias("place_id"), F.col("names.primary").alias("name"), F.col("categories.primary").alias("category"), F.to_json("categories").alias("raw_category"), "brand", "confidence")


def points_of_interest(raw: DataFrame, keys: list[str], named: str = "element_id") -> DataFrame:
    """id, category (key=value of the first key in order that a feature has), name, rooms, capacity; features without one are dropped."""
    tag = rules.first_reason([(F.coalesce(F.col(f"properties.{k}"), F.lit("")) != "", k) for k in keys])
    return raw.select(F.col(named).alias("id"), "properties", "x", "y", tag.alias("k")).where("k is not null").select("id", F.concat_ws("=", "k", F.try_element_at("properties", F.col("k"))).alias("category"), F.col("properties.name").alias("name"), text.first_number(F.col("properties.rooms")).alias("rooms"), text.first_number(F.col("properties.capacity")).alias("capacity"), "x", "y")


def parking(raw: DataFrame, named: str = "element_id") -> DataFrame:
    """Car parks with numbers read out of their tags; levels from either tag."""
    p = lambda k: F.try_element_at("properties", F.lit(k))
    return raw.where(p("amenity") == "parking").select(F.col(named).alias("id"), p("name").alias("name"), p("operator").alias("operator"), p("parking").alias("parking"), p("fee").alias("fee"), p("access").alias("access"), text.first_number(p("capacity")).alias("capacity"), F.coalesce(text.first_number(p("building:levels")), text.first_number(p("levels"))).alias("levels"), "geometry_type", "x", "y", "rings")


def jobs(raw: DataFrame, lookup: DataFrame, sectors: list[str]) -> tuple[DataFrame, DataFrame]:
    """(block, jobs, sectors as JSON, lat, lon of blocks with a place; one row: blocks and jobs without one).

    raw: w_geocode, C000 and the sector columns, as texts; lookup: tabblk2020, blklatdd, blklondd.
    """
    number = lambda c: F.coalesce(F.col(c).try_cast("long"), F.lit(0))
    parts = F.to_json(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, sectors)), F.array(*map(number, sectors))), lambda _, v: v > 0))
    at = lookup.select(F.col("tabblk2020").alias("block"), F.col("blklatdd").try_cast("double").alias("lat"), F.col("blklondd").try_cast("double").alias("lon"))
    both = raw.select(F.col("w_geocode").alias("block"), number("C000").alias("jobs"), parts.alias("sectors")).join(at, "block", "left")
    return both.where("lat is not null and lon is not null"), both.where("lat is null or lon is null").agg(F.count("*").alias("blocks"), F.coalesce(F.sum("jobs"), F.lit(0)).alias("jobs"))


def census(raw: DataFrame, sums: dict[str, list[str]], ratios: dict[str, tuple[str, str]], key: str = "GEOID") -> DataFrame:
    """key, each named sum of columns and each ratio of sums. Negative numbers are missing; a sum without any is null."""
    n = lambda c: stated(F.col(c))
    total = lambda cols: F.when(F.coalesce(*map(n, cols)).isNotNull(), sum((F.coalesce(n(c), F.lit(0.0)) for c in cols), F.lit(0.0)))
    out = raw.select(key, *[total(cols).alias(name) for name, cols in sums.items()])
    return out.select("*", *[rules.ratio(F.col(a), F.col(b)).alias(name) for name, (a, b) in ratios.items()])


def hospitals(raw: DataFrame) -> DataFrame:
    """raw with beds that are no number of beds (negative stand-ins) nulled."""
    return raw.withColumn("beds", stated(F.col("beds")).cast("int"))


def venues(raw: DataFrame) -> DataFrame:
    """raw with stand-ins for seats and events nulled, one row per venue_id (the latest)."""
    good = raw.withColumns({c: stated(F.col(c)).cast("int") for c in ("seats", "events_per_year")})
    return keep_first(good, ["venue_id"], [-F.unix_micros(F.col("load_ts").cast("timestamp")), F.col("rec_id")])


def institutions(raw: DataFrame, enrolment: DataFrame, where: dict[str, str], total: str = "EFYTOTLT", key: str = "UNITID") -> DataFrame:
    """raw with the enrolment of the level that ``where`` names; institutions without one keep null."""
    level = enrolment
    for c, v in where.items():
        level = level.where(F.col(c) == v)
    return raw.join(level.groupBy(key).agg(F.max(stated(F.col(total))).alias("enrolment")), key, "left")


def traffic(raw: DataFrame) -> DataFrame:
    """station, the count of its latest year, and the route."""
    n = raw.select(F.col("STATION_ID").alias("station"), stated(F.col("AADT")).alias("aadt"), F.col("YEAR").try_cast("int").alias("year"), F.col("ROUTE").alias("route")).where("station is not null")
    return keep_first(n, ["station"], [-F.coalesce("year", F.lit(0)), -F.coalesce("aadt", F.lit(0.0))])


def floods(raw: DataFrame) -> DataFrame:
    """raw with floodway (named in the subtype) and high_risk flags."""
    return raw.withColumns({"floodway": F.coalesce(F.upper("ZONE_SUBTY").contains("FLOODWAY"), F.lit(False)), "high_risk": F.coalesce(F.col("SFHA_TF") == "T", F.lit(False))})


def contaminated(raw: DataFrame, programmes: list[str]) -> DataFrame:
    """raw with whether a site is in any programme of the list, however its list is spaced."""
    mine = F.transform(F.split(F.coalesce("PGM_SYS_ACRNM", F.lit("")), ","), lambda v: F.upper(F.trim(v)))
    return raw.withColumn("listed", F.arrays_overlap(mine, F.array(*[F.lit(p.upper()) for p in programmes])))


def meters(raw: DataFrame, described: str = "description") -> DataFrame:
    """raw with metered and permit flags read from a description."""
    return raw.withColumns({"metered": rules.whole_word(F.col(described), ["meter", "meters", "metered"]), "permit": rules.whole_word(F.col(described), ["permit", "permits"])})


def overlays(raw: DataFrame, kinds: dict[str, str], kind: str = "kind") -> DataFrame:
    """raw with the code of each overlay type; a type without one is an error, counted once for all rows."""
    out = raw.withColumn("code", rules.mapped(F.col(kind), kinds, None))
    unknown = [r[0] for r in out.where("code is null").select(kind).distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"overlay types without a code: {sorted(map(str, unknown))}")
    return out


def rasters(tiles: DataFrame) -> DataFrame:
    """tile, url of the newest publication of each tile, ties to the later url."""
    return tiles.groupBy("tile").agg(F.max_by("url", F.struct("published", "url")).alias("url"))


def nested_as_text(df: DataFrame) -> DataFrame:
    """df with arrays of texts joined by a semicolon and other nested columns as JSON."""
    flat = lambda f: F.array_join(f.name, ";") if f.dataType.simpleString() == "array<string>" else F.to_json(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name)
    return df.select(*[flat(f).alias(f.name) for f in df.schema])
