"""Points near other points, and the regions that contain points, by grid hashing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.operators.skew import salted_join, salted_join_on

EARTH_M = 6_371_000.0


def positions(df: DataFrame, ids: dict[str, str], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """id columns (new name: old name), lat, lon of the rows with a position.

    Null, NaN and out-of-range values and 0/0 are no position; any other value counts as written.
    """
    y, x = F.col(lat).cast("double"), F.col(lon).cast("double")
    ok = y.between(-90, 90) & x.between(-180, 180) & ~((y == 0) & (x == 0))
    return df.where(ok).select(*[F.col(old).alias(new) for new, old in ids.items()], y.alias("lat"), x.alias("lon"))


def great_circle_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def _columns(row: Column, height: float) -> Column:
    """Cells around the globe in a row of latitude, each at least ``height`` wide in distance."""
    edge = F.greatest(F.abs(row * F.lit(height)), F.abs((row + 1) * F.lit(height)))
    return F.greatest(F.floor(F.lit(360.0 / height) * F.cos(F.radians(F.least(edge, F.lit(90.0))))), F.lit(1))


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, rows: int = 4_000, group: str | None = None) -> DataFrame:
    """id_l, id_r, dist_m (and ``group``, where both sides have such a column and only equal ones meet) of all pairs at most ``radius_m`` apart on the sphere.

    left: id_l, lat, lon; right: id_r, lat, lon (both from positions()). Points on the right are hashed
    to one cell of a grid as high as the radius; each point on the left looks into the cells that its
    bounding box meets (wrapping at 180 degrees), then the exact distance decides. Points in one
    place, repeated rows and poles need no special case; empty sides give no rows.
    """
    reach = math.degrees(radius_m / EARTH_M)
    height = reach * 1.000001
    row_r = F.floor(F.col("lat") / F.lit(height))
    wide = lambda row: F.lit(360.0) / _columns(row, height)
    kept = [group] if group else []
    cell = lambda row, col: F.xxhash64(row.cast("long"), col.cast("long"), *[F.col(g) for g in kept])
    b = right.select("id_r", *[F.col(g).alias("lg_group") for g in kept], F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"), cell(row_r, F.floor((F.pmod(F.col("lon"), F.lit(360.0))) / wide(row_r))).alias("cell"))
    around = left.select("id_l", *kept, F.col("lat").alias("lat_l"), F.col("lon").alias("lon_l"), F.explode(F.sequence(F.floor((F.col("lat") - reach) / F.lit(height)), F.floor((F.col("lat") + reach) / F.lit(height)))).alias("row"))
    ratio = F.lit(math.sin(radius_m / EARTH_M)) / F.cos(F.radians("lat_l"))
    dlon = F.when(ratio < 1, F.degrees(F.asin(ratio)) * 1.000001).otherwise(180.0)
    n = _columns(F.col("row"), height).cast("long")
    first = F.floor((F.col("lon_l") - dlon) / (F.lit(360.0) / n))
    last = F.least(F.floor((F.col("lon_l") + dlon) / (F.lit(360.0) / n)), first + n - 1)
    a = around.select("id_l", *kept, "lat_l", "lon_l", "row", n.alias("n"), F.explode(F.sequence(first, last)).alias("col")).select("id_l", *kept, "lat_l", "lon_l", cell(F.col("row"), F.pmod(F.col("col"), F.col("n"))).alias("cell"))
    d = great_circle_m(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    met = salted_join(a, b, "cell", rows)
    met = met.where(F.col(group) == F.col("lg_group")) if group else met
    return met.withColumn("dist_m", d).where(F.col("dist_m") <= radius_m).select("id_l", "id_r", "dist_m", *kept)


def rings(wkt: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON text, each an array of (x, y); null for any other text."""
    texts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))
    point = lambda p: F.struct(F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("y"))
    return F.when(F.upper(F.trim(wkt)).rlike(r"^(MULTI)?POLYGON"), F.transform(texts, lambda t: F.transform(F.split(t, ","), point)))


def inside_regions(points: DataFrame, regions: DataFrame, cell0: float = 0.002, sub: int = 8, rows: int = 20_000) -> DataFrame:
    """id_p, id_g of every point and every region that contains it.

    points: id_p, lat, lon; regions: id_g, wkt (longitude first; even-odd rule, so holes are outside).
    A region is hashed at the grid level whose cells are about as large as its bounding box, so it
    meets few cells whatever its size; a point looks up one cell per level in use. Candidates are then
    tested exactly: crossings of the ray to the east with those edges of the region that lie in the
    point's strip of latitude. All of it is column expressions and equi-joins, and both joins spread a
    crowded cell and a crowded region over tasks.
    """
    shapes = regions.select("id_g", rings(F.col("wkt")).alias("rings")).where("rings is not null")
    edges = shapes.select("id_g", F.explode("rings").alias("ring")).select(
        "id_g", F.explode(F.zip_with(F.col("ring"), F.concat(F.slice("ring", 2, 1_000_000_000), F.slice("ring", 1, 1)), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))).alias("e")
    ).select("id_g", "e.*").where("x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    box = edges.groupBy("id_g").agg(F.min("x1").alias("x0"), F.max("x1").alias("x9"), F.min("y1").alias("y0"), F.max("y1").alias("y9"))
    size = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(cell0))
    box = box.withColumn("level", F.greatest(F.ceil(F.log2(size / cell0)), F.lit(0)).cast("int")).withColumn("step", F.lit(cell0) * F.pow(F.lit(2.0), F.col("level")))
    cells = box.select(
        "id_g", "level", "step", "x0", "x9", "y0", "y9",
        F.explode(F.sequence(F.floor(F.col("x0") / F.col("step")), F.floor(F.col("x9") / F.col("step")))).alias("cx"),
    ).select("*", F.explode(F.sequence(F.floor(F.col("y0") / F.col("step")), F.floor(F.col("y9") / F.col("step")))).alias("cy"))
    levels = F.broadcast(box.groupBy("level", "step").agg(F.lit(1).alias("lg_one")))  # at most one row per power of two of a size on the globe
    probes = points.select("id_p", "lat", "lon", F.lit(1).alias("lg_one")).join(levels, "lg_one").select("id_p", "lat", "lon", "level", "step", F.floor(F.col("lon") / F.col("step")).alias("cx"), F.floor(F.col("lat") / F.col("step")).alias("cy"))
    near = salted_join_on(probes, cells.drop("step"), ["level", "cx", "cy"], rows).where("lon between x0 and x9 and lat between y0 and y9")
    near = near.select("id_p", "id_g", "lat", "lon", F.floor(F.col("lat") / F.col("step") * sub).alias("strip"))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    strips = edges.where("y1 <> y2").join(box.select("id_g", "step"), "id_g").select(
        "id_g", "x1", "y1", "x2", "y2", F.explode(F.sequence(F.floor(low / F.col("step") * sub), F.floor(high / F.col("step") * sub))).alias("strip")
    )
    y, x = F.col("lat"), F.col("lon")
    crosses = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1"))
    hits = salted_join_on(near, strips, ["id_g", "strip"], rows).where(crosses).groupBy("id_p", "id_g").agg(F.count("*").alias("n"))
    return hits.where("n % 2 = 1").select("id_p", "id_g")
