"""Planar geometry on arrays of points, hexagonal cells, rasters, and joins by place."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.operators.skew import salted_join_on
from lotgrid.session import cut, discard

#: A ring: array<struct<x double, y double>>, open (the first point is not repeated).
SQRT3 = math.sqrt(3.0)


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The ring of an upright rectangle, counter-clockwise from its lower left corner."""
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))


def _turned(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, 1_000_000_000), F.slice(ring, 1, 1))


def area(ring: Column) -> Column:
    cross = F.zip_with(ring, _turned(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2.0


def perimeter(ring: Column) -> Column:
    side = F.zip_with(ring, _turned(ring), lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)))
    return F.aggregate(side, F.lit(0.0), lambda s, v: s + v)


def centroid(ring: Column) -> Column:
    """The centre of area; null for a ring without area."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    total = lambda f: F.aggregate(F.zip_with(ring, _turned(ring), f), F.lit(0.0), lambda s, v: s + v)
    six = F.nullif(3.0 * total(cross), F.lit(0.0))
    return F.struct((total(lambda p, q: (p["x"] + q["x"]) * cross(p, q)) / six).alias("x"), (total(lambda p, q: (p["y"] + q["y"]) * cross(p, q)) / six).alias("y"))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point in a ring, as an expression."""
    cross = F.zip_with(ring, _turned(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]))
    return F.aggregate(cross, F.lit(False), lambda s, v: s != F.coalesce(v, F.lit(False)))


def _clip(subject: list, clip: list) -> float:
    """Area of a polygon within a convex one."""
    sign = 1.0 if sum(p["x"] * q["y"] - q["x"] * p["y"] for p, q in zip(clip, [*clip[1:], clip[0]])) > 0 else -1.0
    out = [(p["x"], p["y"]) for p in subject]
    for p, q in zip(clip, [*clip[1:], clip[0]]):
        ex, ey = q["x"] - p["x"], q["y"] - p["y"]
        side = [sign * (ex * (y - p["y"]) - ey * (x - p["x"])) for x, y in out]
        new = []
        for k in range(len(out)):
            a, b, sa, sb = out[k - 1], out[k], side[k - 1], side[k]
            if (sa >= 0) != (sb >= 0):
                t = sa / (sa - sb)
                new.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if sb >= 0:
                new.append(b)
        out = new
        if not out:
            return 0.0
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, [*out[1:], out[0]]))) / 2


def _convex(ring: list) -> bool:
    p = [(q["x"], q["y"]) for q in ring]
    turns = {math.copysign(1, t) for a, b, c in zip(p, [*p[1:], p[0]], [*p[2:], *p[:2]]) if (t := (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0]))}
    return len(turns) < 2


def shared_area(a: Column, b: Column) -> Column:
    """Area that two rings share: by clipping where the second is convex, by slabs where it is not."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        from lotgrid.operators.areas import areas

        return pd.Series([_clip(list(p), list(q)) if _convex(list(q)) else areas([list(p)], [list(q)])[2] for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def rectangularity(ring: Column) -> Column:
    """Area over the area of the smallest rotated rectangle around a ring."""

    @F.pandas_udf("double")
    def run(rings: pd.Series) -> pd.Series:
        out = []
        for r in rings:
            p = np.array([(q["x"], q["y"]) for q in r])
            e = np.roll(p, -1, 0) - p
            best = math.inf
            for dx, dy in e[np.hypot(e[:, 0], e[:, 1]) > 0]:
                n = math.hypot(dx, dy)
                u, v = p @ np.array([dx, dy]) / n, p @ np.array([-dy, dx]) / n
                best = min(best, (u.max() - u.min()) * (v.max() - v.min()))
            q = np.roll(p, -1, 0)
            out.append(abs((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2 / best if best not in (0, math.inf) else None)
        return pd.Series(out, dtype="float64")

    return run(ring)


def with_bins(df: DataFrame, ring: str, size: float) -> DataFrame:
    """One row per square bin that the ring's bounding box meets, with the box (lg_box) kept."""
    b = df.withColumn("lg_box", bounds(F.col(ring)))
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"lg_box.{lo}") / size), F.floor(F.col(f"lg_box.{hi}") / size))
    return b.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))


def overlaps(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """id_a, id_b, shared of every two rings that share area. left: id_a, ring_a; right: id_b, ring_b.

    Bounding boxes meet in bins; a pair is kept only in the bin that holds the lower left corner of
    the common box, so no pair is tested twice and no distinct is needed.
    """
    a = with_bins(left, "ring_a", size).withColumnRenamed("lg_box", "box_a")
    b = with_bins(right, "ring_b", size).withColumnRenamed("lg_box", "box_b")
    x0, y0 = F.greatest("box_a.x0", "box_b.x0"), F.greatest("box_a.y0", "box_b.y0")
    near = salted_join_on(a, b, ["bx", "by"]).where((x0 < F.least("box_a.x1", "box_b.x1")) & (y0 < F.least("box_a.y1", "box_b.y1")) & (F.floor(x0 / size) == F.col("bx")) & (F.floor(y0 / size) == F.col("by")))
    return near.select("id_a", "id_b", shared_area(F.col("ring_a"), F.col("ring_b")).alias("shared")).where("shared > 0")


def covered_area(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """id_a, covered: summed shared area with all rings of the right (overlaps among them count twice), 0 for none."""
    got = overlaps(left, right, size).groupBy("id_a").agg(F.sum("shared").alias("covered"))
    return left.select("id_a").join(got, "id_a", "left").select("id_a", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def largest_overlap(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """id_a, id_b of the ring that shares most area with each left ring, ties to the smaller id_b."""
    return overlaps(left, right, size).groupBy("id_a").agg(F.min_by("id_b", F.struct((-F.col("shared")).alias("s"), F.col("id_b").alias("i"))).alias("id_b"))


def touching(parts: DataFrame, size: float, gap: float = 0.0) -> DataFrame:
    """a, b (a < b) of rings whose bounding boxes come within ``gap``: neighbours of upright parcels. parts: id, ring."""
    grown = parts.select("id", "ring", bounds(F.col("ring")).alias("box"))
    span = lambda lo, hi: F.sequence(F.floor((F.col(f"box.{lo}") - gap) / size), F.floor((F.col(f"box.{hi}") + gap) / size))
    bins = grown.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1"))).select("id", "box", "bx", "by")
    other = bins.select(F.col("id").alias("id2"), F.col("box").alias("box2"), "bx", "by")
    meet = (F.col("box.x0") <= F.col("box2.x1") + gap) & (F.col("box2.x0") <= F.col("box.x1") + gap) & (F.col("box.y0") <= F.col("box2.y1") + gap) & (F.col("box2.y0") <= F.col("box.y1") + gap)
    first_bin = (F.floor((F.greatest("box.x0", "box2.x0") - gap) / size) == F.col("bx")) & (F.floor((F.greatest("box.y0", "box2.y0") - gap) / size) == F.col("by"))
    return salted_join_on(bins, other, ["bx", "by"]).where((F.col("id") < F.col("id2")) & meet & first_bin).select(F.col("id").alias("a"), F.col("id2").alias("b"))


def within_radius(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """id_a, id_b, dist of planar points within a radius. left: id_a, x, y; right: id_b, x, y."""
    cell = lambda c: F.floor(F.col(c) / radius)
    b = right.select("id_b", F.col("x").alias("x2"), F.col("y").alias("y2"), cell("x").alias("cx"), cell("y").alias("cy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    a = left.select("id_a", "x", "y", F.explode(F.transform(around, lambda d: cell("x") + d)).alias("cx")).withColumn("cy", F.explode(F.transform(around, lambda d: cell("y") + d)))
    d = F.sqrt(F.pow(F.col("x") - F.col("x2"), 2) + F.pow(F.col("y") - F.col("y2"), 2))
    return salted_join_on(a, b, ["cx", "cy"]).withColumn("dist", d).where(F.col("dist") <= radius).select("id_a", "id_b", "dist")


def nearest(left: DataFrame, right: DataFrame, first_radius: float) -> DataFrame:
    """id_a, id_b, dist of the nearest right point of each left point, ties to the smaller id.

    The radius doubles; each round searches only for points that found nothing, so cost follows need.
    It goes on until nobody is left, at the latest at twice the diagonal of the box around all points.
    Points without finite coordinates have no distance: they give no row and are nobody's nearest.
    """
    if not first_radius > 0:
        raise ValueError("nearest needs a radius above 0")
    finite = (F.abs(F.col("x")) < math.inf) & (F.abs(F.col("y")) < math.inf)
    open_, right = cut(left.where(finite).select("id_a", "x", "y"), "open"), cut(right.where(finite).select("id_b", "x", "y"), "right")
    box = open_.select("x", "y").unionByName(right.select("x", "y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    last = 2 * math.hypot(*(float(w or 0) for w in box))
    radius, out = first_radius, None
    while True:
        got = cut(within_radius(open_, right, radius).groupBy("id_a").agg(F.min(F.struct("dist", "id_b")).alias("m")).select("id_a", "m.id_b", "m.dist"), "nearest")
        out = got if out is None else out.unionByName(got)
        if radius > last:
            return out
        open_ = cut(open_.join(got, "id_a", "left_anti"), "open")
        if open_.isEmpty():
            return out
        radius *= 2


def hex_cell(x: Column, y: Column, size: float) -> Column:
    """Axial (q, r) of the pointy-top hexagon with side ``size`` that holds a planar point."""
    q = (x * (SQRT3 / 3) - y / 3.0) / size
    r = y * (2.0 / 3.0) / size
    s = -q - r
    rq, rr, rs = F.bround(q), F.bround(r), F.bround(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    q2 = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    r2 = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.struct(q2.cast("int").alias("q"), r2.cast("int").alias("r"))


def hex_centre(q: Column, r: Column, size: float) -> Column:
    return F.struct((size * SQRT3 * (q + r / 2.0)).alias("x"), (size * 1.5 * r).alias("y"))


def hex_ring(q: Column, r: Column, size: float) -> Column:
    c = hex_centre(q, r, size)
    return F.array(*[F.struct((c["x"] + size * math.cos(math.radians(60 * k - 30))).alias("x"), (c["y"] + size * math.sin(math.radians(60 * k - 30))).alias("y")) for k in range(6)])


def hex_neighbours(cells: DataFrame) -> DataFrame:
    """q, r, q2, r2 of every two adjacent cells of a grid (both directions)."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))])
    around = cells.select("q", "r", F.explode(steps).alias("d")).select("q", "r", (F.col("q") + F.col("d.a")).alias("q2"), (F.col("r") + F.col("d.b")).alias("r2"))
    return around.join(cells.select(F.col("q").alias("q2"), F.col("r").alias("r2")), ["q2", "r2"], "left_semi")


def horn_slope(raster: DataFrame, cell: float) -> DataFrame:
    """row, col, slope in percent by the 3 x 3 Horn kernel; null at edges and next to missing cells.

    Every cell sends its value to its eight neighbours with the weights of the kernel; one aggregation
    over the receiving cell then replaces nine self-joins.
    """
    wx = {(-1, -1): -1, (-1, 1): 1, (0, -1): -2, (0, 1): 2, (1, -1): -1, (1, 1): 1}
    wy = {(-1, -1): -1, (-1, 0): -2, (-1, 1): -1, (1, -1): 1, (1, 0): 2, (1, 1): 1}
    sends = F.array(*[F.struct(F.lit(-dr).alias("dr"), F.lit(-dc).alias("dc"), F.lit(float(wx.get((dr, dc), 0))).alias("wx"), F.lit(float(wy.get((dr, dc), 0))).alias("wy")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    got = raster.where("value is not null").select("row", "col", "value", F.explode(sends).alias("s")).select((F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), (F.col("value") * F.col("s.wx")).alias("gx"), (F.col("value") * F.col("s.wy")).alias("gy"))
    total = got.groupBy("row", "col").agg(F.count("*").alias("n"), (F.sum("gx") / (8 * cell)).alias("gx"), (F.sum("gy") / (8 * cell)).alias("gy"))
    return raster.select("row", "col").join(total, ["row", "col"], "left").select("row", "col", F.when(F.col("n") == 9, 100.0 * F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))).alias("slope"))


def zonal_mean(raster: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """id, mean of the cells whose centre lies in each zone; a cell in several zones counts for the last id.

    raster: x, y, value; zones: id, ring.
    """
    bins = with_bins(zones, "ring", size).select("id", "ring", "bx", "by")
    cells = raster.where("value is not null").withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    hit = salted_join_on(cells, bins, ["bx", "by"], 20_000).where(contains(F.col("ring"), F.col("x"), F.col("y")))
    owned = hit.groupBy("x", "y").agg(F.max("id").alias("id"), F.first("value").alias("value"))
    return owned.groupBy("id").agg(F.avg("value").alias("mean"))


def curb_by_cell(segments: DataFrame, metered: DataFrame, cell_of: Column, sides: int = 2) -> DataFrame:
    """cell, feet: length of local streets by the cell of their middle, both sides, each street once, without metered ones.

    segments: a, b, cls, length, x, y; metered: a, b. Streets drawn in both directions are one.
    """
    pair = lambda df: df.withColumn("k", F.array_sort(F.array("a", "b")))
    one = pair(segments.where("cls = 'local'")).groupBy("k").agg(F.min(F.struct("length", "x", "y")).alias("m")).select("k", "m.*")
    free = one.join(pair(metered).select("k"), "k", "left_anti")
    return free.groupBy(cell_of.alias("cell")).agg((F.sum("length") * sides).alias("feet"))


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(((x - x1) * dx + (y - y1) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - x1 - t * dx, 2) + F.pow(y - y1 - t * dy, 2))


def near_segments(points: DataFrame, segments: DataFrame, reach: float, size: float) -> DataFrame:
    """id_p, id_s, dist of points within ``reach`` of segments. points: id_p, x, y; segments: id_s, x1, y1, x2, y2."""
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / size), F.floor((F.greatest(a, b) + reach) / size))
    bins = segments.withColumn("bx", F.explode(span("x1", "x2"))).withColumn("by", F.explode(span("y1", "y2")))
    at = points.withColumns({"bx": F.floor(F.col("x") / size), "by": F.floor(F.col("y") / size)})
    c = F.col
    return salted_join_on(at, bins, ["bx", "by"]).withColumn("dist", segment_distance(c("x"), c("y"), c("x1"), c("y1"), c("x2"), c("y2"))).where(c("dist") <= reach).select("id_p", "id_s", "dist")


def frontage(parcels: DataFrame, streets: DataFrame, reach: float, step: float, corner_angle: float = 45.0) -> DataFrame:
    """id, frontage, streets, corner: boundary length near streets, how many, and whether two differ in direction.

    parcels: id, ring; streets: id_s, x1, y1, x2, y2. Boundary edges are cut into pieces of at most
    ``step``; a piece counts if its middle lies within ``reach`` of a street.
    """
    edges = parcels.select("id", F.explode(F.zip_with("ring", _turned(F.col("ring")), lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))).alias("e")).select("id", "e.*")
    edges = edges.withColumn("len", F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))).where("len > 0").withColumn("n", F.ceil(F.col("len") / step))
    parts = edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).withColumn("t", (F.col("k") - 0.5) / F.col("n"))
    mid = parts.select(F.struct("id", "x1", "y1", "x2", "y2", "k").alias("id_p"), (F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1"))).alias("x"), (F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))).alias("y"), (F.col("len") / F.col("n")).alias("piece"))
    hits = near_segments(mid.select("id_p", "x", "y"), streets, reach, max(reach * 2, step * 4))
    length = hits.select("id_p").distinct().join(mid.select("id_p", "piece"), "id_p").groupBy(F.col("id_p.id").alias("id")).agg(F.sum("piece").alias("frontage"))
    way = streets.select("id_s", F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0)).alias("b"))
    by = hits.select(F.col("id_p.id").alias("id"), "id_s").distinct().join(way, "id_s").groupBy("id").agg(F.count("*").alias("streets"), F.array_distinct(F.collect_list("b")).alias("bs"))
    apart = F.exists("bs", lambda a: F.exists("bs", lambda b: F.least(F.abs(a - b), F.lit(180.0) - F.abs(a - b)) >= corner_angle))
    return parcels.select("id").join(length, "id", "left").join(by, "id", "left").select("id", F.coalesce("frontage", F.lit(0.0)).alias("frontage"), F.coalesce("streets", F.lit(0)).alias("streets"), F.coalesce(apart, F.lit(False)).alias("corner"))


def hex_grid(area: DataFrame, size: float) -> DataFrame:
    """q, r of the hexagons whose centre lies in a ring of the area (ring column), each once."""
    b = area.select("ring", bounds(F.col("ring")).alias("b"))
    rows = b.withColumn("r", F.explode(F.sequence(F.ceil(F.col("b.y0") / (1.5 * size)).cast("int"), F.floor(F.col("b.y1") / (1.5 * size)).cast("int"))))
    q = lambda x: F.col(x) / (SQRT3 * size) - F.col("r") / 2.0
    cells = rows.withColumn("q", F.explode(F.sequence(F.ceil(q("b.x0")).cast("int"), F.floor(q("b.x1")).cast("int"))))
    c = hex_centre(F.col("q"), F.col("r"), size)
    return cells.where(contains(F.col("ring"), c["x"], c["y"])).select("q", "r").distinct()


def without_holes(cells: DataFrame) -> DataFrame:
    """q, r of a grid and of the cells that it encloses: empty ones that no way over empty cells leads out of its box."""
    from lotgrid.operators.graph import components

    held = cells.select("q", "r").distinct()
    b = held.agg(*[f(c).alias(n) for f, c, n in ((F.min, "q", "q0"), (F.max, "q", "q1"), (F.min, "r", "r0"), (F.max, "r", "r1"))])
    box_ = b.where("q0 is not null").select(F.explode(F.sequence(F.col("r0") - 1, F.col("r1") + 1)).alias("r"), "q0", "q1", "r0", "r1").select(F.explode(F.sequence(F.col("q0") - 1, F.col("q1") + 1)).alias("q"), "r", ((F.col("r") < F.col("r0")) | (F.col("r") > F.col("r1"))).alias("edge"), "q0", "q1")
    empty = cut(box_.join(held, ["q", "r"], "left_anti").select("q", "r", (F.col("edge") | (F.col("q") < F.col("q0")) | (F.col("q") > F.col("q1"))).alias("out"), F.struct("q", "r").alias("id")), "empty")
    pairs = hex_neighbours(empty).select(F.struct("q", "r").alias("a"), F.struct(F.col("q2").alias("q"), F.col("r2").alias("r")).alias("b"))
    labels = components(empty.select("id"), pairs)
    outside = labels.join(empty.where("out").select("id"), "id", "left_semi").select("component").distinct()
    return held.unionByName(labels.join(outside, "component", "left_anti").select("id.q", "id.r"))


def weighted_by_distance(points: DataFrame, known: DataFrame, radius: float, power: float = 2.0) -> DataFrame:
    """id_a, value: the mean of the known values within a radius by 1 / distance ** power; places in one spot take no part.

    points: id_a, x, y; known: id_b, x, y, value.
    """
    near = within_radius(points, known.select("id_b", "x", "y"), radius).where("dist > 0").join(known.select("id_b", "value"), "id_b")
    w = F.pow(F.col("dist"), -power)
    return near.groupBy("id_a").agg((F.sum(F.col("value") * w) / F.sum(w)).alias("value"))


def hold_out_error(known: DataFrame, radius: float, power: float = 2.0) -> DataFrame:
    """n, mae, rmse of weighted_by_distance() at every known place from all others; one row."""
    guess = weighted_by_distance(known.select(F.col("id_b").alias("id_a"), "x", "y"), known, radius, power)
    e = F.col("value") - F.col("stated")
    return guess.join(known.select(F.col("id_b").alias("id_a"), F.col("value").alias("stated")), "id_a").agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
