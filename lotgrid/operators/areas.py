"""Polygons of any shape, with holes and several parts: areas of their overlaps, unions and rests, and repair.

A shape is an array of rings (arrays of points); a place is inside if a ray from it crosses the rings an
odd number of times, so holes and parts need no order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.operators import geometry
from lotgrid.operators.skew import salted_join_on

SHAPE = "array<array<struct<x:double,y:double>>>"


def as_shape(ring: Column) -> Column:
    """A shape of one ring."""
    return F.array(ring)


def _edges(shape: list) -> np.ndarray:
    """x1, y1, x2, y2 of the sloping and upright edges, lower end first."""
    out = []
    for ring in shape:
        p = np.array([(q["x"], q["y"]) for q in ring], float)
        if len(p) > 2:
            out.append(np.hstack([p, np.roll(p, -1, 0)]))
    e = np.vstack(out) if out else np.zeros((0, 4))
    e = e[e[:, 1] != e[:, 3]]
    return np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)


def _heights(e: np.ndarray) -> np.ndarray:
    """The heights between which no two edges cross: those of all ends and crossings."""
    levels = [e[:, 1], e[:, 3]]
    d = e[:, 2:] - e[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    w = e[None, :, :2] - e[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (w[..., 0] * d[None, :, 1] - w[..., 1] * d[None, :, 0]) / cross
        u = (w[..., 0] * d[:, None, 1] - w[..., 1] * d[:, None, 0]) / cross
    met = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    levels.append((e[:, None, 1] + t * d[:, None, 1])[met])
    return np.unique(np.concatenate(levels))


def areas(a: list, b: list) -> tuple[float, float, float]:
    """The area of each of two shapes and what they share, exactly, by slabs between crossing heights.

    Within a slab edges do not cross, so widths change evenly and the middle of the slab gives its area.
    """
    ea, eb = _edges(a), _edges(b)
    if not len(ea) and not len(eb):
        return 0.0, 0.0, 0.0
    e = np.vstack([ea, eb])
    mine = np.arange(len(e)) < len(ea)
    levels = _heights(e)
    total = np.zeros(3)
    for low, high in zip(levels, levels[1:]):
        y = (low + high) / 2
        on = (e[:, 1] < y) & (e[:, 3] > y)
        if not on.any():
            continue
        s = e[on]
        x = s[:, 0] + (y - s[:, 1]) / (s[:, 3] - s[:, 1]) * (s[:, 2] - s[:, 0])
        order = np.argsort(x)
        x, own = x[order], mine[on][order]
        in_a, in_b = np.cumsum(own) % 2 == 1, np.cumsum(~own) % 2 == 1
        width = np.diff(x, append=x[-1:])
        total += (high - low) * np.array([width[in_a].sum(), width[in_b].sum(), width[in_a & in_b].sum()])
    return tuple(total)


def overlay(a: Column, b: Column) -> Column:
    """area_a, area_b, shared, joined (of the union) and only_a of two shapes; null if one is null."""

    @F.pandas_udf("area_a double, area_b double, shared double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if p is None or q is None else areas(p, q) for p, q in zip(x, y)]
        return pd.DataFrame(rows, columns=["area_a", "area_b", "shared"]).astype(float)

    got = run(a, b)
    return F.struct(got["area_a"].alias("area_a"), got["area_b"].alias("area_b"), got["shared"].alias("shared"), (got["area_a"] + got["area_b"] - got["shared"]).alias("joined"), (got["area_a"] - got["shared"]).alias("only_a"))


def met_by_box(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """id_a, shape_a, id_b, shape_b whose bounding boxes meet, each pair once. left: id_a, shape_a; right: id_b, shape_b."""

    def binned(df: DataFrame, side: str) -> DataFrame:
        box = geometry.bounds(F.flatten(f"shape_{side}"))
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"box_{side}.{lo}") / size), F.floor(F.col(f"box_{side}.{hi}") / size))
        return df.withColumn(f"box_{side}", box).where(F.col(f"box_{side}.x0").isNotNull()).withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))

    x0, y0 = F.greatest("box_a.x0", "box_b.x0"), F.greatest("box_a.y0", "box_b.y0")
    met = salted_join_on(binned(left, "a"), binned(right, "b"), ["bx", "by"])
    here = (F.floor(x0 / size) == F.col("bx")) & (F.floor(y0 / size) == F.col("by"))
    return met.where((x0 <= F.least("box_a.x1", "box_b.x1")) & (y0 <= F.least("box_a.y1", "box_b.y1")) & here).select("id_a", "shape_a", "id_b", "shape_b")


def intersections(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """id_a, id_b, area_a, area_b, shared of every two shapes of any form that share area."""
    return met_by_box(left, right, size).select("id_a", "id_b", overlay(F.col("shape_a"), F.col("shape_b")).alias("o")).select("id_a", "id_b", "o.area_a", "o.area_b", "o.shared").where("shared > 0")


def substantial_overlaps(shapes: DataFrame, size: float, least: float = 0.05) -> DataFrame:
    """a, b (a < b) of shapes that share more than ``least`` of the smaller one. shapes: id, shape."""
    one = lambda s: shapes.select(F.col("id").alias(f"id_{s}"), F.col("shape").alias(f"shape_{s}"))
    pairs = met_by_box(one("a"), one("b"), size).where("id_a < id_b").select("id_a", "id_b", overlay(F.col("shape_a"), F.col("shape_b")).alias("o"))
    return pairs.where(F.col("o.shared") > least * F.least("o.area_a", "o.area_b")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def close_shapes(shapes: DataFrame, size: float, gap: float = 0.0) -> DataFrame:
    """a, b (a < b) of shapes whose boundaries come within ``gap``, or one of which lies in the other.

    Candidates are those whose boxes, grown by the gap, meet; then every two edges are measured. shapes: id, shape.
    """
    grown = lambda shape: F.concat(shape, F.array(F.transform(F.array(*[F.struct(F.lit(dx * gap).alias("dx"), F.lit(dy * gap).alias("dy")) for dx in (-1, 1) for dy in (-1, 1)]), lambda d: F.struct((F.when(d["dx"] < 0, geometry.bounds(F.flatten(shape))["x0"]).otherwise(geometry.bounds(F.flatten(shape))["x1"]) + d["dx"]).alias("x"), (F.when(d["dy"] < 0, geometry.bounds(F.flatten(shape))["y0"]).otherwise(geometry.bounds(F.flatten(shape))["y1"]) + d["dy"]).alias("y")))))

    @F.pandas_udf("double")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([distance(list(p)[:-1], list(q)) for p, q in zip(x, y)], dtype=float)

    left = shapes.select(F.col("id").alias("id_a"), grown(F.col("shape")).alias("shape_a"))
    right = shapes.select(F.col("id").alias("id_b"), F.col("shape").alias("shape_b"))
    return met_by_box(left, right, size).where("id_a < id_b").where(apart(F.col("shape_a"), F.col("shape_b")) <= gap).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def distance(a: list, b: list) -> float:
    """The least distance of two shapes: 0 if they share a point, infinite if one has none."""

    def sides(shape: list) -> np.ndarray:
        rings = [np.array([(q["x"], q["y"]) for q in r], float) for r in shape if len(r)]
        return np.vstack([np.hstack([p, np.roll(p, -1, 0)]) for p in rings]) if rings else np.zeros((0, 4))

    s, t = sides(a), sides(b)
    if not len(s) or not len(t):
        return np.inf

    def to_side(p: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = e[None, :, 2:] - e[None, :, :2]
        w = p[:, None] - e[None, :, :2]
        length = (d**2).sum(-1)
        k = np.clip((w * d).sum(-1) / np.where(length == 0, 1, length), 0, 1)
        return np.hypot(*np.moveaxis(w - k[..., None] * d, -1, 0))

    least = min(to_side(s[:, :2], t).min(), to_side(t[:, :2], s).min())
    if least == 0:
        return 0.0
    side = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    p, q, u, v = s[:, None, :2], s[:, None, 2:], t[None, :, :2], t[None, :, 2:]
    crossing = (side(p, q, u) * side(p, q, v) < 0) & (side(u, v, p) * side(u, v, q) < 0)
    inside = lambda x, y, e: bool((((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / np.where(e[:, 3] == e[:, 1], 1, e[:, 3] - e[:, 1]) + e[:, 0])).sum() % 2)
    return 0.0 if crossing.any() or inside(*s[0, :2], t) or inside(*t[0, :2], s) else float(least)


def repaired(shape: Column, sliver: float = 1e-4) -> Column:
    """A shape without points that repeat the one before, unclosed or flat rings and parts under ``sliver`` in area; null if nothing is left."""
    closed = lambda r: F.when((F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1)), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    finite = lambda r: F.filter(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    once = lambda r: F.filter(r, lambda p, i: (i == 0) | (p != F.get(r, i - 1)))
    rings = F.filter(F.transform(shape, lambda r: closed(once(finite(r)))), lambda r: (F.size(r) >= 3) & (geometry.area(r) > sliver))
    return F.when(F.size(rings) > 0, rings)


def inner_point(shape: Column) -> Column:
    """A point that surely lies inside: the middle of the widest stretch at the middle height of the shape's box."""

    @F.pandas_udf("x double, y double")
    def run(shapes: pd.Series) -> pd.DataFrame:
        out = []
        for s in shapes:
            e = _edges(list(s)) if s is not None else np.zeros((0, 4))
            if not len(e):
                out.append((None, None))
                continue
            levels = np.unique(np.concatenate([e[:, 1], e[:, 3]]))
            middle = (levels[0] + levels[-1]) / 2
            k = int(np.searchsorted(levels, middle, side="right"))
            y = middle if middle not in levels else (levels[k - 1] + levels[min(k, len(levels) - 1)]) / 2
            on = e[(e[:, 1] < y) & (e[:, 3] > y)]
            x = np.sort(on[:, 0] + (y - on[:, 1]) / (on[:, 3] - on[:, 1]) * (on[:, 2] - on[:, 0]))
            wide = (x[1::2] - x[::2]).argmax() if len(x) > 1 else 0
            out.append(((x[2 * wide] + x[2 * wide + 1]) / 2, y) if len(x) > 1 else (None, None))
        return pd.DataFrame(out, columns=["x", "y"]).astype(float)

    return run(shape)


def along(line: Column, share: float = 0.5) -> Column:
    """The point of a line (array of points) at a share of its length."""
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, 1_000_000_000), lambda p, q: F.struct(p.alias("p"), q.alias("q"), F.sqrt(F.pow(q["x"] - p["x"], 2) + F.pow(q["y"] - p["y"], 2)).alias("l")))
    whole = F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["l"])
    start = F.struct(F.lit(0.0).alias("gone"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def walk(s: Column, e: Column) -> Column:
        t = (whole * share - s["gone"]) / F.nullif(e["l"], F.lit(0.0))
        here = s["x"].isNull() & (s["gone"] + e["l"] >= whole * share) & (e["l"] > 0)
        return F.struct((s["gone"] + e["l"]).alias("gone"), F.when(here, e["p"]["x"] + t * (e["q"]["x"] - e["p"]["x"])).otherwise(s["x"]).alias("x"), F.when(here, e["p"]["y"] + t * (e["q"]["y"] - e["p"]["y"])).otherwise(s["y"]).alias("y"))

    return F.aggregate(steps, start, walk, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def kept_in_area(shapes: DataFrame, study: DataFrame, size: float) -> DataFrame:
    """The repaired shapes that touch a shape of the study area, whole and not cut. shapes: id, shape, ...; study: shape."""
    good = shapes.withColumn("shape", repaired(F.col("shape"))).where("shape is not null")
    apart = lambda x, y: pd.Series([distance(list(p), list(q)) for p, q in zip(x, y)], dtype=float)
    near = met_by_box(good.select(F.col("id").alias("id_a"), F.col("shape").alias("shape_a")), study.select(F.lit(0).alias("id_b"), repaired(F.col("shape")).alias("shape_b")).where("shape_b is not null"), size)
    hit = near.where(F.pandas_udf(apart, "double")(F.col("shape_a"), F.col("shape_b")) == 0).select(F.col("id_a").alias("id")).distinct()
    return good.join(hit, "id", "left_semi")


def tiling(cells: DataFrame, study_area: float, cell_area: float) -> DataFrame:
    """n, doubles, holes, cover of a hexagon grid: whether it tiles. cells: q, r.

    doubles are cells listed twice. Where every cell has an edge to another and the outline is one, the count of
    vertices, edges and cells obeys Euler's rule; holes is how much it is off for one part.
    """
    once = cells.select("q", "r").distinct()
    sides = geometry.hex_neighbours(once)
    inner = sides.agg((F.count("*") / 2).alias("shared"))
    corner = F.array(*[F.struct((F.col("q") * 3 + a).alias("u"), (F.col("r") * 3 + b).alias("v")) for a, b in ((2, -1), (1, 1), (-1, 2), (-2, 1), (-1, -1), (1, -2))])
    corners = once.select(F.explode(corner).alias("c")).distinct().agg(F.count("*").alias("corners"))
    n = cells.agg(F.count("*").alias("n"), F.count_distinct("q", "r").alias("once"))
    rows = n.join(inner, F.lit(True)).join(corners, F.lit(True))  # three single rows
    euler = F.col("corners") - (6 * F.col("once") - F.col("shared")) + F.col("once")  # parts minus holes
    return rows.select("n", (F.col("n") - F.col("once")).alias("doubles"), (1 - euler).cast("long").alias("holes"), (F.col("once") * cell_area / F.lit(float(study_area))).alias("cover"))


def shape_report(shapes: DataFrame, study: DataFrame, size: float) -> DataFrame:
    """n, empty, repaired, outside, doubles of a layer (id, shape): what has no shape, what repair changes, what does not touch the study area, and ids listed again; one row."""
    fixed = repaired(F.col("shape"))
    counts = shapes.agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("shape"), F.lit(0)) < 1).alias("empty"), F.count_if(F.col("shape").isNotNull() & (F.size("shape") > 0) & ~fixed.eqNullSafe(F.col("shape"))).alias("repaired"), (F.count("id") - F.count_distinct("id")).alias("doubles"))
    known = shapes.where("size(shape) > 0").select("id").distinct().agg(F.count("*").alias("known"))
    inside = kept_in_area(shapes, study, size).select("id").distinct().agg(F.count("*").alias("inside"))
    return counts.join(known, F.lit(True)).join(inside, F.lit(True)).select("n", "empty", "repaired", (F.col("known") - F.col("inside")).alias("outside"), "doubles")  # three single rows
