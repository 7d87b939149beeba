"""Ranks, normalisation, weighted scores and their stability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgrid.operators.geometry import within_radius
from lotgrid.session import cut, discard


def in_order(df: DataFrame, by: list[str], order: list[tuple[str, bool]], out: str, weight: str | None = None) -> DataFrame:
    """df with ``out``: the sum of ``weight`` (1 if none) over the rows of its group up to and with each, in a total order.

    order: (column, whether descending). Rows are cut into ranges of the whole order and written, so a group
    of any size is spread over tasks: each adds up its own stretch, and what earlier stretches of the
    group hold is added from a table of one row per group and stretch.
    """
    way = [F.col(c).desc() if down else F.col(c) for c, down in order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cut(df.withColumn("lg_w", F.lit(1) if weight is None else F.col(weight)).repartitionByRange(n, *[F.col(c) for c in by], *way).withColumn("lg_p", F.spark_partition_id()), "ranges")
    group = [*by, "lg_p"]
    within = parts.withColumn("lg_s", F.sum("lg_w").over(Window.partitionBy(*group).orderBy(*way).rowsBetween(Window.unboundedPreceding, 0)))
    held = parts.groupBy(*group).agg(F.sum("lg_w").alias("lg_h"))
    before = held.select(*group, F.coalesce(F.sum("lg_h").over(Window.partitionBy(*by).orderBy("lg_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("lg_b")).withColumnsRenamed({c: f"lg_k_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"lg_k_{c}")) for c in group]
    return within.join(before, same).withColumn(out, F.col("lg_s") + F.col("lg_b")).select(*df.columns, out)


def unique_rank(df: DataFrame, by: list[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    """1, 2, ... within each group by score descending (nulls last), equal scores by id; any group is one task's rows.

    For groups that hold large shares of all rows see rank_all().
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.col(tie))))


def rank_all(df: DataFrame, by: list[str], score: str, tie: str, out: str = "rank") -> DataFrame:
    """unique_rank() for few groups of any size: ranks are numbered over ranges."""
    return in_order(df, by, [(score, True), (tie, False)], out)


def top_per_group(df: DataFrame, by: list[str], score: str, tie: str, n: int) -> DataFrame:
    """The first n rows of each group; pruned before the shuffle by the group limit."""
    return unique_rank(df, by, score, tie, "lg_rank").where(F.col("lg_rank") <= n).drop("lg_rank")


def keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in order (aggregated map-side, so a frequent key is no hot task)."""
    key = F.struct(*order)
    return df.groupBy(*by).agg(F.min_by(F.struct(*df.columns), key).alias("lg")).select("lg.*")


def percent_rank_average(df: DataFrame, value: str, out: str) -> DataFrame:
    """Rank as a share of all rows, ties averaged; null values get null.

    Counts per distinct value are taken first and then added up over ranges of the values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("lg_n"))
    upto = in_order(counts, [], [(value, False)], "lg_upto", "lg_n")
    whole = F.broadcast(df.agg(F.count(value).alias("lg_all")))  # one row
    rank = upto.join(whole, F.lit(True)).select(value, ((F.col("lg_upto") - (F.col("lg_n") - 1) / 2.0) / F.col("lg_all")).alias(out))
    return df.join(rank, value, "left")


def average_rank(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """Rank within each group, ties averaged; null values get null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("lg_n"))
    rank = counts.select(F.col(by).alias("lg_by"), F.col(value).alias("lg_v"), (F.sum("lg_n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - (F.col("lg_n") - 1) / 2.0).alias(out))
    return df.join(rank, F.col(by).eqNullSafe(F.col("lg_by")) & (F.col(value) == F.col("lg_v")), "left").drop("lg_by", "lg_v")


def spearman(df: DataFrame, by: str, a: str, b: str, least: int = 3) -> DataFrame:
    """by, n, rho: correlation of average ranks over rows with both values; null under ``least`` rows or for a constant side."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(by, F.col(a).alias("lg_x"), F.col(b).alias("lg_y"))
    ranked = average_rank(average_rank(both, by, "lg_x", "lg_rx"), by, "lg_y", "lg_ry")
    varied = (F.min("lg_x") < F.max("lg_x")) & (F.min("lg_y") < F.max("lg_y")) & (F.count("*") >= least)
    return ranked.groupBy(by).agg(F.count("*").alias("n"), F.when(varied, F.corr("lg_rx", "lg_ry")).alias("rho"))


def all_bounds(long: DataFrame, name: str, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """name, lo, hi: per name the exact linear-interpolation percentiles between which its values are winsorised.

    The order statistics are found among running counts over ranges of the distinct values: no task
    holds more than its range. Names are few. Null and NaN values do not count; a name without others gets no row.
    """
    known = long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counts = cut(known.groupBy(name, value).agg(F.count("*").alias("lg_n")), "counts")
    upto = in_order(counts, [name], [(value, False)], "lg_upto", "lg_n")
    at = upto.join(F.broadcast(counts.groupBy(name).agg(F.sum("lg_n").alias("lg_all"))), name)  # one row per name
    v = F.col(value).cast("double")

    def quantile(p: float) -> Column:
        place = (F.col("lg_all") - 1) * F.lit(p)
        held = lambda k: F.max(F.when((F.col("lg_upto") > k) & (F.col("lg_upto") - F.col("lg_n") <= k), v))
        below, above, part = held(F.floor(place)), held(F.ceil(place)), F.max(place - F.floor(place))
        return below + (above - below) * part

    return at.groupBy(name).agg(quantile(low).alias("lo"), quantile(high).alias("hi"))


def bounds(df: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """lo, hi of all_bounds() for one column; one row, null without values."""
    return all_bounds(df.select(F.lit("v").alias("name"), value), "name", value, low, high).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))


def normalise_all(df: DataFrame, columns: dict[str, tuple[str, bool]], low: float = 0.05, high: float = 0.95, constant: float = 50.0) -> DataFrame:
    """df with each column ({out: (column, whether a cost)}) as 0 to 100 between its percentiles, inverted for costs.

    Missing values and constant columns are ``constant``. The percentiles of all columns are found in one pass over df.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(out).alias("name"), F.col(c).cast("double").alias("v")) for out, (c, _) in columns.items()])).alias("s")).select("s.*")
    q = all_bounds(long, "name", "v", low, high)
    one = F.broadcast(q.agg(*[F.max(F.when(F.col("name") == out, F.col(side))).alias(f"lg_{side}_{i}") for i, out in enumerate(columns) for side in ("lo", "hi")]))  # one row
    got = df.join(one, F.lit(True), "left")
    for i, (out, (c, cost)) in enumerate(columns.items()):
        lo, hi = F.col(f"lg_lo_{i}"), F.col(f"lg_hi_{i}")
        x = (F.least(F.greatest(F.col(c), lo), hi) - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100.0
        got = got.withColumn(out, F.coalesce(F.when(F.col(c).isNotNull(), 100.0 - x if cost else x), F.lit(constant)))
    return got.drop(*[f"lg_{side}_{i}" for i in range(len(columns)) for side in ("lo", "hi")])


def normalise(df: DataFrame, value: str, out: str, cost: bool = False, low: float = 0.05, high: float = 0.95, constant: float = 50.0) -> DataFrame:
    """normalise_all() of one column."""
    return normalise_all(df, {out: (value, cost)}, low, high, constant)


def composite(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """scenario, id, composite: weighted sums of long scores (id, criterion, score) by scenario weights.

    weights (scenario, criterion, weight) is a configuration table, bounded by scenarios times criteria.
    """
    return scores.join(F.broadcast(weights), "criterion").groupBy("scenario", "id").agg(F.sum(F.col("score") * F.col("weight")).alias("composite"))


def one_at_a_time(weights: dict[str, float], factors: tuple[float, ...]) -> list[tuple[str, str, float]]:
    """(scenario, criterion, weight): each weight scaled in turn, the others rescaled so all add up to one."""
    out = []
    for changed, w in weights.items():
        for f in factors:
            new = w * f
            out += [(f"{changed} x {f:g}", c, new if c == changed else v * (1 - new) / (1 - w)) for c, v in weights.items()]
    return out


def drawn_weights(spark: SparkSession, weights: dict[str, float], draws: int, concentration: float, seed: int) -> DataFrame:
    """scenario, criterion, weight of random weight vectors around the given one (Dirichlet, seeded)."""
    names = list(weights)
    w = np.random.default_rng(seed).dirichlet(np.array([weights[n] for n in names]) * concentration, draws)
    rows = [(f"{k:05d}", n, float(w[k, i])) for k in range(draws) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "scenario string, criterion string, weight double")


def rank_stability(ranked: DataFrame, top: int) -> DataFrame:
    """Per id over scenarios: median, 5 and 95 percentile rank, and the share of scenarios within the top."""
    q = F.percentile("rank", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return ranked.groupBy("id").agg(q.alias("q"), F.avg((F.col("rank") <= top).cast("double")).alias("share_top")).select("id", F.col("q")[1].alias("median_rank"), F.col("q")[0].alias("p05"), F.col("q")[2].alias("p95"), "share_top")


def numbered(df: DataFrame, prefix: str, digits: int, order: list[str], out: str) -> DataFrame:
    """Ids like A000001 in the order of natural keys, numbered over ranges without one task holding all rows."""
    return in_order(df, [], [(c, False) for c in order], "lg_number").withColumn(out, F.format_string(f"{prefix}%0{digits}d", F.col("lg_number").cast("long"))).drop("lg_number")


def numbered_duplicates(df: DataFrame, name: str, order: str, out: str) -> DataFrame:
    """name, name (2), name (3), ... in order within equal names."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


def resolve_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, lost_to: best first, a row stays unless it conflicts with one that stays; then it is lost to the best such.

    nodes: id, rank (smaller is better, ties by id); edges: a, b in either order. Whoever has no better
    neighbour left open stays, and its open neighbours are lost: both are decided for all such rows at
    once and written, so no group of conflicts is ever whole in a task, and the rounds end when none is open.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "conflicts")
    place = lambda i: F.struct(F.col("rank"), F.col(i).alias("i"))
    every = cut(nodes.select("id", "rank"), "open")
    left, kept = every, None
    while True:
        near = both.join(left.select(F.col("id").alias("a")), "a").join(left.select(F.col("id").alias("b"), "rank"), "b")
        best = near.groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("m"))
        stays = F.col("m").isNull() | (place("id") < F.col("m"))
        judged = cut(left.join(best, "id", "left").select("id", "rank", stays.alias("stays")), "judged")
        stay = judged.where("stays").select("id", "rank")
        kept = stay if kept is None else kept.unionByName(stay)
        gone = both.join(stay.select(F.col("id").alias("b")), "b").select(F.col("a").alias("id")).distinct()
        left = cut(judged.where("not stays").select("id", "rank").join(gone, "id", "left_anti"), "open")
        if left.isEmpty():
            break
    to = both.join(kept.select(F.col("id").alias("b"), "rank"), "b").groupBy(F.col("a").alias("id")).agg(F.min(place("b")).alias("m"))
    return every.select("id").join(to, "id", "left").join(kept.select("id", F.lit(True).alias("lg_kept")), "id", "left").select("id", F.when(F.col("lg_kept").isNull(), F.col("m.i")).alias("lost_to"))


def greedy_spaced(df: DataFrame, stratum: str, ident: str, x: str, y: str, order: str, quota: int, spacing: float) -> DataFrame:
    """Per stratum, the first ``quota`` rows in order that keep ``spacing`` from all picked before.

    Rows of a stratum closer than the spacing conflict; resolve_conflicts() leaves those that greedy picking in
    order would, without a stratum in one task, and the quota is then the best of them. Rows without
    coordinates conflict with nobody; ties go to the smaller id.
    """
    placed = df.select(F.col(ident).alias("id"), F.col(stratum).alias("lg_st"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (-F.col(order)).alias("rank"))
    a = placed.where("x is not null and y is not null").select(F.struct("id", "lg_st").alias("id_a"), "x", "y")
    near = within_radius(a, a.withColumnRenamed("id_a", "id_b"), spacing).where((F.col("id_a.id") < F.col("id_b.id")) & F.col("id_a.lg_st").eqNullSafe(F.col("id_b.lg_st")) & (F.col("dist") < spacing))
    kept = resolve_conflicts(placed.select("id", "rank"), near.select(F.col("id_a.id").alias("a"), F.col("id_b.id").alias("b"))).where("lost_to is null").select(F.col("id").alias(ident))
    return top_per_group(df.join(kept, ident, "left_semi"), [stratum], order, ident, quota)


def survey_sample(places: DataFrame, strata: DataFrame, manual: DataFrame, spacing: float, backups: int) -> DataFrame:
    """stratum, id, role (sample or backup), rank of what is surveyed in each stratum, at least ``spacing`` apart.

    places: id, stratum, garage, score, x, y; strata: stratum, n, garages (a short list); manual: stratum, id. Manual picks come
    first and count toward n; then the best garages up to their quota, then others up to n, then backups of any
    kind, each after what came before it. Ties go to the smaller id. A stratum may be any size.
    """
    c = F.col
    picked = cut(manual.join(places.drop("stratum"), "id").select("stratum", "id", "x", "y", F.row_number().over(Window.partitionBy("stratum").orderBy(F.desc("score"), "id")).alias("turn"), F.lit(0).alias("stage")).join(F.broadcast(strata.select("stratum")), "stratum", "left_semi"), "picked")
    quotas = [(1, c("garage"), c("garages")), (2, ~c("garage"), c("n")), (3, F.lit(True), c("n") + backups)]
    for stage, wanted, upto in quotas:
        open_ = places.where(wanted).join(picked.select("stratum", "id"), ["stratum", "id"], "left_anti")
        at = lambda df, name: df.where("x is not null and y is not null").select(F.struct("stratum", "id").alias(name), "x", "y")
        close = within_radius(at(open_, "id_a"), at(picked, "id_b"), spacing).where((c("id_a.stratum") == c("id_b.stratum")) & (c("dist") < spacing)).select("id_a.stratum", "id_a.id").distinct()
        free = cut(open_.join(close, ["stratum", "id"], "left_anti").select("stratum", "id", "x", "y", (-c("score")).alias("rank")), "free")
        pairs = within_radius(at(free, "id_a"), at(free, "id_b"), spacing).where((c("id_a.stratum") == c("id_b.stratum")) & (c("id_a.id") < c("id_b.id")) & (c("dist") < spacing))
        key = F.struct("stratum", "id")
        kept = resolve_conflicts(free.select(key.alias("id"), "rank"), pairs.select(c("id_a").alias("a"), c("id_b").alias("b"))).where("lost_to is null").select("id.stratum", "id.id")
        left = F.broadcast(strata.join(picked.groupBy("stratum").agg(F.count("*").alias("had")), "stratum", "left").select("stratum", (upto - F.coalesce("had", F.lit(0))).alias("room")))
        turn = F.row_number().over(Window.partitionBy("stratum").orderBy("rank", "id"))
        more = free.join(kept, ["stratum", "id"], "left_semi").join(left, "stratum").withColumn("turn", turn).where(c("turn") <= c("room")).select("stratum", "id", "x", "y", "turn", F.lit(stage).alias("stage"))
        picked = cut(picked.unionByName(more), "picked")
    place = F.row_number().over(Window.partitionBy("stratum").orderBy("stage", "turn"))
    return picked.join(F.broadcast(strata.select("stratum", "n")), "stratum").withColumn("k", place).select("stratum", "id", F.when(c("k") <= c("n"), "sample").otherwise("backup").alias("role"), F.when(c("k") <= c("n"), c("k")).otherwise(c("k") - c("n")).alias("rank"))
