"""Walking networks and neighbour graphs: bounded paths, nearest sources, components, allocation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.functions.units import band_weight
from lotgrid.session import cut, discard


def undirected(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """a, b, w in both directions, the least weight per pair; edges with unknown ends are dropped."""
    e = edges.select("a", "b", "w").where("a is not null and b is not null and a <> b")
    if nodes is not None:
        known = nodes.select("node")
        e = e.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.min("w").alias("w"))


def bounded_reach(edges: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """src, node, cost of every node within ``limit`` of each source, by a frontier that relaxes until it is empty.

    edges: a, b, w (from undirected()), w not negative (else ValueError); sources: src, node. Only
    improved nodes are joined again, and each round is written to the shared folder, so plans stay short
    and lost executors cost one round. Costs only fall, each to that of another path, so the loop ends.
    """
    if not edges.where("w < 0").isEmpty():
        raise ValueError("bounded_reach needs weights that are not negative")
    best = cut(sources.select("src", "node", F.lit(0.0).alias("cost")).groupBy("src", "node").agg(F.min("cost").alias("cost")), "reach")
    front = best
    while True:
        step = front.join(edges, front["node"] == edges["a"]).select("src", F.col("b").alias("node"), (F.col("cost") + F.col("w")).alias("new")).where(F.col("new") <= limit)
        step = step.groupBy("src", "node").agg(F.min("new").alias("new"))
        better = step.join(best, ["src", "node"], "left").where("cost is null or new < cost").select("src", "node", F.col("new").alias("cost"))
        better = cut(better, "front")
        if better.isEmpty():
            return best
        known, spent = best, front
        best = cut(best.unionByName(better).groupBy("src", "node").agg(F.min("cost").alias("cost")), "reach")
        discard(known, spent if spent is not known else None)
        front = better


def nearest_source(reach: DataFrame) -> DataFrame:
    """node, src, cost of the nearest source of every reached node, ties to the smaller source."""
    return reach.groupBy("node").agg(F.min(F.struct("cost", "src")).alias("m")).select("node", "m.src", "m.cost")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (the smallest id connected to it), by labels, root hooking and pointer jumping.

    Each round the least label of a node's neighbours (and the label of that label) goes to the node
    and to the node that its own label names, so whole labelled stretches are hooked and not only their
    rims. Labels only fall and the loop ends when none does: every label is then a root that all its
    neighbours share. Nodes without edges are their own component; edges with unknown ends do nothing.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct(), "labels")
    while True:
        up = labels.select("id", F.col("component").alias("old")).join(labels.select(F.col("id").alias("old"), F.col("component").alias("up")), "old", "left")
        near = both.join(up.select(F.col("id").alias("b"), F.col("up").alias("seen")), "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        own = F.struct("id", F.least("old", "up", "seen").alias("component"), "old")
        root = F.struct(F.col("old").alias("id"), F.col("seen").alias("component"), F.lit(None).alias("old"))
        sent = up.join(near, "id", "left").select(F.explode(F.array(own, root)).alias("m")).select("m.*")
        new = cut(sent.groupBy("id").agg(F.min("component").alias("component"), F.max("old").alias("old")), "labels")
        discard(labels)
        labels = new.select("id", "component")
        labels._lg_path = new._lg_path
        if new.where("component < old").isEmpty():
            return labels


def largest_component_share(labels: DataFrame) -> DataFrame:
    """The share of nodes in the largest component."""
    n = labels.groupBy("component").agg(F.count("*").alias("n"))
    return n.agg((F.max("n") / F.sum("n")).alias("share"))


def allocate(values: DataFrame, reach: DataFrame, weight: Column | None = None) -> DataFrame:
    """cell, and every value column spread over the cells in reach by weights that add up to one per source.

    values: src, own_cell, v...; reach: src, cell, minutes. A source that reaches no cell keeps its
    value in its own cell; without an own cell it is dropped. The totals are conserved.
    """
    names = [c for c in values.columns if c not in ("src", "own_cell")]
    w = (band_weight(F.col("minutes")) if weight is None else weight).alias("w")
    band = reach.select("src", "cell", w).where("w > 0").groupBy("src", "cell").agg(F.max("w").alias("w"))
    share = band.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "cell", "share")
    spread = values.join(share, "src", "left").select("src", F.coalesce("cell", "own_cell").alias("cell"), F.coalesce("share", F.lit(1.0)).alias("share"), *names).where("cell is not null")
    return spread.groupBy("cell").agg(*[F.sum(F.col(c) * F.col("share")).alias(c) for c in names])


def constrained_merge(records: DataFrame, pairs: DataFrame, group: str, ident: str, apart: list[str]) -> DataFrame:
    """ident, cluster: pairs merged in order as long as no two different stated values of ``apart`` meet.

    The order matters, so each plain component is one group, worked through pair by pair.
    """

    def merge(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        parent = {i: i for i in n[ident]}
        held = {i: {c: ({v} if v is not None and v == v else set()) for c, v in zip(apart, vals)} for i, *vals in n[[ident, *apart]].itertuples(index=False)}

        def root(i):  # noqa: ANN001, ANN202
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for a, b in sorted(zip(e["a"], e["b"])):
            x, y = root(a), root(b)
            if x != y and all(len(held[x][c] | held[y][c]) <= 1 for c in apart):
                low, high = min(x, y), max(x, y)
                parent[high] = low
                for c in apart:
                    held[low][c] |= held[high][c]
        return pd.DataFrame({ident: list(parent), "cluster": [root(i) for i in parent]})

    kind = dict(records.dtypes)[ident]
    return records.groupBy(group).cogroup(pairs.groupBy(group)).applyInPandas(merge, f"{ident} {kind}, cluster {kind}")


def grown_sites(parcels: DataFrame, touching: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, id of each seed parcel and all parcels of its owner that it reaches over touching ones.

    parcels: id, owner (normalised); touching: a, b; seeds: seed, id. The fixpoint of growing by neighbours is
    the component of the seed among touching parcels of one owner; an empty or null owner never grows.
    """
    own = parcels.select("id", "owner").where("owner <> ''")
    same = touching.join(own.select(F.col("id").alias("a"), F.col("owner").alias("oa")), "a").join(own.select(F.col("id").alias("b"), F.col("owner").alias("ob")), "b").where("oa = ob").select("a", "b")
    labels = components(parcels.select("id"), same)
    return seeds.join(labels, "id").select("seed", "component").join(labels, "component").select("seed", "id")


def merged_records(records: DataFrame, cluster: str, order: str, public: tuple[str, ...] = ("yes", "permissive", "customers")) -> DataFrame:
    """One record per cluster: first stated name and operator, commonest type, stated capacity, worst fee, public access first.

    records: cluster, order and name, operator, kind, capacity, fee, access, levels, source_ids, polygon. Types
    and fees without a statement do not count; the capacity is the sum if every record states one, else
    the largest if at most one record is an area, else null; ids are merged and sorted.
    """
    first = lambda c, when=None: F.min_by(F.when(F.col(c).isNotNull() if when is None else when, F.col(c)), F.when(F.col(c).isNotNull() if when is None else when, F.col(order)))
    kinds = records.where("kind is not null and kind <> 'Unknown'").groupBy(cluster, "kind").agg(F.count("*").alias("n")).groupBy(cluster).agg(F.min_by("kind", F.struct((-F.col("n")).alias("n"), F.col("kind").alias("k"))).alias("kind"))
    n, stated = F.count("*"), F.count("capacity")
    one = records.groupBy(cluster).agg(
        first("name").alias("name"), first("operator").alias("operator"), F.when(stated == n, F.sum("capacity")).when((stated > 0) & (F.count_if(F.col("polygon")) <= 1), F.max("capacity")).alias("capacity"),
        F.when(F.count_if(F.col("fee") == "yes") > 0, "yes").otherwise(first("fee")).alias("fee"), F.coalesce(F.lower(first("access", F.lower("access").isin(*public))), F.lower(first("access"))).alias("access"),
        F.max("levels").alias("levels"), n.alias("parts"), F.array_join(F.array_sort(F.flatten(F.collect_list(F.split("source_ids", ";")))), ";").alias("source_ids"),
    )
    return one.join(kinds, cluster, "left").withColumn("kind", F.coalesce("kind", F.lit("Unknown")))


def shed_edges(edges: DataFrame, reach: DataFrame, bands: list[float]) -> DataFrame:
    """src, band, a, b of the edges (each once, a < b) whose ends are both within each band of each source.

    edges: a, b; reach: src, node, cost, as bounded_reach() gives it for the widest band.
    """
    once = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    ends = once.join(reach.select("src", F.col("node").alias("a"), F.col("cost").alias("ca")), "a").join(reach.select("src", F.col("node").alias("b"), F.col("cost").alias("cb")), ["src", "b"])
    far = ends.withColumn("far", F.greatest("ca", "cb"))
    return far.select("src", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in sorted(bands)]), lambda x: F.col("far") <= x)).alias("band"), "a", "b")
