"""Equi-joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many keys are split, the most frequent ones: no other key can hold more than one row in MOST.
MOST = 1024


def salt(df: DataFrame, column: str, parts: int, *seed: str) -> DataFrame:
    """Spread rows evenly over ``parts`` salts by a hash of the seed columns (all columns if none)."""
    cols = [F.col(c) for c in (seed or df.columns)]
    return df.withColumn(column, F.pmod(F.xxhash64(*cols), F.lit(parts)).cast("int"))


def heavy_keys(df: DataFrame, key: str, most: int, at_least: int = 1000) -> DataFrame:
    """The ``most`` most frequent keys, of those with ``at_least`` rows, and their rows as lg_n: a bounded handful."""
    counts = df.groupBy(key).agg(F.count("*").alias("lg_n")).where(F.col("lg_n") >= at_least)
    return counts.orderBy(F.desc("lg_n"), key).limit(most)


def lookup_join(facts: DataFrame, index: DataFrame, key: str, how: str = "left", parts: int = 16, hot: DataFrame | None = None) -> DataFrame:
    """Join facts to an index with at most one row per key, safely for any distribution of keys.

    The facts are salted, and the index is copied once per salt only for the 4 * parts most frequent
    keys of the facts: no other key can hold more than 1 / (4 * parts) of them.
    Null keys are kept by left joins and match nothing; they are spread by salt as well. A caller that
    joins the same facts several times passes their heavy_keys() as ``hot``.
    """
    hot = heavy_keys(facts.where(F.col(key).isNotNull()), key, 4 * parts) if hot is None else hot
    hot = F.broadcast(hot.select(key, F.lit(True).alias("lg_hot")))
    left = salt(facts, "lg_any", parts).join(hot, key, "left")
    left = left.withColumn("lg_salt", F.when(F.col("lg_hot") | F.col(key).isNull(), F.col("lg_any")).otherwise(0)).drop("lg_any", "lg_hot")
    right = index.join(hot, key, "left").withColumn(
        "lg_salt", F.explode(F.when(F.col("lg_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    ).drop("lg_hot")
    return left.join(right, [key, "lg_salt"], how).drop("lg_salt")


def salted_join(left: DataFrame, right: DataFrame, key: str, rows: int = 4_000, probe: tuple[str, str, int] | None = None) -> DataFrame:
    """Inner join on key in which a key that many rows of either side share is spread over many tasks.

    A key with more than ``rows`` rows on one side is cut there into stretches of about that many, and
    copied per stretch on the other, so a task meets at most ``rows`` rows of a side at once however large
    the key grows; the rows of both sides at one (key, stretches) meet exactly once. Null keys match
    nothing. Rows that were exploded look smaller to the optimiser than they are, so the join is kept
    from broadcasting them.

    probe (a column of the left, one of the right, parts): frequent keys are looked for among the rows whose column
    hashes to one part only. That shapes the plan and never the result.
    """

    def cuts(df: DataFrame, name: str, side: int) -> DataFrame:
        parts = probe[2] if probe else 1
        seen = df.where(F.pmod(F.xxhash64(probe[side]), F.lit(parts)) == 0) if probe else df
        return F.broadcast(heavy_keys(seen, key, MOST, rows // parts + 1).select(key, F.ceil(F.col("lg_n") * parts / rows).cast("int").alias(name)))

    hot_l, hot_r = cuts(left, "lg_hl", 0), cuts(right, "lg_hr", 1)
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1))
    both = lambda df: df.join(hot_l, key, "left").join(hot_r, key, "left")
    by_hash = lambda n, c: F.pmod(F.xxhash64(*[F.col(x) for x in c]), F.coalesce(F.col(n), F.lit(1)).cast("long")).cast("int")
    a = both(left).withColumn("lg_a", by_hash("lg_hl", left.columns)).withColumn("lg_b", whole("lg_hr")).drop("lg_hl", "lg_hr")
    b = both(right).withColumn("lg_b", by_hash("lg_hr", right.columns)).withColumn("lg_a", whole("lg_hl")).drop("lg_hl", "lg_hr")
    return a.join(b.hint("merge"), [key, "lg_a", "lg_b"]).drop("lg_a", "lg_b")


def salted_join_on(left: DataFrame, right: DataFrame, keys: list[str], rows: int = 4_000) -> DataFrame:
    """salted_join() on several columns: by one hash of them, and then by their values."""
    one = lambda df: df.withColumn("lg_key", F.when(~_any_null(keys), F.xxhash64(*keys)))
    b = one(right).withColumnsRenamed({k: f"lg_r_{i}" for i, k in enumerate(keys)})
    joined = salted_join(one(left), b, "lg_key", rows)
    for i, k in enumerate(keys):
        joined = joined.where(F.col(k) == F.col(f"lg_r_{i}"))
    return joined.drop("lg_key", *[f"lg_r_{i}" for i in range(len(keys))])


def _any_null(keys: list[str]) -> Column:
    out = F.col(keys[0]).isNull()
    for k in keys[1:]:
        out = out | F.col(k).isNull()
    return out
