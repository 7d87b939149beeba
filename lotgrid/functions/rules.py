"""Rule lists turned into one projection each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(c: Column, rules: list[tuple[str, str]], default: str | None) -> Column:
    """The label of the first pattern found in c (case ignored), else the default."""
    hits = [F.when(c.rlike(f"(?i){p}"), F.lit(label)) for p, label in rules]
    return F.coalesce(*hits, F.lit(default))


def last_match(c: Column, base: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the last pattern found in c, else base."""
    return reduce(lambda out, r: F.when(c.rlike(f"(?i){r[0]}"), F.lit(r[1])).otherwise(out), rules, base)


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first condition that holds, else null."""
    return F.coalesce(*[F.when(cond, F.lit(why)) for cond, why in rules])


def all_reasons(rules: list[tuple[Column, str]]) -> Column:
    """Every reason whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(why)) for cond, why in rules]))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or either is null."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def mapped(c: Column, table: dict[str, str], default: str | None) -> Column:
    """A literal lookup with a default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """c within bounds; null stays null (least and greatest alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def whole_word(c: Column, words: list[str]) -> Column:
    """Whether any of the words stands by itself in c."""
    return F.coalesce(c.rlike(rf"(?i)\b(?:{'|'.join(words)})(?!\w)"), F.lit(False))


def any_of(c: Column, wanted: list[str], delimiter: str = ";") -> Column:
    """Whether any value of a packed field is wanted."""
    return F.coalesce(F.arrays_overlap(F.split(c, delimiter), F.array(*map(F.lit, wanted))), F.lit(False))


def match_ladder(df: DataFrame, ident: str, candidates: list[Column], table: DataFrame, key: str) -> DataFrame:
    """Rows of df with the table row of the first candidate key that the table has, else nulls.

    The candidates are tried in order (exact, alias, stripped forms); the table, a short list of
    codes with one row each, is joined once with the candidates exploded.
    """
    tries = F.explode(F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(i).alias("step"), c.alias("k"))) for i, c in enumerate(candidates)])))
    hits = df.select(ident, tries.alias("t")).select(ident, "t.*").join(F.broadcast(table.withColumnRenamed(key, "k")), "k")
    rest = [c for c in table.columns if c != key]
    best = hits.groupBy(ident).agg(F.min_by(F.struct(F.col("k").alias(key), "step", *rest), "step").alias("m"))
    return df.join(best, ident, "left").select(*df.columns, "m.*")


def worst(c: Column, order: list[str]) -> Column:
    """The entry of a group that comes last in ``order``: an aggregate over rank codes."""
    listed = F.array(*map(F.lit, order))
    return F.try_element_at(listed, F.nullif(F.max(F.array_position(listed, c)), F.lit(0)).cast("int"))


def first_tag(tags: list[tuple[str, Column, Column]], default: str) -> Column:
    """key=value of the first tag in order whose condition holds: (key, condition, value)."""
    return F.coalesce(*[F.when(cond, F.concat(F.lit(f"{key}="), value.cast("string"))) for key, cond, value in tags], F.lit(default))


def decide(rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first condition that holds; conditions over nulls do not."""
    return F.coalesce(first_reason(rules), F.lit(default))


def stalls(area: Column, setback: float, efficiency: float, stall_area: float) -> Column:
    """Whole stalls on a lot once its setback and its lanes are taken off."""
    return F.floor(area * (1 - setback) * efficiency / stall_area).cast("double")


def checked_config(sums_to_one: dict[str, dict[str, float]], ascending: dict[str, list[float]], keys: dict[str, tuple[set, set]]) -> None:
    """All faults of a configuration at once: weights that do not add up to one, bands that do not ascend, keys that differ from those wanted."""
    faults = [f"{n} adds up to {sum(w.values()):g}" for n, w in sums_to_one.items() if abs(sum(w.values()) - 1) > 1e-6]
    faults += [f"{n} does not ascend" for n, v in ascending.items() if any(b <= a for a, b in zip(v, v[1:]))]
    faults += [f"{n} has {sorted(map(str, have - want))} too many and lacks {sorted(map(str, want - have))}" for n, (have, want) in keys.items() if have != want]
    if faults:
        raise ValueError("; ".join(faults))
