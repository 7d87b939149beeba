"""One surviving record per group of duplicates, field by field, by weighted votes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field that survives by vote: its normal form and when a value may win at all."""

    name: str
    value: Column  # as double
    usable: Column


#: Rank of sources without one: behind every stated rank.
UNTRUSTED = 2_000_000_000
#: Votes are weighed by their age on this day; which day it is makes no difference to the order of sums.
AS_OF = date(2020, 1, 1)


def votes(records: DataFrame, trust: DataFrame, group: Column, fields: list[Field], half_life_days: float = 365.0, strict: bool = True, undated: date = date(2000, 1, 1)) -> DataFrame:
    """group_key, field, value, first_rec, n_rows, tally: the votes for every value of every field.

    Fields are unpivoted to long rows in one scan. A delivery (source and date) votes once for a value however
    often its row repeats, with 1 / trust_rank times 2 ** (-age / half_life_days). Sources without a trust
    rank are the least trusted.

    tally is the sum of a value's votes; tallies compare as structs. With ``strict`` votes belong to
    classes by rank and then date, and a vote of a better class outweighs any number of worse ones: the sum
    is then led by its best class, (class, sum of the votes within it), and rows without a date are the
    oldest class of their rank. Otherwise all votes are of one class, sums decide alone, and rows without
    a date are as old as ``undated``. A value with no usable vote has no tally (null). n_rows counts rows,
    first_rec is the smallest record of the group with the value, usable or not.

    The first aggregation is keyed by value, rank and date, so a group with a third of all rows is
    spread over tasks before its values meet.
    """
    ranks = F.broadcast(trust.groupBy(F.col("source_id").alias("lg_source")).agg(F.min("trust_rank").alias("lg_rank")))  # one row per source, a fixed table
    known = records.select(group.alias("lg_group"), F.col("rec_id").alias("lg_rec"), F.col("source_id").alias("lg_source"), F.col("extract_date").cast("date").alias("lg_day"), *[c for i, f in enumerate(fields) for c in (f.value.cast("double").alias(f"lg_v{i}"), F.coalesce(f.usable, F.lit(False)).alias(f"lg_u{i}"))])
    each = F.explode(F.array(*[F.struct(F.col("lg_group").alias("group_key"), F.lit(f.name).alias("field"), F.col(f"lg_v{i}").alias("value"), F.col(f"lg_u{i}").alias("usable")) for i, f in enumerate(fields)]))
    long = known.join(ranks, "lg_source", "left").select("lg_rec", "lg_source", "lg_day", F.coalesce("lg_rank", F.lit(UNTRUSTED)).alias("rank"), each.alias("f"))
    # the group travels inside the exploded struct, so the filter on it cannot be pushed below and compute it again
    cols = ["group_key", "field", "value", "usable", "lg_source", "rank", "day"]
    once = long.where("f.group_key is not null").select("f.*", "lg_source", "rank", F.col("lg_day").alias("day"), "lg_rec").groupBy(*cols).agg(F.min("lg_rec").alias("rec"), F.count("*").alias("n"))
    held = F.coalesce("day", F.lit(undated))
    age = F.datediff(F.lit(AS_OF), held) / half_life_days
    vote = F.pow(F.lit(2.0), F.greatest(F.least(-age, F.lit(900.0)), F.lit(-900.0))) / F.col("rank")
    classes = [F.when(F.col("usable"), F.col("rank")).alias("rank"), F.when(F.col("usable"), F.coalesce("day", F.lit("0001-01-01").cast("date"))).alias("day")] if strict else [F.lit(0).alias("rank"), F.lit(None).cast("date").alias("day")]
    by_value = once.withColumn("vote", F.when(F.col("usable"), vote)).repartition("group_key", "field", "value")  # both steps below stay in its partitions
    summed = by_value.groupBy("group_key", "field", "value", *classes).agg(F.min("rec").alias("rec"), F.sum("n").alias("n"), F.sum("vote").alias("votes"))
    tally = F.max(F.when(F.col("votes").isNotNull(), F.struct((-F.col("rank")).alias("rank"), F.col("day"), F.round(F.log2("votes"), 9).alias("votes"))))
    return summed.groupBy("group_key", "field", "value").agg(F.min("rec").alias("first_rec"), F.sum("n").alias("n_rows"), tally.alias("tally"))


def survivors(records: DataFrame, trust: DataFrame, group: Column, fields: list[Field], half_life_days: float = 365.0, strict: bool = True, undated: date = date(2000, 1, 1)) -> DataFrame:
    """group_key, first_rec, n_records and, per field, {name} (surviving value) and {name}_rec, one row per group.

    The value with the largest tally of votes() survives, between equal tallies that of the smaller record.
    Winners are taken by max_by and pivoted back to one row per group. A field without any usable
    value is null with record null; {name}_rec is the smallest record that holds the winner. Rows whose
    group is null belong to none; an empty table gives no rows.
    """
    v = votes(records, trust, group, fields, half_life_days, strict, undated)
    mine = lambda f: F.col("field") == f.name
    won = lambda f: F.max_by(F.struct("value", "first_rec"), F.when(mine(f) & F.col("tally").isNotNull(), F.struct("tally", (-F.col("first_rec")).alias("r"))))
    wide = v.groupBy("group_key").agg(F.min("first_rec").alias("first_rec"), F.sum(F.when(mine(fields[0]), F.col("n_rows"))).alias("n_records"), *[won(f).alias(f.name) for f in fields])
    return wide.select("group_key", "first_rec", "n_records", *[c for f in fields for c in (F.col(f"{f.name}.value").alias(f.name), F.col(f"{f.name}.first_rec").alias(f"{f.name}_rec"))])


#: The earliest year that a building can have been built in.
FIRST_YEAR = 1700


def parcel_fields() -> list[Field]:
    """LAND_VAL and YRBUILT of assessor records, without stand-ins and impossible values.

    A land value must be a number above 1 that is not all nines; a year must lie between FIRST_YEAR
    and the year of the record's own extract (of its load where the extract has no date).
    """
    land, year = F.col("LAND_VAL").cast("double"), F.col("YRBUILT").cast("int")
    whole = F.when(land.between(0, 1e15), land.cast("long"))
    nines = (whole >= 99_999) & F.exists(F.array(*[F.lit(10**k - 1) for k in range(5, 16)]), lambda n: n == whole)
    upto = F.year(F.coalesce(F.col("extract_date").cast("date"), F.col("load_ts").cast("date")))
    return [
        Field("land", F.when(~F.isnan(land), F.round(land, 2)), ~F.isnan(land) & (land > 1) & ~nines),
        Field("yr", year.cast("double"), (year >= FIRST_YEAR) & (year <= upto)),
    ]
