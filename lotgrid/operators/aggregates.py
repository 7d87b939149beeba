"""Aggregates with the semantics that site data needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_stated(c: str, order: Column) -> Column:
    """The first non-null value of a group in a stated order."""
    return F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order))


def most_frequent(df: DataFrame, by: list[str], c: str, out: str) -> DataFrame:
    """The most frequent value per group, ties to the smallest; counted before it is compared."""
    n = df.where(F.col(c).isNotNull()).groupBy(*by, c).agg(F.count("*").alias("lg_n"))
    return n.groupBy(*by).agg(F.min_by(c, F.struct((-F.col("lg_n")).alias("n"), F.col(c).alias("v"))).alias(out))


def joined_values(c: str, delimiter: str = ";") -> Column:
    """The distinct values of a group, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), delimiter)


def stated_capacity(cap: str, polygon: Column) -> Column:
    """The sum if every record states one, else the largest if at most one record is an area, else null."""
    n, stated = F.count("*"), F.count(cap)
    return F.when(stated == n, F.sum(cap)).when((stated > 0) & (F.sum(polygon.cast("int")) <= 1), F.max(cap))


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of the stated values by weight."""
    return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0))


def breakdown(df: DataFrame, by: list[str], category: str, value: str, digits: int = 2) -> DataFrame:
    """Per group a JSON object of category totals, rounded half to even, without zeros."""
    total = df.groupBy(*by, category).agg(F.bround(F.sum(value), digits).alias("v")).where("v <> 0")
    return total.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(category, "v"))))).alias("components"))


def conservation(before: DataFrame, after: DataFrame, value: str) -> DataFrame:
    """total_in, total_out and their ratio, from one aggregate each."""
    a = before.agg(F.sum(value).alias("total_in"))
    b = after.agg(F.sum(value).alias("total_out"))
    return a.join(b, F.lit(True)).withColumn("share", F.col("total_out") / F.nullif(F.col("total_in").cast("double"), F.lit(0.0)))  # two single rows


def error_metrics(df: DataFrame, by: str, observed: str, predicted: str) -> DataFrame:
    """n, mae, bias, rmse and the share within 0.15, per group and overall (group null), in one pass."""
    e = F.col(predicted) - F.col(observed)
    cols = df.select(by, e.alias("e"))
    return cols.groupingSets([[by], []], by).agg(
        F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), F.avg((F.abs("e") <= 0.15).cast("double")).alias("within"),
    )


def calibration(df: DataFrame, by: str, lot: str, observed: str, predicted: str, min_lots: int = 5) -> DataFrame:
    """The median of observed / predicted per group, null for groups with fewer than ``min_lots`` lots."""
    r = F.col(observed) / F.nullif(F.col(predicted), F.lit(0.0))
    return df.groupBy(by).agg(F.count_distinct(F.col(lot)).alias("n_lots"), F.median(r).alias("m")).select(by, "n_lots", F.when(F.col("n_lots") >= min_lots, F.bround("m", 4)).alias("factor"))


def active_services(calendar: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """service_id of a timetable on a day (YYYYMMDD): in range and on its weekday, plus added, minus removed."""
    weekday = F.lower(F.date_format(F.to_date(F.lit(day), "yyyyMMdd"), "EEEE"))
    names = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    on = F.coalesce(*[F.when(weekday == n, F.col(n).cast("int")) for n in names], F.lit(0)) == 1
    base = calendar.where(on & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id")
    today = exceptions.where(F.col("date") == day)
    added = today.where("cast(exception_type as int) = 1").select("service_id")
    removed = today.where("cast(exception_type as int) = 2").select("service_id")
    return base.unionByName(added).distinct().join(removed, "service_id", "left_anti")


def peak_headway(departures: DataFrame, stop: str, minutes: str, low: float, high: float, threshold: float) -> DataFrame:
    """Departures within [low, high) per stop, the minutes between them, and whether that is frequent."""
    inside = F.count(F.when((F.col(minutes) >= low) & (F.col(minutes) < high), 1))
    out = departures.groupBy(stop).agg(inside.alias("departures"))
    return out.withColumn("headway", F.lit(float(high - low)) / F.nullif(F.col("departures"), F.lit(0))).withColumn("frequent", F.coalesce(F.col("headway") <= threshold, F.lit(False)))


def class_shares(df: DataFrame, cls: str, covered: str, total: str, cap: float) -> DataFrame:
    """Estimated share per row: its own where stated, else the median of its class, never above the cap."""
    own = F.least(F.greatest(F.col(covered) / F.nullif(F.col(total), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    med = df.where(F.col(covered).isNotNull()).groupBy(cls).agg(F.median(own).alias("lg_med"))
    share = F.coalesce(F.when(F.col(covered).isNotNull(), own), F.col("lg_med"))
    return df.join(med, cls, "left").withColumn("share", F.when(share.isNotNull(), F.least(share, F.lit(cap)))).drop("lg_med")


def compare_runs(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, change of every key whose value differs between two runs; a missing key counts 0."""
    zero = F.lit(0)
    both = before.select(key, F.col(value).alias("before"), zero.alias("after")).unionByName(after.select(key, zero.alias("before"), F.col(value).alias("after")))
    sums = both.groupBy(key).agg(F.sum("before").alias("before"), F.sum("after").alias("after")).where("before <> after")
    return sums.select(key, "before", "after", (F.col("after") - F.col("before")).alias("change"))
