"""References to records that do not exist: keyed pending-orphan state, advanced slice by slice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotgrid.operators.skew import heavy_keys, lookup_join
from lotgrid.session import cut, discard

PERIOD = "yyyy-MM"


def period(ts: Column) -> Column:
    return F.date_format(ts, PERIOD)


COUNTS = ("opened", "resolved", "reopened")


@dataclass
class OrphanState:
    """The keyed tables that are all the memory between slices.

    ``parents``: key, from_ts (earliest arrival), until_ts (latest deletion, null while in force), was (the
    deletion before this slice). ``waiting``: table_name, key, kind, period, n: references that are early
    (older than the parent, or without one), live (to a parent in force) or dead (later than the deletion
    known so far, with their month), counted per key, and the from_ts and until_ts they were counted under.
    ``orphans``: per slice, the references without a parent in force when they came, with their times.
    ``rows``: per slice, what moved between kinds, from which the monthly counts follow.
    """

    parents: DataFrame
    waiting: DataFrame
    orphans: list[DataFrame] = field(default_factory=list)
    rows: list[DataFrame] = field(default_factory=list)

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(
            spark.createDataFrame([], "key string, from_ts timestamp, until_ts timestamp"),
            spark.createDataFrame([], "table_name string, key string, kind string, period string, n long, from_ts timestamp, until_ts timestamp"),
        )


def advance(state: OrphanState, refs: DataFrame, arrivals: DataFrame, hot: DataFrame | None = None) -> OrphanState:
    """The state after one more slice of time; slices must follow one another.

    refs: table_name, rec_id, key, at. arrivals: key, from_ts, until_ts (one of the two per event). New
    references probe the parent index; an arriving parent resolves what waits for its key; a deletion
    reopens it. A later deletion of a key takes the earlier one back: references that had come between
    the two are no orphans any more, and the counts that rested on it are corrected in their own months.
    References are counted per key before they enter the state, so a key that many rows share is one row.
    """
    before = state.parents.select("key", "from_ts", "until_ts", F.col("until_ts").alias("was")).unionByName(arrivals.withColumn("was", F.lit(None).cast("timestamp")))
    parents = cut(before.groupBy("key").agg(*[F.min("from_ts").alias("from_ts"), F.max("until_ts").alias("until_ts"), F.max("was").alias("was")]), "parents")
    from_ts, until_ts, at = F.col("from_ts"), F.col("until_ts"), F.col("at")
    kind = F.when(from_ts.isNull() | (at < from_ts), "early").when(F.coalesce(at >= until_ts, F.lit(False)), "dead").otherwise("live")
    probed = cut(lookup_join(refs, parents.drop("was"), "key", "left", hot=hot).select("*", kind.alias("kind")), "probed")
    fresh = probed.groupBy("table_name", "key", "kind", period(at).alias("period"), "from_ts", "until_ts").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("timestamp")
    fresh = fresh.select("table_name", "key", F.lit(None).cast("string").alias("kind0"), "kind", "period", "n", none.alias("f0"), none.alias("u0"), "from_ts", "until_ts")
    old = state.waiting.withColumnsRenamed({"kind": "kind0", "from_ts": "f0", "until_ts": "u0"}).join(parents, "key", "left")
    now = F.when((F.col("kind0") == "dead") & (until_ts > F.col("was")), "live").otherwise(F.col("kind0"))
    old = old.select("table_name", "key", "kind0", now.alias("kind"), "period", "n", "f0", "u0", "from_ts", "until_ts")
    rows = cut(old.unionByName(fresh), "rows")
    month = F.when(F.col("kind") == "dead", F.col("period"))
    waiting = rows.groupBy("table_name", "key", "kind", month.alias("period")).agg(F.sum("n").alias("n"), F.max("from_ts").alias("from_ts"), F.max("until_ts").alias("until_ts"))
    discard(state.parents)
    return OrphanState(parents, waiting, [*state.orphans, probed.where("kind <> 'live'").select("table_name", "rec_id", "key", "at", "kind")], [*state.rows, rows])


def track(refs: DataFrame, arrivals: DataFrame, slices: int = 3) -> OrphanState:
    """The state after all events, in ``slices`` stretches of time of equal width.

    refs: table_name, rec_id, key, at; arrivals: key, load_ts, retired_ts, any number per key. A parent is in
    force from its earliest load_ts to its latest stated retired_ts, which no longer counts; one that
    retires before it arrives never is. Events are written once, parted by slice, and each slice reads
    its own part. The number of slices changes the work, never the result. Rows without a key or a
    time are no events. Empty tables give an empty state.
    """
    cols = refs.select("table_name", F.col("rec_id").cast("long").alias("rec_id"), "key", F.col("at").cast("timestamp").alias("at")).where("key is not null and at is not null")
    none = F.lit(None).cast("timestamp")
    named = arrivals.where("key is not null")
    events = named.select("key", F.col("load_ts").cast("timestamp").alias("from_ts"), none.alias("until_ts")).where("from_ts is not null").unionByName(named.select("key", none.alias("from_ts"), F.col("retired_ts").cast("timestamp").alias("until_ts")).where("until_ts is not null"))
    ends = refs.select(F.unix_micros(F.col("at").cast("timestamp")).alias("t")).unionByName(arrivals.select(F.explode(F.array(*[F.unix_micros(F.col(c).cast("timestamp")) for c in ("load_ts", "retired_ts")])).alias("t"))).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    state = OrphanState.empty(refs.sparkSession)
    low, width = ends.a or 0, max(1, ((ends.b or 0) - (ends.a or 0)) // max(1, slices) + 1)
    number = lambda c: F.floor((F.unix_micros(c) - F.lit(low)) / F.lit(width)).cast("int").alias("lg_slice")
    cols = cut(cols.select("*", number(F.col("at"))), "refs", "lg_slice")
    events = cut(events.select("*", number(F.coalesce("from_ts", "until_ts"))), "arrivals", "lg_slice")
    hot = cut(heavy_keys(cols, "key", 64).select("key"), "hot")
    for i in range(max(1, slices)):
        state = advance(state, cols.where(F.col("lg_slice") == i).drop("lg_slice"), events.where(F.col("lg_slice") == i).drop("lg_slice"), hot)
    discard(cols, events)
    return state


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def found(state: OrphanState) -> DataFrame:
    """table_name, period, rec_id of every reference without a parent in force when it arrived.

    Early references stay orphans whatever follows; those after a deletion are held against the last one.
    """
    every = _union(state.orphans)
    late = lookup_join(every.where("kind = 'dead'"), state.parents.select("key", "until_ts"), "key", "inner").where("at >= until_ts")
    cols = ("table_name", "rec_id", "at")
    return every.where("kind = 'early'").select(*cols).unionByName(late.select(*cols)).select("table_name", period(F.col("at")).alias("period"), "rec_id")


def _effect(kind: str, from_ts: str, until_ts: str, sign: int) -> Column:
    """What the references of one row do to the counts by month, given the interval of their key.

    A parent that is ever in force resolves the early ones in the month it arrives; its deletion
    reopens these and the live ones.
    """
    k, f, u, n = F.col(kind), F.col(from_ts), F.col(until_ts), F.col("n") * sign
    ever = f.isNotNull() & F.coalesce(u > f, F.lit(True)) & k.isin("early", "live")
    return F.array(F.when(ever & (k == "early"), _change(period(f), resolved=n)), F.when(ever & u.isNotNull(), _change(period(u), reopened=n)))


def _change(at: Column, **counts: Column) -> Column:
    return F.struct(at.alias("period"), *[counts.get(c, F.lit(0)).cast("long").alias(c) for c in COUNTS])


def snapshots(state: OrphanState) -> DataFrame:
    """Per table and month: references opened, resolved and reopened, and how many are open at its end."""
    moved = _union(state.rows).where("kind0 is null or kind0 <> kind or not (f0 <=> from_ts) or not (u0 <=> until_ts)")
    came = F.when(F.col("kind0").isNull() & (F.col("kind") != "live"), _change(F.col("period"), opened=F.col("n"))).when(F.col("kind") != F.col("kind0"), _change(F.col("period"), opened=-F.col("n")))
    every = F.array_compact(F.concat(F.array(came), _effect("kind", "from_ts", "until_ts", 1), _effect("kind0", "f0", "u0", -1)))
    out = moved.select("table_name", F.explode(every).alias("c")).select("table_name", "c.*").groupBy("table_name", "period").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS]).where("opened <> 0 or resolved <> 0 or reopened <> 0")
    upto = Window.partitionBy("table_name").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # one row per month
    return out.withColumn("open_at_end", F.sum(F.col("opened") - F.col("resolved") + F.col("reopened")).over(upto))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
