"""Filling containers of fixed capacity with items, by a configuration program over the histogram of lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotgrid.session import cut

Bins = list[tuple[int, dict[int, int]]]  # how many containers, and how many items of each length one holds


def _worth(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest filling of every room up to a capacity (unbounded knapsack). sizes ascend."""
    worth = np.zeros(capacity + 1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = upto[c]
        worth[c] = max(worth[c - 1], (worth[c - sizes[:k]] + prices[:k]).max()) if k else 0.0
    return worth


def _draw(sizes: np.ndarray, prices: np.ndarray, worth: np.ndarray, allowed: np.ndarray, capacity: int) -> dict[int, int]:
    """A dear filling that uses no length more often than allowed: index -> times, ties to the longest."""
    taken: dict[int, int] = {}
    spare, room = allowed.copy(), capacity
    while k := int(np.searchsorted(sizes, room, side="right")):
        gain = np.where(spare[:k] > 0, worth[room - sizes[:k]] + prices[:k], -1.0)
        j = k - 1 - int(gain[::-1].argmax())
        if gain[j] < 0:
            break
        taken[j] = taken.get(j, 0) + 1
        spare[j] -= 1
        room -= int(sizes[j])
    return taken


def cover(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 120, step: float = 0.0625, eta: float = 4.0, slack: float | None = None) -> Bins:
    """Whole numbers of patterns that hold every item: sum a_sp x_p = d_s, min sum x_p, by multiplicative weights.

    A length's price is its volume times exp(-eta * share of its demand covered so far). Each phase
    prices by knapsack and takes patterns, dearest first, down to 1 - ``slack`` of its first one's worth, until
    1 / ``rounds`` of the volume or ``step`` of a length's demand (one item at least) is used: that width
    bounds how far prices can be out of date. ``slack`` is capacity / 80,000 unless given: pricing a large
    container takes longest, and its many lengths fill it all the same. Steps are whole containers, so nothing is lost by rounding. Phases
    go on until every length is covered; each covers an item at least, so they end. sizes ascend.
    """
    if len(sizes) and sizes[-1] > capacity:
        raise ValueError("an item is longer than the capacity")
    slack = min(0.1, capacity / 80_000) if slack is None else slack
    left, bins = demand.copy(), []
    many_a_phase = max(1, int((sizes * demand).sum() / capacity / rounds))
    while left.any():
        live = np.flatnonzero(left)
        size = sizes[live]
        prices = np.maximum(1.0, np.rint(size * np.exp(-eta * (1 - left[live] / demand[live])) * 2**20))
        worth = _worth(size, prices, capacity)
        allowed = np.minimum(left[live], np.maximum(1, (step * demand[live]).astype(np.int64)))
        budget, best = many_a_phase, 0.0
        while budget > 0:
            pattern = _draw(size, prices, worth, allowed, capacity)
            price = sum(prices[j] * n for j, n in pattern.items())
            best = best or price
            if not pattern or price < (1 - slack) * best:
                break
            amount = min(budget, *(int(allowed[j]) // n for j, n in pattern.items()))
            bins.append((amount, {int(size[j]): n for j, n in pattern.items()}))
            for j, n in pattern.items():
                allowed[j] -= amount * n
                left[live[j]] -= amount * n
            budget -= amount
    return bins


def program_and_rest(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 120, full: float = 0.98, again: float = 0.04) -> tuple[Bins, dict[int, int]]:
    """The containers of cover() that stay, and how many items of each length the others held.

    Those under ``full`` go, and then the emptiest of the others and those with the smallest items, up to a share
    ``again`` of all containers: packed last, small items find the gaps that whole patterns leave.
    """
    order = np.argsort(sizes)
    bins = cover(sizes[order].astype(np.int64), demand[order].astype(np.int64), capacity, rounds)
    used = lambda held: sum(s * n for s, n in held.items())
    budget = int(again * sum(many for many, _ in bins))
    kept, rest = [], {}
    for many, held in sorted(bins, key=lambda b: (used(b[1]), min(b[1]))):
        poor = used(held) < full * capacity
        gone = many if poor else min(many, budget)
        budget -= 0 if poor else gone
        if gone < many:
            kept.append((many - gone, held))
        for s, n in held.items() if gone else ():
            rest[s] = rest.get(s, 0) + gone * n
    return kept, rest


def configuration_program(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 120) -> Bins:
    """Containers for every item: the covering program's full ones, and what its emptier ones held by best_fit(), into their gaps first."""
    kept, rest = program_and_rest(sizes, demand, capacity, rounds)
    return best_fit(rest, capacity, kept)


def least_containers(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> int:
    """A bound that no packing goes below: the volume, and the items of which no two fit together."""
    return max(-(-int((sizes * demand).sum()) // capacity), int(demand[sizes * 2 > capacity].sum()))


def best_fit(rest: dict[int, int], capacity: int, opened: Bins | None = None) -> Bins:
    """Best fit by decreasing length on whole groups of equal containers, never on single items.

    Containers that are ``opened`` already take items too, as far as they have room.
    """
    groups: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    rooms: list[int] = []

    def add(room: int, held: tuple[tuple[int, int], ...], many: int) -> None:
        if room not in groups:
            groups[room] = {}
            rooms.insert(int(np.searchsorted(rooms, room)), room)
        groups[room][held] = groups[room].get(held, 0) + many

    for many, inside in opened or []:
        add(capacity - sum(s * n for s, n in inside.items()), tuple(sorted(inside.items())), many)
    for size in sorted(rest, reverse=True):
        left = rest[size]
        while left:
            at = int(np.searchsorted(rooms, size))
            if at == len(rooms):
                each = capacity // size
                many, some = divmod(left, each)
                if many:
                    add(capacity - each * size, ((size, each),), many)
                if some:
                    add(capacity - some * size, ((size, some),), 1)
                break
            room = rooms[at]
            held, many = next(iter(groups[room].items()))
            each = min(room // size, left)
            use = min(many, left // each)
            if use == many:
                del groups[room][held]
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                groups[room][held] = many - use
            add(room - each * size, _with(held, size, each), use)
            left -= use * each
    return [(many, dict(held)) for held_in in groups.values() for held, many in held_in.items()]


def _with(held: tuple[tuple[int, int], ...], size: int, each: int) -> tuple[tuple[int, int], ...]:
    inside = dict(held)
    inside[size] = inside.get(size, 0) + each
    return tuple(sorted(inside.items()))


def slots(bins: Bins) -> list[tuple[int, int, int, int]]:
    """size, first rank, first container, items per container: where the items of each length go."""
    out, rank, base = [], {}, 0
    for many, held in bins:
        for size, each in held.items():
            at = rank.get(size, 0)
            out.append((size, at, base, each))
            rank[size] = at + many * each
        base += many
    return out


def pieces(items: DataFrame, containers: DataFrame) -> DataFrame:
    """container_kind, capacity, doc_id, piece_no (from 1), start_token, n_tokens.

    Only an item longer than the capacity is split, into full pieces and a remainder. Items without
    tokens need no room and give no piece. containers is one row per kind, a short list.
    """
    kinds = F.broadcast(containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity")))
    n, cap = F.col("n_tokens"), F.col("capacity")
    cut_at = items.where("n_tokens > 0").withColumn("lg_one", F.lit(1)).join(kinds.withColumn("lg_one", F.lit(1)), "lg_one")
    start = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / cap).cast("int")))
    return cut_at.select("container_kind", "capacity", "doc_id", n.alias("whole"), start.alias("p")).select(
        "container_kind", "capacity", "doc_id", (F.col("p") + 1).alias("piece_no"), (F.col("p") * cap).cast("int").alias("start_token"), F.least(cap, F.col("whole") - F.col("p") * cap).cast("int").alias("n_tokens")
    )


def pack(items: DataFrame, containers: DataFrame, rounds: int = 120, salts: int = 64) -> DataFrame:
    """container_kind, container_no (from 0), doc_id, piece_no, start_token, n_tokens of every piece.

    items: doc_id, n_tokens. The histogram of piece lengths has at most ``capacity`` rows per kind
    whatever the corpus; one task per kind turns it into slots (length, rank -> container). Items are
    ranked within their length in salted stretches, so a length that a third of all items share is
    ranked by many tasks. Slots are cut to the stretches that they meet, and each item takes the last slot
    that begins before it in its stretch: plans and items meet in a sort, and nothing passes through the driver.
    Ties and repeated rows are packed one by one; empty inputs give no rows.
    """
    parts = cut(pieces(items, containers).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(salts)).cast("int")), "pieces")
    counts = parts.groupBy("container_kind", "capacity", "n_tokens", "salt").agg(F.count("*").alias("n"))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        capacity = int(frame["capacity"].iloc[0])
        demand = frame.groupby("n_tokens")["n"].sum()
        full = int(demand.get(capacity, 0))
        demand = demand[demand.index < capacity]
        bins = ([(full, {capacity: 1})] if full else []) + (configuration_program(demand.index.to_numpy(), demand.to_numpy(), capacity, rounds) if len(demand) else [])
        got = pd.DataFrame(slots(bins), columns=["n_tokens", "rank0", "base", "each"])
        got.insert(0, "container_kind", frame["container_kind"].iloc[0])
        return got

    histogram = counts.groupBy("container_kind", "capacity", "n_tokens").agg(F.sum("n").alias("n"))
    plan = histogram.repartition(16, "container_kind").groupBy("container_kind").applyInPandas(solve, "container_kind string, n_tokens int, rank0 long, base long, each int")
    plan = cut(plan.withColumn("upto", F.lead("rank0").over(Window.partitionBy("container_kind", "n_tokens").orderBy("rank0"))), "slots")
    length = ["container_kind", "n_tokens"]
    starts = counts.withColumn("first", F.sum("n").over(Window.partitionBy(*length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select(*length, "salt", F.coalesce("first", F.lit(0)).alias("first"), "n")
    meets = (F.col("rank0") < F.col("first") + F.col("n")) & (F.coalesce("upto", F.lit(2**62)) > F.col("first"))
    none = {c: F.lit(None) for c in ("doc_id", "piece_no", "start_token")}
    begun = starts.join(plan, length).where(meets).select(*length, "salt", (F.greatest("rank0", "first") - F.col("first")).alias("r"), F.struct("rank0", "base", "each", "first").alias("slot"))
    stretch = Window.partitionBy(*length, "salt")
    ranked = parts.withColumn("r", (F.row_number().over(stretch.orderBy("doc_id", "piece_no")) - 1).cast("long")).select(*length, "salt", "r", F.lit(None).alias("slot"), *none)
    placed = begun.withColumns(none).unionByName(ranked).withColumn("at", F.last("slot", True).over(stretch.orderBy("r", F.col("slot").isNull()).rowsBetween(Window.unboundedPreceding, 0))).where("slot is null")
    number = F.col("at.base") + F.floor((F.col("at.first") + F.col("r") - F.col("at.rank0")) / F.col("at.each"))
    return placed.select("container_kind", number.alias("container_no"), "doc_id", "piece_no", "start_token", "n_tokens")


def fill(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, the fewest that the volume allows, and the share of space in use."""
    used = packed.groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("used"))
    total = used.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(F.broadcast(containers.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("at_least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("share_used"), "fullest"
    )
