"""The same real-world thing in two tables without a common key: blocking, features, weak labels, confidence."""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotgrid.operators.nearby import EARTH_M, near_pairs
from lotgrid.operators.skew import salted_join
from lotgrid.session import cut

#: Words of facility names by what they say.
SIDES = "north south east west upper lower old new".split()
KINDS = {"garage": "garage gar grg deck ramp structure structures", "lot": "lot lots surface", "": "parking pkg park pkng prkg pay public"}
PLACES = {
    "street": "street st str", "avenue": "avenue ave av aven", "boulevard": "boulevard blvd boul blv", "plaza": "plaza plz pza", "square": "square sq sqr", "market": "market mkt mrkt",
    "commons": "commons comm cmns common cmn", "center": "center centre ctr cntr", "lane": "lane ln", "road": "road rd", "court": "court ct", "place": "place pl",
}
NOISE = set("at the of and on co company inc llc ltd corp lp".split())
KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
PLACE_OF = {w: k for k, words in PLACES.items() for w in words.split()}
#: Base features of a pair, and the products of them that the classifier also sees.
BASE = (
    "word_same", "word_near", "word_other", "word_none", "side_same", "side_other", "place_same", "place_other", "kind_other", "op_same", "op_other", "op_none",
    "d30", "d60", "d100", "d200", "dfar", "dnone", "type_same", "type_other", "area_same", "area_other", "coarse", "mirrored", "close", "far", "twin",
)
PRODUCTS = (
    "close*op_same", "close*word_other", "close*word_none", "close*word_none*op_same", "far*word_same", "far*area_same", "dnone*word_same", "dnone*word_same*op_same", "far*word_same*op_same", "far*word_same*op_other",
    "word_same*side_other", "word_same*kind_other", "word_other*op_same", "word_none*op_other", "close*area_same", "word_other*place_same", "word_other*kind_other", "coarse*word_other", "twin*close", "twin*op_same", "word_near*op_same", "dnone*word_near", "dnone*word_near*op_same",
)
FEATURES = (*BASE, *PRODUCTS)
#: Bands of the name alone (three rows each) and with another attribute (two rows each).
ALONE, WITH = 12, 8


def osm_ids(text: Column) -> Column:
    """Map ids in a text, whatever packs and spells them: w123 for way/123, "way 123" and W/123."""
    pattern = r"(?i)(?<![a-z])(node|way|relation|n|w|r)[ /:]*(\d+)"
    kind, number = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.coalesce(F.array_distinct(F.zip_with(kind, number, lambda a, b: F.concat(F.lower(F.substring(a, 1, 1)), b))), F.array().cast("array<string>"))


@functools.lru_cache(200_000)
def words(name: str | None) -> tuple[str, set[str], set[str], set[str]]:
    """Own words of a facility name run together, its sides, places and kinds."""
    own, sides, places, kinds = [], set(), set(), set()
    for w in re.findall(r"[a-z0-9]+", (name or "").lower().replace("'", "")):
        if w in SIDES:
            sides.add(w)
        elif w in PLACE_OF:
            places.add(PLACE_OF[w])
        elif w in KIND_OF:
            kinds.add(KIND_OF[w])
        elif w not in NOISE:
            own.append(w)
    return " ".join(own), sides, places, kinds - {""}


def closeness(a: str, b: str) -> float:
    """1 - edits / longer length; a swap of neighbours is one edit."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    prev2: list[int] = []
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row = [i]
        for j, e in enumerate(b, 1):
            v = min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (c != e))
            if i > 1 and j > 1 and c == b[j - 2] and e == a[i - 2]:
                v = min(v, prev2[j - 2] + 1)
            row.append(v)
        prev2, prev = prev, row
    return 1 - prev[-1] / max(len(a), len(b))


@functools.lru_cache(200_000)
def operator_key(name: str | None) -> str:
    return re.sub(r"(?:inc|llc|ltd|corp|company|lp|parking|pkg|lots?|garages?|services|operations|ops|trust|tr|co)$", "", re.sub(r"[^a-z]", "", re.sub(r"\b(?:and|the|st|street|valet|inc|llc|ltd|company|co|parking|pkg|pk|park)\b", " ", (name or "").lower().replace("&", " "))))


def _signature(own: str, seeds: np.ndarray) -> np.ndarray:
    """MinHash values of the letter triples of a name."""
    grams = {f"^{own}$"[k : k + 3] for k in range(len(own))}
    h = np.array([int.from_bytes(g.encode()[:8].ljust(8, b"\0"), "little") for g in grams], np.uint64)
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h[None, :] ^ (h[None, :] >> np.uint64(29))) * seeds[:, None]).min(axis=1)


DESCRIBED = "own string, own_words array<string>, sides array<string>, places array<string>, kinds array<string>, op string, op_words array<string>"


def describe(df: DataFrame, ident: str, name: str, operator: str) -> DataFrame:
    """df with the parts of its names and operators (DESCRIBED), one pass over the facilities.

    A name "operator - place" also names the operator.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for i, title, op in zip(frame["i"], frame["n"], frame["o"]):
                if title and " - " in title:
                    head, title = title.split(" - ", 1)
                    op = op or head
                own, sides, places, kinds = words(title)
                key = (operator_key(op) or re.sub(r"[^a-z]", "", op.lower())) if op else ""
                rows.append((i, own.replace(" ", ""), own.split(), sorted(sides), sorted(places), sorted(kinds), key, sorted(set(re.findall(r"[a-z]{4,}", (op or "").lower())))))
            yield pd.DataFrame(rows, columns=["i", *(c.split()[0] for c in DESCRIBED.split(", "))])

    kind = dict(df.dtypes)[ident]
    parts = df.select(F.col(ident).alias("i"), F.col(name).alias("n"), F.col(operator).alias("o")).mapInPandas(run, f"i {kind}, {DESCRIBED}")
    return df.join(parts.withColumnRenamed("i", ident), ident)


def banded(df: DataFrame, side: str, least: int = 1, seed: int = 17) -> DataFrame:
    """df with alone and paired: hashes of the MinHash bands of own words of ``least`` letters or more, empty for all others."""
    n = ALONE * 3 + WITH * 2
    seeds = np.random.default_rng(seed).integers(1, 2**61 - 1, n, dtype=np.uint64) | np.uint64(1)

    @F.pandas_udf("alone array<long>, paired array<long>")
    def bands(own: pd.Series) -> pd.DataFrame:
        alone, paired = [], []
        for x in own:
            low = _signature(x, seeds) if len(x) >= max(least, 1) else None
            alone.append([] if low is None else [hash((k, *row)) for k, row in enumerate(low[: ALONE * 3].reshape(ALONE, 3).tolist())])
            paired.append([] if low is None else [hash((k, *row)) for k, row in enumerate(low[ALONE * 3 :].reshape(WITH, 2).tolist())])
        return pd.DataFrame({"alone": alone, "paired": paired})

    both = df.withColumn("lg_bands", bands(F.col(f"own_{side}")))
    return both.select(*df.columns, F.col("lg_bands.alone").alias(f"alone_{side}"), F.col("lg_bands.paired").alias(f"paired_{side}"))


def edits(a: Column, b: Column, sorted_a: Column, sorted_b: Column) -> Column:
    """Edits between two short texts; a swap of two letters counts once, as the sorted letters show."""
    lev = F.levenshtein(a, b)
    return F.when((lev >= 2) & (F.levenshtein(sorted_a, sorted_b) <= lev - 2), lev - 1).otherwise(lev)


def closeness(a: Column, b: Column) -> Column:
    """1 - edits / longer length; 0 where a text is empty."""
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1 - edits(a, b, letters(a), letters(b)) / longer)


def operator_state(op_s: Column, op_u: Column, words_s: Column, words_u: Column) -> Column:
    """none, same or other: equal, one the beginning of the other, close, or words of one all among the other's."""
    short, long = F.when(F.length(op_s) <= F.length(op_u), op_s).otherwise(op_u), F.when(F.length(op_s) <= F.length(op_u), op_u).otherwise(op_s)
    within = (F.size(words_s) > 0) & (F.size(words_u) > 0) & ((F.size(F.array_except(words_s, words_u)) == 0) | (F.size(F.array_except(words_u, words_s)) == 0))
    same = (op_s == op_u) | ((F.length(short) >= 4) & long.startswith(short)) | within
    return F.when((op_s == "") | (op_u == ""), "none").when(same, "same").when(closeness(op_s, op_u) >= 0.7, "same").otherwise("other")


def pair_features(pairs: DataFrame) -> DataFrame:
    """pairs with bits, the BASE features that hold, the first one lowest, all in column expressions.

    pairs holds the columns of both sides (_s and _u) that samples(), supplies() and describe() give.
    """
    c = F.col
    long_words = lambda name: F.filter(name, lambda w: F.length(w) > 4)
    several = (F.size("own_words_s") + F.size("own_words_u") > 2) & (F.size(long_words("own_words_s")) > 0) & (F.size(long_words("own_words_u")) > 0)
    best_word = F.array_max(F.transform(long_words("own_words_s"), lambda a: F.array_max(F.transform(long_words("own_words_u"), lambda b: closeness(a, b)))))
    rad = F.radians
    h = F.pow(F.sin(rad(c("y_u") - c("y_s")) / 2), 2) + F.cos(rad("y_s")) * F.cos(rad("y_u")) * F.pow(F.sin(rad(c("x_u") - c("x_s")) / 2), 2)
    away = F.greatest(F.lit(2 * EARTH_M) * F.asin(F.least(F.sqrt(h), F.lit(1.0))) - F.greatest("c_s", "c_u"), F.lit(0.0))
    measured = pairs.withColumns({
        "near": F.greatest(closeness(c("own_s"), c("own_u")), F.when(several, best_word).otherwise(0.0)), "away": away,
        "ops": operator_state(c("op_s"), c("op_u"), c("op_words_s"), c("op_words_u")),
    })
    measured = measured.withColumns({
        "word": F.when((c("own_s") == "") | (c("own_u") == ""), "none").when(c("near") >= 0.83, "same").when(c("near") >= 0.7, "near").otherwise("other"),
        "dist": F.when(c("away").isNull(), "dnone").when(c("away") <= 30, "d30").when(c("away") <= 60, "d60").when(c("away") <= 97, "d100").when(c("away") <= 200, "d200").otherwise("dfar"),
    })
    met, split = lambda n: F.arrays_overlap(f"{n}_s", f"{n}_u"), lambda n: (F.size(f"{n}_s") > 0) & (F.size(f"{n}_u") > 0)
    named = c("word").isin("same", "near")
    f = {f"word_{k}": c("word") == k for k in ("same", "near", "other", "none")} | {f"op_{k}": c("ops") == k for k in ("same", "other", "none")} | {k: c("dist") == k for k in ("d30", "d60", "d100", "d200", "dfar", "dnone")}
    f |= {"side_same": named & (c("sides_s") == c("sides_u")), "side_other": named & split("sides") & (c("sides_s") != c("sides_u")), "kind_other": split("kinds") & ~met("kinds"), "place_same": met("places"), "place_other": split("places") & ~met("places")}
    f |= {"type_same": c("type_s") == c("type_u"), "type_other": (c("type_s") != c("type_u")) & (c("type_s") != "Mixed") & (c("type_u") != "Mixed"), "area_same": c("area_s") == c("area_u"), "area_other": c("area_s") != c("area_u")}
    f |= {"coarse": F.greatest("c_s", "c_u") > 0, "mirrored": c("turn_s") != c("turn_u"), "close": c("dist").isin("d30", "d60", "d100"), "far": c("dist").isin("d200", "dfar")}
    f["twin"] = named & (f["side_other"] | f["kind_other"])
    bit = lambda i, cond: F.when(cond, F.lit(1 << i)).otherwise(0).cast("long")
    return measured.withColumn("bits", functools.reduce(lambda p, q: p + q, [bit(i, f[name]) for i, name in enumerate(BASE)]))


#: The bits that a feature needs: one of BASE, or all that a product multiplies.
MASKS = [sum(1 << BASE.index(k) for k in name.split("*")) for name in FEATURES]


def unpacked(bits: np.ndarray) -> np.ndarray:
    """Feature vectors, in the order of FEATURES, of packed ones."""
    masks = np.array(MASKS, np.int64)
    return ((bits[:, None] & masks) == masks).astype(float)


def log_odds(weights: np.ndarray, scale: tuple[float, float]) -> Column:
    """The calibrated log odds of the packed features in column bits, between -30 and 30."""
    bits = F.col("bits")
    z = functools.reduce(lambda p, q: p + q, [F.when(bits.bitwiseAND(F.lit(m)) == m, float(w) * scale[0]).otherwise(0.0) for m, w in zip(MASKS, weights[:-1])], F.lit(float(weights[-1]) * scale[0] + scale[1]))
    return F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 40, counts: np.ndarray | None = None) -> np.ndarray:
    """Weights (the last one is the intercept) of a ridge logistic regression of rows that count so many times, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    counts = np.ones(len(x)) if counts is None else counts
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (counts * (p - y)) + ridge * w
        h = (x * (counts * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _place(lat: str, lon: str) -> tuple[Column, Column, Column, Column]:
    """Latitude and longitude folded to one quadrant, how coarse they are in metres, and how they were folded.

    Swapped axes and lost signs land on the same place, so such pairs become candidates; whether the two were
    folded alike is a feature, so that places on opposite sides of the globe are not taken for one. Null, out
    of range and 0/0 are no place.
    """
    lat_, lon_ = F.col(lat).cast("double"), F.col(lon).cast("double")
    y, x = F.abs(lat_), F.abs(lon_)
    swap = (y > 90) & (x <= 90)
    turn = F.concat_ws(",", F.signum(F.when(swap, lon_).otherwise(lat_)).cast("int"), F.signum(F.when(swap, lat_).otherwise(lon_)).cast("int"), swap.cast("int"))
    y, x = F.when(swap, x).otherwise(y), F.when(swap, y).otherwise(x)
    ok = (y <= 90) & (x <= 180) & ~((y == 0) & (x == 0))
    at = lambda n: (F.round(y, n) == y) & (F.round(x, n) == x)
    coarse = F.when(at(2), 790.0).when(at(3), 79.0).otherwise(0.0)
    return F.when(ok, y), F.when(ok, x), F.when(ok, coarse).otherwise(0.0), F.when(ok, turn)


def _sided(df: DataFrame, side: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{k}_{side}" for k in (p.split()[0] for p in DESCRIBED.split(", "))})


def samples(df: DataFrame) -> DataFrame:
    """One described row per sampled facility: the latest stated value of each field, all its map ids."""
    latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("load_ts", "rec_id")))
    y, x, coarse, turn = _place("lat", "lon")
    rows = df.where("facility_id is not null").select("facility_id", "rec_id", "load_ts", "name", "operator", "type", F.col("area"), F.when(y.isNotNull(), F.struct(y.alias("y"), x.alias("x"), coarse.alias("coarse"), turn.alias("turn"))).alias("place"), osm_ids(F.col("osm_ids")).alias("ids"))
    one = rows.groupBy(F.col("facility_id").alias("sid")).agg(latest("name").alias("name_s"), latest("operator").alias("oper_s"), latest("type").alias("type_s"), latest("area").alias("area_s"), latest("place").alias("place"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids_s"))
    one = cut(one.select("sid", "name_s", "oper_s", "type_s", "area_s", F.col("place.y").alias("y_s"), F.col("place.x").alias("x_s"), F.coalesce("place.coarse", F.lit(0.0)).alias("c_s"), F.col("place.turn").alias("turn_s"), "ids_s"), "latest")
    return _sided(describe(one, "sid", "name_s", "oper_s"), "s")


def supplies(df: DataFrame) -> DataFrame:
    """One described row per facility of the other table; of rows that repeat an id the first by all columns."""
    y, x, coarse, turn = _place("lat", "lon")
    rows = df.where("facility_id is not null").select(F.col("facility_id").alias("uid"), F.col("name").alias("name_u"), F.col("operator").alias("oper_u"), F.col("type").alias("type_u"), F.col("submarket").alias("area_u"), y.alias("y_u"), x.alias("x_u"), coarse.alias("c_u"), turn.alias("turn_u"), osm_ids(F.col("source_ids")).alias("ids_u"))
    rest = [c for c in rows.columns if c != "uid"]
    one = cut(rows.groupBy("uid").agg(F.min(F.struct(*rest)).alias("r")).select("uid", *[F.col(f"r.{c}").alias(c) for c in rest]), "supply")
    return _sided(describe(one, "uid", "name_u", "oper_u"), "u")


def deletions(text: Column) -> Column:
    """A text and the strings that one deletion leaves of it: texts at one edit or swap have one of them in common."""
    return F.array_distinct(F.concat(F.array(text), F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))))


def _third(n: Column, i: Column) -> Column:
    return F.floor(n * i / 3).cast("int")


def thirds(text: Column) -> Column:
    """The three parts of a text, each with the text's length and its number: what probes() looks for."""
    n = F.length(text)
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws("|", n.cast("string"), i.cast("string"), F.substr(text, _third(n, i) + 1, _third(n, i + 1) - _third(n, i))))


def probes(text: Column) -> Column:
    """The parts that a text at two edits or less can have: of two such edits one of three parts is free, and it
    stands at most two places off. So a text whose thirds() have none of these in common is farther off, and
    only the others need to be measured."""
    n = F.length(text)
    span = lambda a, b: F.sequence(F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b)

    def at(length: Column, i: Column, shift: Column) -> Column:
        start, size = _third(length, i) + shift, _third(length, i + 1) - _third(length, i)
        return F.when((start >= 0) & (start + size <= n), F.concat_ws("|", length.cast("string"), i.cast("string"), F.substr(text, start + 1, size)))

    every = F.transform(span(F.greatest(n - 2, F.lit(1)), n + 2), lambda length: F.flatten(F.transform(span(0, 2), lambda i: F.transform(span(-2, 2), lambda shift: at(length, i, shift)))))
    return F.array_distinct(F.array_compact(F.flatten(every)))


def blocks(df: DataFrame, side: str, ident: str, reach_m: float = 300.0) -> DataFrame:
    """ident, own, rule, key: every key under which a facility looks for partners. See candidates()."""
    own, op, area = F.col(f"own_{side}"), F.col(f"op_{side}"), F.col(f"area_{side}")
    vague = F.col(f"y_{side}").isNull() | (F.col(f"c_{side}") > reach_m / 2)
    none = F.array().cast("array<struct<rule:string,key:bigint>>")
    key = lambda rule, *parts: F.struct(F.lit(rule).alias("rule"), F.xxhash64(F.lit(rule), *parts).alias("key"))
    # a pair needs a side without a usable place: such samples meet all supplies, the others only such supplies
    meets = F.array(vague) if side == "s" else F.when(vague, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    lost = lambda rule, of: F.flatten(F.transform(of, lambda x: F.transform(meets, lambda m: key(rule, x, m))))
    named = F.length(own) > 0
    every = F.concat(
        F.transform(f"ids_{side}", lambda k: key("id", k)),
        F.when(op != "", F.transform(f"paired_{side}", lambda h: key("operator", h, F.substring(op, 1, 4)))).otherwise(none),
        F.when(area.isNotNull(), F.transform(f"alone_{side}", lambda h: key("area", h, area))).otherwise(none),
        lost("name", F.col(f"alone_{side}")),
        F.when(named, F.transform(deletions(own), lambda d: key("edit", d))).otherwise(none),
        F.when(named & (vague if side == "s" else F.lit(True)), F.transform(probes(own) if side == "s" else thirds(own), lambda x: key("edits", x, F.lit("s")))).otherwise(none),
        F.when(named & (~vague if side == "s" else vague), F.transform(thirds(own) if side == "s" else probes(own), lambda x: key("edits", x, F.lit("u")))).otherwise(none),
    )
    return df.select(ident, own, F.explode(every).alias("k")).select(ident, f"own_{side}", F.col("k.rule").alias(f"rule_{side}"), F.col("k.key").alias("key"))


def alike() -> Column:
    """Whether two own words are within two edits or about a third of their letters: what any pair by name must be."""
    return (F.length("own_s") > 0) & (F.length("own_u") > 0) & (F.levenshtein("own_s", "own_u") <= F.greatest(F.lit(2), F.floor(F.greatest(F.length("own_s"), F.length("own_u")) * 0.3)))


def by_place(s: DataFrame, u: DataFrame, reach_m: float, *group: str) -> DataFrame:
    """sid, uid of facilities whose places, as written, are within reach (and of one group)."""
    left = u.where("y_u is not null").select(F.col("uid").alias("id_l"), F.col("y_u").alias("lat"), F.col("x_u").alias("lon"), *group)
    right = s.where("y_s is not null").select(F.col("sid").alias("id_r"), F.col("y_s").alias("lat"), F.col("x_s").alias("lon"), *group)
    return near_pairs(left, right, reach_m, group=group[0] if group else None).select(F.col("id_r").alias("sid"), F.col("id_l").alias("uid"))


def candidates(s: DataFrame, u: DataFrame, reach_m: float = 300.0) -> DataFrame:
    """sid, uid of every pair worth comparing: every facility enters every block that its fields allow.

    Blocks: a shared map id; a place within reach; MinHash bands across attributes (the name with the operator,
    two rows of the name a band; with the area, three rows); own words at one edit or swap whatever else is
    said; and, where a side has no place or one too coarse for the reach, bands of the name alone (three rows) and
    own words at two edits. Names that share a band must also be within about a
    third of their letters, tested before the pair is formed. All keys go through one join, in which
    one that many share is cut into stretches (salted_join()); none is left out.

    Names repeat, so these pairs grow with the product of both tables. score() therefore forms them of a
    part of the facilities only, to learn from, and of all facilities those alone that can be a link.
    """
    s, u = banded(s, "s"), banded(u, "u")
    near = F.when(F.col("rule_s") == "id", True).when(F.col("rule_s").isin("edit", "edits"), F.levenshtein("own_s", "own_u") <= 2).otherwise(alike())
    by_key = salted_join(blocks(s, "s", "sid", reach_m), blocks(u, "u", "uid", reach_m), "key", probe=("sid", "uid", 16)).where((F.col("rule_s") == F.col("rule_u")) & near).select("sid", "uid")
    return cut(by_key.unionByName(by_place(s, u, reach_m)).distinct(), "candidates")


#: Metres from which on a place of two decimals is not just coarse but far, and how coarse it is.
COARSE_M, FAR_M = 790.0, 200.0


def close_pairs(s: DataFrame, u: DataFrame, reach_m: float = 300.0) -> DataFrame:
    """sid, uid of the pairs that share a map id, are within reach, or may be so as one place is coarse and their names are alike.

    Every pair of candidates() that is not among them is far off, or has a side without a place.
    """
    ids = lambda df, i, x: df.select(i, F.explode(f"ids_{x}").alias("key"))
    by_id = salted_join(ids(s, "sid", "s"), ids(u, "uid", "u"), "key").select("sid", "uid")
    right = s.withColumn("met", F.lit("u")).unionByName(s.where(F.col("c_s") > reach_m / 2).withColumn("met", F.lit("s")))  # which side is coarse
    rough = by_place(right, u.withColumn("met", F.when(F.col("c_u") > reach_m / 2, "u").otherwise("s")), COARSE_M + FAR_M, "met")
    rough = rough.join(s.select("sid", "own_s"), "sid").join(u.select("uid", "own_u"), "uid").where(alike()).select("sid", "uid")
    return cut(by_id.unionByName(by_place(s, u, reach_m)).unionByName(rough).distinct(), "close")


#: What the features say about a pair, one value of each line: all that pair_features() can give.
STATES = {
    "word": ("same", "near", "other", "none"), "side": ("same", "other", ""), "place": ("same", "other", ""), "kind": ("other", ""), "op": ("same", "other", "none"),
    "dist": ("d30", "d60", "d100", "d200", "dfar", "dnone"), "type": ("same", "other", ""), "area": ("same", "other", ""), "coarse": (True, False), "mirrored": (True, False),
}


@functools.cache
def states() -> tuple[pd.DataFrame, np.ndarray]:
    """Every combination of STATES, and its packed features."""
    rows, bits = [], []
    for values in itertools.product(*STATES.values()):
        x = dict(zip(STATES, values))
        named = x["word"] in ("same", "near")
        if x["side"] and not named:
            continue
        held = {f"{k}_{x[k]}" for k in ("word", "side", "place", "kind", "op", "type", "area") if x[k]} | {x["dist"]} | {k for k in ("coarse", "mirrored") if x[k]}
        held |= {"close"} if x["dist"] in ("d30", "d60", "d100") else {"far"} if x["dist"] in ("d200", "dfar") else set()
        held |= {"twin"} if named and (x["side"] == "other" or x["kind"]) else set()
        rows.append(values)
        bits.append(sum(1 << BASE.index(k) for k in held))
    return pd.DataFrame(rows, columns=[*STATES]), np.array(bits, np.int64)


def demands(weights: np.ndarray, scale: tuple[float, float], dist: str, word: tuple[str, ...]) -> set[str] | None:
    """The features that are "same" in all pairs at this distance, with such names and without a shared map id, whose log odds
    reach 0; None if no such pair does.
    """
    every, bits = states()
    z = (unpacked(bits) @ weights[:-1] + weights[-1]) * scale[0] + scale[1]
    some = every[(z >= -1e-6) & (every["dist"] == dist).to_numpy() & every["word"].isin(word).to_numpy()]
    return {k for k in ("side", "place", "op", "type", "area") if set(some[k]) == {"same"}} if len(some) else None


def same_operators(s: DataFrame, u: DataFrame, most: int = 500) -> dict[str, list[str]] | None:
    """The operators of s that are the same as one of u; None where a table names more than ``most``.

    That shapes the plan and never the result: operators are compared in pair_features() in any case.
    """
    named = [df.where(f"op_{x} <> ''").select(f"op_{x}", f"op_words_{x}").distinct().limit(most + 1).collect() for df, x in ((s, "s"), (u, "u"))]
    if max(map(len, named)) > most:
        return None
    a, b = (s.sparkSession.createDataFrame(rows, f"op_{x} string, op_words_{x} array<string>").coalesce(1) for rows, x in zip(named, "su"))
    like: dict[str, list[str]] = {}
    for r in a.crossJoin(b).where(operator_state(F.col("op_s"), F.col("op_u"), F.col("op_words_s"), F.col("op_words_u")) == "same").select("op_s", "op_u").distinct().collect():
        like.setdefault(r.op_u, []).append(r.op_s)
    return like


def _parts(text: str) -> list[str]:
    n = len(text)
    return [f"{n}|{i}|{text[n * i // 3 : n * (i + 1) // 3]}" for i in range(3)]


def _probed(text: str) -> set[str]:
    n, out = len(text), set()
    for length in range(max(n - 2, 1), n + 3):
        for i in range(3):
            start, size = length * i // 3, length * (i + 1) // 3 - length * i // 3
            out |= {f"{length}|{i}|{text[start + k : start + k + size]}" for k in range(-2, 3) if start + k >= 0 and start + k + size <= n}
    return out


def far_keys(df: DataFrame, side: str, ident: str, plans: list[tuple[str, int, set[str]]], like: dict[str, list[str]] | None, reach_m: float = 300.0, seed: int = 17) -> DataFrame:
    """ident, own, key: the keys of candidates() under which a facility meets those that are far off (dist dfar) or without a place (dnone).

    plans: dist, least and what must be the "same" in a link and so is part of each key. Names of ``least`` letters or more
    have all keys of candidates() (see deletions(), thirds() and probes()); shorter ones those of one edit or of the
    same letters, which is all that word_same leaves them, also in one of several words.
    """
    seeds = np.random.default_rng(seed).integers(1, 2**61 - 1, ALONE * 3 + WITH * 2, dtype=np.uint64) | np.uint64(1)
    shortest = min(least for _, least, _ in plans)

    def keys_of(own: str, several: list[str], sides: list[str], places: list[str], op: str, kind: str | None, area: str | None, lost: bool, rough: bool) -> set[str]:
        texts = {own} | {w for w in several if len(several) > 1 and len(w) > 4}
        short = {t[:i] + t[i + 1 :] for t in texts for i in range(len(t))} | texts | {f"={''.join(sorted(t))}" for t in texts}
        banded, out = [], set()
        if len(own) >= shortest:
            low = _signature(own, seeds)
            alone = [f"{k}:{row}" for k, row in enumerate(low[: ALONE * 3].reshape(ALONE, 3).tolist())]
            banded = [f"o{k}:{row}{op[:4]}" for k, row in enumerate(low[ALONE * 3 :].reshape(WITH, 2).tolist())] if op else []
            banded += [f"a{b}{area}" for b in alone] if area is not None else []
        for at, (dist, least, same) in enumerate(plans):
            if dist == "dfar" and lost or "type" in same and kind is None or "area" in same and area is None:
                continue
            vague = lost if dist == "dnone" else rough
            by_vague = ("TF" if vague else "T") if side == "u" else "T" if vague else "F"  # a vague sample meets all supplies, the others only vague ones
            found = short
            if len(own) >= least:
                if (side == "u") or vague:
                    found = found | {f"s{x}" for x in (_probed(own) if side == "s" else _parts(own))}
                if (side == "s") != vague:
                    found = found | {f"u{x}" for x in (_parts(own) if side == "s" else _probed(own))}
                found = found | set(banded)
            met = {f"{m}{x}" for x in found for m in (by_vague if dist == "dnone" else "-")} | {f"{m}n{b}" for b in (alone if len(own) >= least else ()) for m in by_vague}
            fixed = [str(at), kind if "type" in same else "", area if "area" in same else "", " ".join(sides) if "side" in same else ""]
            ops = [""] if "op" not in same else [op] if side == "s" else like.get(op, [])
            out |= {"\t".join((*fixed, place, o, x)) for place in (places if "place" in same else [""]) for o in ops if o or "op" not in same for x in met}
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            i, own, key = [], [], []
            for ident_, *about in frame.itertuples(index=False, name=None):
                for k in keys_of(*about):
                    i.append(ident_), own.append(about[0]), key.append(k)
            yield pd.DataFrame({"i": i, "own": own, "key": key})

    some = df.where(F.length(f"own_{side}") > 0).select(ident, *(f"{c}_{side}" for c in ("own", "own_words", "sides", "places", "op", "type", "area")), F.col(f"y_{side}").isNull().alias("lost"), (F.col(f"c_{side}") > reach_m / 2).alias("rough"))
    return some.mapInPandas(run, f"i {dict(df.dtypes)[ident]}, own string, key string").select(F.col("i").alias(ident), F.col("own").alias(f"own_{side}"), F.xxhash64("key").alias("key"))


def far_pairs(s: DataFrame, u: DataFrame, weights: np.ndarray, scale: tuple[float, float]) -> DataFrame | None:
    """sid, uid of every pair by name that is far off or has a side without a place, and can be a link under these weights.

    demands() says what all such pairs have in common. That narrows the keys, so the work follows the pairs that
    agree in all of it and not those whose names are alike; no possible link is left out.
    """
    like, plans = same_operators(s, u), []
    for dist in ("dfar", "dnone"):
        for word, least in ((("same",), 10), (("near", "other"), 1)):  # of names of up to 11 letters, word_same allows one edit
            same = demands(weights, scale, dist, word)
            if same is not None:
                plans.append((dist, least, same - {"op"} if like is None else same))
    if not plans:
        return None
    a, b = far_keys(s, "s", "sid", plans, like), far_keys(u, "u", "uid", plans, like)
    return salted_join(cut(a, "keys"), cut(b, "keys"), "key").where(alike()).select("sid", "uid").distinct()


def _told(pairs: DataFrame, s: DataFrame, u: DataFrame) -> DataFrame:
    """What score() needs of each pair, written."""
    kinds = {"sid": dict(s.dtypes)["sid"], "uid": dict(u.dtypes)["uid"]}
    both = pairs.join(s, "sid").join(u, "uid").withColumns({"shared": F.arrays_overlap("ids_s", "ids_u"), "has_ids": F.size("ids_u") > 0, "both_ids": (F.size("ids_u") > 0) & (F.size("ids_s") > 0)})
    return pair_features(both).select(F.col("sid").cast(kinds["sid"]), F.col("uid").cast(kinds["uid"]), *(c for c in ("far",) if c in pairs.columns), "shared", "has_ids", "both_ids", "bits")


def score(s: DataFrame, u: DataFrame, train_rows: int = 40_000, seed: int = 11) -> tuple[DataFrame, list[tuple[float, float, int]]]:
    """sid, uid, confidence of every candidate pair that is close, and of the others that reach 0.5; and a calibration table of the held-out labels.

    Weak labels come from map ids, which the classifier never sees: pairs that share one are positive,
    the other candidates of the same supply facility negative, and so are all candidates of supply
    facilities whose ids no sample has. A ridge logistic regression is fitted on two thirds of at
    most ``train_rows`` labelled pairs (a documented bound; everything else covers all rows), and its
    scores are calibrated on the rest by a second, one-dimensional regression. Half of them are drawn from
    close_pairs(), half from the other candidates() of train_rows / 5 facilities a side, and each
    counts as many times as there are such pairs for one drawn. The ids then count as
    one more piece of evidence: how much more often matches share an id than other pairs is estimated
    from the scores themselves (expectation maximisation over a histogram of them), and the odds are
    multiplied by that ratio, or by that of not sharing one. Without labels of both kinds prior weights
    are used. Which pairs far_pairs() has to form follows from the weights. The table has, per tenth of the
    held-out probabilities: their mean, the share of true labels, and how many were drawn.
    """
    close, labelled = close_pairs(s, u), u.where(F.size("ids_u") > 0)
    some = lambda df, i: cut(df.orderBy(F.xxhash64(i, F.lit(seed)), i).limit(train_rows // 5), "drawn")
    part_s, part_u = some(s, "sid"), some(labelled, "uid")
    of_all = s.count() / max(part_s.count(), 1) * labelled.count() / max(part_u.count(), 1)
    far = candidates(part_s, part_u).join(close, ["sid", "uid"], "left_anti")
    told = cut(_told(close.withColumn("far", F.lit(False)).unionByName(far.withColumn("far", F.lit(True))), s, u), "pairs")
    near, draws = told.where("not far"), []
    for df, each in ((near.where("has_ids"), 1.0), (told.where("far"), of_all)):
        drawn = df.select(F.xxhash64("sid", "uid", F.lit(seed)).alias("h"), "bits", "both_ids", F.col("shared").cast("int").alias("y")).orderBy("h").limit(train_rows // 2).toPandas()  # at most train_rows / 2 rows of four numbers
        draws.append(drawn.assign(n=each * df.count() / max(len(drawn), 1)))
    drawn = pd.concat(draws, ignore_index=True).sort_values("h")
    weights, scale, table = prior_weights(), (1.0, 0.0), []
    if len(drawn) > 50 and drawn["y"].nunique() == 2:
        x, y, n = unpacked(drawn["bits"].to_numpy(np.int64)), drawn["y"].to_numpy(float), drawn["n"].to_numpy(float)
        held = np.arange(len(y)) % 3 == 2
        weights = fit_logistic(x[~held], y[~held], counts=n[~held])
        z = x[held] @ weights[:-1] + weights[-1]
        if len(set(y[held])) == 2:
            platt = fit_logistic(z[:, None], y[held], l2=1e-3, counts=n[held])
            scale = (float(platt[0]), float(platt[1]))
        p = 1 / (1 + np.exp(-np.clip(z * scale[0] + scale[1], -30, 30)))
        tenth = np.minimum((p * 10).astype(int), 9)
        table = [(float(np.average(p[tenth == k], weights=n[held][tenth == k])), float(np.average(y[held][tenth == k], weights=n[held][tenth == k])), int((tenth == k).sum())) for k in range(10) if (tenth == k).any()]
    rest = far_pairs(s, u, weights, scale)
    rated = near.select("sid", "uid", "shared", "both_ids", log_odds(weights, scale).alias("z"))
    bins = rated.where("both_ids").groupBy(F.round(F.col("z") * 4).alias("b"), "shared").agg(F.count("*").alias("n")).toPandas()  # at most 482 rows
    others = draws[1][draws[1]["both_ids"].astype(bool)]
    z_far = np.clip((unpacked(others["bits"].to_numpy(np.int64)) @ weights[:-1] + weights[-1]) * scale[0] + scale[1], -30, 30)
    has, lacks = id_evidence(np.concatenate([bins["b"].to_numpy(float) / 4, z_far]), np.concatenate([bins["shared"].to_numpy(bool), np.zeros(len(z_far), bool)]), np.concatenate([bins["n"].to_numpy(float), others["n"].to_numpy(float)]))
    if rest is not None:
        told = cut(_told(rest.join(close, ["sid", "uid"], "left_anti"), s, u).drop("has_ids"), "pairs")
        rated = rated.unionByName(told.select("sid", "uid", "shared", "both_ids", log_odds(weights, scale).alias("z")).where("z >= -1e-6"))
    z = F.col("z") + F.when(F.col("shared"), has).when(F.col("both_ids"), lacks).otherwise(0.0)
    return rated.select("sid", "uid", (1 / (1 + F.exp(-z))).alias("confidence")), table


def id_evidence(z: np.ndarray, shared: np.ndarray, n: np.ndarray, rounds: int = 20) -> tuple[float, float]:
    """Log ratios by which sharing, and not sharing, a map id speaks for a match, given the log odds of the rest.

    Both sides state ids in all pairs given. Each ratio rests on a pair more than seen, so it is finite.
    """
    has, lacks = 3.0, -1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z + np.where(shared, has, lacks), -30, 30)))
        among = ((p * n)[shared].sum() + 1) / ((p * n).sum() + 2)
        others = (((1 - p) * n)[shared].sum() + 1) / (((1 - p) * n).sum() + 2)
        has, lacks = float(np.log(among / others)), float(np.log((1 - among) / (1 - others)))
    return max(has, 0.0), min(lacks, 0.0)


def links(sample: DataFrame, supply: DataFrame, train_rows: int = 40_000, seed: int = 11) -> DataFrame:
    """sid, uid, confidence of the best sampled facility for each supply facility, if 0.5 or more.

    Confidences are those of score(); ties go to the larger sid. A null id is no facility; repeated
    ids are one. Nulls in any other column are missing evidence. Empty tables give no rows.
    """
    s, u = cut(samples(sample), "samples"), cut(supplies(supply), "supplies")
    rated, _ = score(s, u, train_rows, seed)
    best = rated.groupBy("uid").agg(F.max_by(F.struct("sid", "confidence"), F.struct("confidence", "sid")).alias("b"))
    return best.select("b.sid", "uid", "b.confidence").where("confidence >= 0.5")


def prior_weights() -> np.ndarray:
    """Weights for corpora without weak labels: agreement of name and place, against any conflict."""
    w = dict.fromkeys(FEATURES, 0.0) | {"word_same": 3.0, "word_near": 1.0, "word_other": -3.0, "side_other": -5.0, "place_other": -2.0, "kind_other": -4.0, "op_same": 1.5, "op_other": -3.0, "d30": 2.0, "d60": 2.0, "d100": 1.5, "d200": -3.0, "dfar": -5.0, "type_other": -2.0, "area_other": -2.0, "area_same": 0.5, "mirrored": -1.0}
    return np.array([*(w[f] for f in FEATURES), -2.0])
