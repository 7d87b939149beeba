import itertools
import random
from datetime import datetime

import numpy as np

from lotgrid.llm.entities import BASE, _told, candidates, closeness, deletions, demands, describe, far_pairs, fit_logistic, id_evidence, links, log_odds, operator_state, osm_ids, prior_weights, probes, samples, states, supplies, thirds, words
from pyspark.sql import functions as F

T = datetime(2025, 1, 1)
SAMPLE = "rec_id long, facility_id string, name string, operator string, type string, area string, lat double, lon double, osm_ids string, load_ts timestamp, uid string"
SUPPLY = "facility_id string, name string, operator string, type string, submarket string, lat double, lon double, source_ids string, sid string"


def test_parts(spark):
    assert words("Parking Garage at Upper Tiether St") == ("tiether", {"upper"}, {"street"}, {"garage"})
    rows = [("weenkett", "weenektt"), ("", "x"), ("abc", "abc"), ("kealnen", "kelnen"), ("abcdefgh", "bacdefg")]
    got = [round(r.c, 3) for r in spark.createDataFrame(rows, "a string, b string").select(closeness(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [0.875, 0.0, 1.0, 0.857, 0.75]
    ops = [("Marrow Street Trust", "Marrow St. Tr."), ("Kestrel Park Co", "Kestrel Pk. Co."), ("Ninebay Operations", "Nine Bay Ops"), ("Municipal Stall Works", "Stall Works, Municipal"), ("Tessel Garages", "TESSEL"), ("Harrow & Pike Parking", "Harrow/Pike Pkg"), ("Dovecote Valet", "Orrin Curb Services"), (None, "x")]
    both = spark.createDataFrame([(i, a, b, "Own Lot", None) for i, (a, b) in enumerate(ops)], "i long, a string, b string, n string, own_s string")
    side = lambda c, s: describe(both.select("i", c, "n"), "i", "n", c).select("i", F.col("op").alias(f"op_{s}"), F.col("op_words").alias(f"w_{s}"))
    got = [r.o for r in side("a", "s").join(side("b", "u"), "i").orderBy("i").select(operator_state(F.col("op_s"), F.col("op_u"), F.col("w_s"), F.col("w_u")).alias("o")).collect()]
    assert got == ["same"] * 6 + ["other", "none"]


def test_id_evidence_follows_the_scores():
    z = np.array([4.0, 4.0, -4.0, -4.0])
    has, lacks = id_evidence(z, np.array([True, False, True, False]), np.array([900.0, 10.0, 1.0, 5000.0]))
    assert has > 4 and lacks < -2
    none = id_evidence(np.array([]), np.array([], bool), np.array([]))
    assert none == (0.0, 0.0)


def test_a_unique_name_far_away_is_a_candidate(spark):
    s = spark.createDataFrame([(1, "F1", "Quorvaxley Street Lot", None, None, None, 26.0, -123.0, None, T, "x")], SAMPLE)
    u = spark.createDataFrame([("U1", "Quorvaxely St Lot", None, None, None, 26.144, -123.0, None, "x"), ("U2", "Else Lot", None, None, None, 26.144, -123.0, None, "x")], SUPPLY)
    assert [tuple(r) for r in candidates(samples(s), supplies(u)).collect()] == [("F1", "U1")]


def test_ids(spark):
    t = ['"relation/12, deck";W/3', "way 4;n5", None, "", "floor 3"]
    got = [r.i for r in spark.createDataFrame([(x,) for x in t], "t string").select(osm_ids(F.col("t")).alias("i")).collect()]
    assert got == [["r12", "w3"], ["w4", "n5"], [], [], []]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def test_names_at_few_edits_meet(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
    rows = [("cigcik", "cigick"), ("reedrane", "reerdane"), ("ab", "a"), ("a", "b")] + [(word(), word()) for _ in range(3000)]
    meet = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.arrays_overlap(deletions(F.col("a")), deletions(F.col("b"))).alias("one"), F.arrays_overlap(probes(F.col("a")), thirds(F.col("b"))).alias("two")).collect()
    near = [r for r in meet if edits(r.a, r.b) <= 2]
    assert len(near) > 300 and all(r.two for r in near) and all(r.one for r in meet if edits(r.a, r.b) <= 1)
    assert [r.one for r in meet[:2]] == [True, True]


def test_logistic_recovers_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.allclose(fit_logistic(x, y, 1e-3), [2, -1, 0.5], atol=0.25)


def test_links_without_labels_use_priors(spark):
    s = spark.createDataFrame([(1, "F1", "Kober Commons Lot", "Tessel Garages", "Surface", "A", 26.0, -123.0, None, T, "x"), (2, "F1", None, "Tessel Garages", "Surface", "A", 26.0, -123.0, "", T, "x"), (3, "F2", "Upper Meag Commons Garage", None, "Garage", "A", 26.1, -123.0, None, T, "x"), (4, None, None, None, None, None, None, None, None, T, None)], SAMPLE)
    u = spark.createDataFrame([("U1", "KOBER CMNS LOT", "TESSEL", "Surface", "A", 26.0003, -123.0, None, "x"), ("U2", "Lower Meag Commons Garage", None, "Garage", "A", 26.1003, -123.0, None, "x"), ("U3", "Kober Commons Lot", "Tessel", "Surface", "A", 27.0, -123.0, "way/9", "x"), ("U4", None, None, None, None, None, None, None, None)], SUPPLY)
    got = {(r.sid, r.uid) for r in links(s, u).collect()}
    assert got == {("F1", "U1")}
    assert links(s.limit(0), u).count() == 0 and links(s, u.limit(0)).count() == 0


def test_held_out_accuracy_on_weak_labels(spark):
    d = "/root/testdata/sf0.01"
    s, u = spark.read.parquet(f"{d}/round1_sample.parquet"), spark.read.parquet(f"{d}/supplyfacilities.parquet")
    known = {(r.sid, r.uid) for r in s.select(F.col("facility_id").alias("sid"), F.explode(osm_ids(F.col("osm_ids"))).alias("k")).join(u.select(F.col("facility_id").alias("uid"), F.explode(osm_ids(F.col("source_ids"))).alias("k")), "k").select("sid", "uid").distinct().collect()}
    hidden = links(s, u.withColumn("source_ids", F.when(F.xxhash64("facility_id") % 2 == 0, F.col("source_ids"))))
    got = {(r.sid, r.uid) for r in hidden.collect()}
    found = len(known & got) / len(known)
    assert found > 0.9


def _named(n, seed):
    """Facilities a kilometre and more apart whose names are all alike, with few operators, types and areas."""
    rng = random.Random(seed)
    own = [f"Kober{a}{b}ane" for a, b in itertools.product("adeimost", "lmnr")] + ["Quorvaxleymere Tonn", "Quorvaxleymare", "Kober", "Kobre"]
    pick = lambda *x: rng.choice(x)
    for i in range(n):
        name = f"{pick('', 'Upper ', 'Lower ')}{rng.choice(own)} {pick('Street ', 'Plaza ', '')}{pick('Lot', 'Garage', 'Parking')}"
        yield i, name, pick(None, "Tessel Garages", "TESSEL", "Marrow Street Trust"), pick("Surface", "Garage", "Mixed", None), pick("A", "B", None), *pick((None, None), (26.0 + i / 50 + seed / 90, -123.0), (round(26.0 + i / 50, 2), -123.01))


def test_pairs_far_apart_grow_with_the_possible_links_and_none_is_lost(spark):
    s = samples(spark.createDataFrame([(i, f"F{i:03}", n, o, t, a, y, x, None, T, "x") for i, n, o, t, a, y, x in _named(150, 1)], SAMPLE)).cache()
    u = supplies(spark.createDataFrame([(f"U{i:03}", n, o, t, a, y, x, None, "x") for i, n, o, t, a, y, x in _named(150, 2)], SUPPLY)).cache()
    every = candidates(s, u)
    for intercept in (-2.6, 3.0, 5.0):
        weights = prior_weights()
        weights[-1] += intercept
        told = _told(every, s, u).select("sid", "uid", log_odds(weights, (1.0, 0.0)).alias("z"), F.col("bits").bitwiseAND(F.lit(sum(1 << BASE.index(k) for k in ("dfar", "dnone")))).alias("far")).collect()
        possible = {(r.sid, r.uid) for r in told if r.z >= 0 and r.far}
        formed = {tuple(r) for r in far_pairs(s, u, weights, (1.0, 0.0)).collect()}
        assert possible <= formed and (len(possible) > 10 or intercept < 0)
        assert len(formed) < len(told) / 10 or intercept > 0


def test_demands_hold_for_all_that_can_be_a_link():
    every, bits = states()
    assert len(every) == len(set(bits.tolist())) and demands(prior_weights(), (1.0, 0.0), "dfar", ("same", "near", "other")) is None
    assert demands(prior_weights(), (1.0, -2.6), "dnone", ("same",)) == {"op", "area"} and demands(prior_weights(), (1.0, 9.0), "dfar", ("same",)) == set()
