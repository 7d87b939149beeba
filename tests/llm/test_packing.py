import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lotgrid.llm.packing import best_fit, configuration_program, fill, pack, program_and_rest, slots


def held(bins):
    out = {}
    for many, inside in bins:
        for s, n in inside.items():
            out[s] = out.get(s, 0) + many * n
    return out


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_every_item_once_and_nothing_too_full(demand):
    sizes = np.array(list(demand))
    for bins in (best_fit(dict(demand), 40), configuration_program(sizes, np.array(list(demand.values())), 40, rounds=20)):
        assert held(bins) == demand and all(sum(s * n for s, n in inside.items()) <= 40 for _, inside in bins)
        volume = sum(s * n for s, n in demand.items())
        assert sum(m for m, _ in bins) <= 2 * volume / 40 + 1


def test_the_program_itself_packs_nearly_everything():
    rng = np.random.default_rng(3)
    sizes, demand = np.arange(1, 200), rng.integers(1, 40, 199)
    kept, rest = program_and_rest(sizes, demand, 400)
    volume = int((sizes * demand).sum())
    assert sum(s * n for s, n in rest.items()) <= 0.05 * volume
    together = held(kept)
    assert {s: together.get(s, 0) + rest.get(s, 0) for s in sizes.tolist()} == dict(zip(sizes.tolist(), demand.tolist()))
    assert sum(m for m, _ in configuration_program(sizes, demand, 400)) <= 1.01 * volume / 400 + 1


def test_slots_cover_each_rank_once():
    bins = [(2, {3: 2, 5: 1}), (1, {3: 1})]
    seen = {}
    for size, first, base, each in slots(bins):
        seen.setdefault(size, []).append((first, base, each))
    assert seen == {3: [(0, 0, 2), (4, 2, 1)], 5: [(0, 0, 1)]}


def test_pack(spark):
    rng = np.random.default_rng(1)
    n = [int(x) for x in rng.integers(1, 60, 500)] + [30] * 400 + [0, 0, 250, 100]
    items = spark.createDataFrame([(i, x) for i, x in enumerate(n)] + [(0, n[0]), (None, 7)], "doc_id long, n_tokens int")
    kinds = spark.createDataFrame([("small", 100, "t"), ("big", 300, "t"), ("none", 0, "t")], "container_kind string, capacity_tokens int, container_no string")
    got = pack(items, kinds, rounds=40, salts=5).toPandas()
    total = sum(n) + n[0] + 7
    for kind, cap in (("small", 100), ("big", 300)):
        g = got[got.container_kind == kind]
        used = g.groupby("container_no").n_tokens.sum()
        assert used.max() <= cap and g.n_tokens.sum() == total and len(used) <= 1.05 * total / cap + 1
        assert sorted(g[g.doc_id == 902].start_token) == ([0, 100, 200] if cap == 100 else [0])
    assert len(got[(got.container_kind == "small") & (got.doc_id == 0)]) == 2
    assert pack(items.limit(0), kinds).count() == 0
    assert {r.container_kind: r.share_used <= 1 for r in fill(spark.createDataFrame(got.dropna()), kinds).collect()} == {"small": True, "big": True}
