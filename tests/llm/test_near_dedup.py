"""The candidate search of near_dedup by chains, and the memory of its comparisons."""

import random
import tracemalloc

import numpy as np

from llm import simhash


def test_chains_find_pairs_of_the_stage(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(f"n{i:03}", [rnd.randrange(-(2**63), 2**63), i]) for i in range(40)]
    for i in range(40, 120):  # each differs in two bits or fewer from one before
        word = rows[rnd.randrange(i)][1][0]
        for bit in rnd.sample(range(63), i % 3):
            word ^= 1 << bit
        rows.append((f"n{i:03}", [word, -i]))
    nodes = spark.createDataFrame(rows, "node string, f array<long>")
    root = {i: i for i, _ in rows}

    def top(i):
        return i if root[i] == i else top(root[i])

    pairs = [(r["node"], r["least"]) for r in simhash.chain_pairs(nodes).collect()]
    word = dict((i, f[0] % 2**64) for i, f in rows)
    assert all(a > b and (word[a] ^ word[b]).bit_count() <= 2 for a, b in pairs)
    for a, b in pairs:
        root[top(a)] = top(b)
    assert all(top(a) == top(b) for a in word for b in word if (word[a] ^ word[b]).bit_count() <= 2)

    asked, own = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a, **k: asked.append(a[1:]) or own(*a, **k))
    base = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, "more"])), (3, "other words than these")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == [1, 3]
    assert asked == [(2, 4, 7)]


def test_comparing_many_sets_holds_few_values():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 2**63, 1000).astype("<u8"))
    sets = [np.unique(np.r_[base[i % 900 + 100 :], base[: i % 900], rng.integers(0, 2**63, 200 + i % 7).astype("<u8")]) for i in range(2000)]
    comp = np.minimum(np.arange(2000), 1)  # the first is compared with all others
    tracemalloc.start()
    got = simhash.linked_sets(sets, comp, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [] and peak < 8_000_000
    sizes = np.array([len(x) for x in sets])
    which = np.array([7, 3, 1999, 500])
    assert simhash.shared(sets[3], sets, which, sizes).tolist() == [len(np.intersect1d(sets[3], sets[i])) for i in which]
    assert simhash.linked_sets([base, base[:-1], base[1:], sets[0]], np.arange(4), 0.8) == [(0, 1), (0, 2)]
