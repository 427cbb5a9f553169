"""Operators 11 to 13 against plain versions, and on nulls, empty texts and tables, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import prefix_trie, quality_rules, whitening

WORD = r"[^\x20\x09-\x0D]+"


# -- 11 --


def rules(text):
    w = re.findall(WORD, text or "")
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def js(p, q):
    if not sum(p) or not sum(q):
        return 0.0
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m) if x > 0)
    return max(0.0, (part(p) + part(q)) / 2)


def verdicts(rows):
    """kept of (text, lang) rows, from lists."""
    sizes = collections.Counter(g for _, g in rows)
    of = [g if g is not None and sizes[g] >= len(rows) / 256 else None for _, g in rows]
    tokens = [re.findall(WORD, t or "") for t, _ in rows]
    counts = collections.defaultdict(collections.Counter)
    for g, w in zip(of, tokens):
        counts[g].update(x for x in w if len(x) <= 32)
    top = {g: [x for x, n in sorted(c.items(), key=lambda z: (-z[1], z[0])) if n > 1][:32] for g, c in counts.items()}
    chars, hists = [], []
    for (t, _), g, w in zip(rows, of, tokens):
        c = [len(re.findall(k.replace("\\x{80}-\\x{24F}", "\x80-ɏ"), t or "")) for k in quality_rules.CLASSES]
        chars.append([*c, len(t or "") - sum(c)])
        n = collections.Counter(w)
        h = [n[x] for x in top[g]] + [0] * (32 - len(top[g]))
        hists.append([*h, len(w) - sum(h)])
    good = [not rules(t)[-1] for t, _ in rows]
    refs = {}
    for _ in range(2):
        for g in set(of):
            if any(ok and x == g for ok, x in zip(good, of)):
                refs[g] = [np.sum([v for v, x, ok in zip(z, of, good) if ok and x == g], axis=0) for z in (chars, hists)]
        good = []
        for (t, _), g, c, h in zip(rows, of, chars, hists):
            r = refs.get(g, [[0] * 8, [0] * 33])
            class_excess = js(c, r[0]) - 7 / (8 * np.log(2) * max(sum(c), 1))
            word_excess = js(h, r[1]) - 32 / (8 * np.log(2) * max(sum(h), 1))
            good.append(not rules(t)[-1] and not (class_excess > 0.03 and sum(c) >= 100) and not (word_excess > 0.05 and sum(h) >= 50))
    return good


def texts(seed=2, n=160):
    rnd = random.Random(seed)
    small = ["the", "of", "and", "to", "a", "in", "is", "it"]
    rows = []
    for i in range(n):
        w = [rnd.choice(small) if rnd.random() < 0.4 else "".join(rnd.choices("abcdefghilmnorstu", k=rnd.randint(3, 9))) for _ in range(rnd.randint(3, 300))]
        rows.append(("\n".join(" ".join(w[j : j + 12]) for j in range(0, len(w), 12)), "en" if i % 3 else "fr"))
    word = lambda: "".join(rnd.choices("abcdefghilmnorstu", k=6))
    rows += [(" ".join(word().upper() + "!!" for _ in range(120)), "en"), (" | ".join(word() for _ in range(120)), "fr")]
    rows += [("a b c d e " * 40, "en"), ("x y z u v x y z u v " + " ".join(word() for _ in range(60)), None), (None, None), ("", "en"), (" \n\t", "de")]
    rows += [("line one\n\nline one\nline two\n \nline one", "en"), rows[0], rows[0], ("é漢 " * 30, "fr"), ("w" * 50_000, "en"), (" ".join(rows[1][0] for _ in range(60)), "en")]
    return rows


def test_rules_against_plain_version(spark):
    rows = texts()
    kept = verdicts(rows)
    df = spark.createDataFrame([(i, t, g, "own", True, 7) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, w string, kept boolean, m int").repartition(5)
    got = {r["doc_id"]: r for r in quality_rules.quality(df, carry=["w", "m"]).collect()}
    assert len(got) == len(rows) and not all(kept) and sum(kept) > 100
    for i, (t, _) in enumerate(rows):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == rules(t), i
        assert r["kept"] == kept[i] and r["w"] == "own" and r["m"] == 7, i


def test_rules_on_odd_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality_rules.quality(df).count() == 0
    df = spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[1:6] for r in quality_rules.quality(df).collect()] == [(0, 0, 0, 0, 0)] * 3


def test_rules_run_without_python_workers(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    plan = quality_rules.quality(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 12 --


def trie(rows):
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append(((t is not None, t or 0), x or "", r or ""))
    by = {c: [(r, x) for _, x, r in sorted(v)] for c, v in by.items()}
    rebuilt = {}
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = by.get(c - int(np.fmod(c, 20)), [])[:h] + v[h:]
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    below = collections.defaultdict(list)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = sum(saved[k] for k in below[p]) + ((len(members[p]) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(rebuilt[c]) == len(p)).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(below[p]), leaves[p], saved[p], ends(p)) for p, m in members.items()]


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


TURNS = "conv_id long, turn long, role string, text string, pos int, c string"


def conversations(seed=4):
    rnd = random.Random(seed)
    openings = [("system", "be kind to all"), ("user", "hello there"), (None, None), ("user", "")]
    rows = []
    for c in [*range(0, 130), -1, -19, -20, -41, 1000, 1001, 1019]:
        n = rnd.choice([0, 1, 1, 2, 3, 4, 6])
        for t in range(n):
            role, text = rnd.choice(openings) if rnd.random() < 0.7 else ("user", f"words {rnd.randint(0, 3)} \n x")
            rows.append((c, t, role, text))
    rows += [(7, None, "user", "first"), (7, 0, "user", "tie b"), (7, 0, "user", "tie a"), (7, 0, "user", "tie a"), (None, 0, "user", "nobody"), (2, 5, "user", "only late turns")]
    return rows


def test_trie_against_plain_version(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(5)
    assert in_order(prefix_trie.prefix_trie(df).collect()) == in_order(trie(rows))


def test_trie_bands_chunks_and_a_deep_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BAND", 16)
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(c, t, "user", f"turn {t}") for c in range(200, 300) for t in range(2)]
    rows += [(20, t, "user", f"long {t % 7}") for t in range(300)] + [(21, t, "user", f"long {t % 7}") for t in range(90)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS).repartition(5)
    assert in_order(prefix_trie.prefix_trie(df).collect()) == in_order(trie(rows))


def test_trie_notices_equal_fingerprints(spark, monkeypatch):
    """With one small prime, different prefixes share fingerprints; the comparison of stored turns finds it."""
    monkeypatch.setattr(prefix_trie, "PRIMES", (3,) * 4)
    df = spark.createDataFrame([(c, 0, "user", f"text {c}", 1, "x") for c in range(0, 2000, 20)], TURNS)
    with pytest.raises(RuntimeError):
        prefix_trie.prefix_trie(df, tries=2)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    df = spark.createDataFrame([(None, 1, "user", "a", 1, "x")], TURNS)
    assert prefix_trie.prefix_trie(df).count() == 0
    got = prefix_trie.prefix_trie(spark.createDataFrame([(5, 0, None, None, 1, "x")], TURNS), head=F.lit(3)).collect()
    assert [tuple(r)[:7] for r in got] == [(5, 0, None, 1, 0, 1, 0)]  # no base, no own turn behind the head: a turnless conversation


# -- 13 --


def whitened(spark, x, extra=()):
    rows = [(i, v.tolist(), 1, 2.0) for i, v in enumerate(x)] + [(*r, 1, 2.0) for r in extra]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, v double").repartition(3)
    return whitening.whitening(df).toPandas()


def held(x, got):
    whole = np.floor(64 * x).astype(np.int64) + 1_000_000
    fit = np.unique(whole, axis=0)
    n, total = len(fit), fit.sum(0)
    u, sigma, vt = np.linalg.svd((n * fit - total) / n, full_matrices=False)
    rank = min(16, int((sigma > sigma[0] * len(total) * 2.3e-16).sum()))
    deviation = [sum(int(v) ** 2 for v in row) for row in n * whole - total]
    want = ((n * whole - total) / n) @ vt[:rank].T / (sigma[:rank] / np.sqrt(n))
    table = got[got.vec_id < len(x)].set_index(["vec_id", "component"]).sort_index()
    w = table.whitened.unstack().to_numpy()
    assert w.shape == want.shape and (table.n == n).all()
    assert [None if v >= 2**63 else v for v in deviation] == [None if v != v else int(v) for v in table.deviation.unstack()[1]] or max(deviation) > 2**53
    assert np.allclose(w * np.sign((w * want).sum(0)), want, atol=1e-5)
    assert np.allclose(table.explained.unstack().to_numpy()[0], sigma[:rank] ** 2 / (sigma**2).sum(), rtol=1e-4)
    assert got.identity_error.max() <= 1e-4


def test_whitening_against_svd(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 24)) @ rng.normal(size=(24, 24))
    x[10:60] = x[5]
    extra = [(900, None), (901, [None] * 24), (902, [float("inf")] * 24), (903, [1.0]), (904, []), (None, [1.0] * 24), (905, [1e300] * 24)]
    got = whitened(spark, x, extra)
    held(x, got)
    assert len(got) == 400 * 16


def test_whitening_of_graded_and_collinear_data(spark):
    rng = np.random.default_rng(4)
    held(x := rng.normal(size=(300, 6)) * np.array([1e5, 1e4, 1e3, 100, 10, 1]), whitened(spark, x))
    flat = rng.integers(-9, 9, size=(300, 5)).astype(float)
    x = np.hstack([flat, flat[:, :1], np.full((300, 1), 3.0), flat[:, 1:2] - flat[:, 2:3]])
    got = whitened(spark, x)
    assert got.component.max() == 5
    held(x, got)


def test_whitening_of_nothing(spark):
    assert len(whitened(spark, np.empty((0, 3)))) == 0
    assert len(whitened(spark, np.ones((4, 3)))) == 0
    got = whitened(spark, np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]]))
    assert got.component.tolist() == [1, 1, 1] and np.allclose(np.abs(got.whitened), 1) and np.allclose(got.explained, 1)


def test_sums_beyond_long_arithmetic():
    x = np.array([[2**45 + 3, 5]])
    n, total = 2**30, np.array([2**75 + 2**31, 2**32], dtype=object)
    assert np.array_equal(whitening._centred(x, n, total), [[1.0, 1.0]])
