"""Each operator against a plain version, and on nulls, empty texts and tables, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import length_histogram, line_dedup, mixing, packing, simhash, substring_dedup, suffix_dedup, toxicity, vectors

DOCS = "doc_id long, text string, source string, gone string, rank int, n_removed long, f int"
LOREM = [f"w{i}" for i in range(400)]


def corpus(seed=1, n=30):
    rnd = random.Random(seed)
    passages = [" ".join(rnd.choices(LOREM, k=40)) for _ in range(3)]
    rows = []
    for i in range(n):
        lines = [" ".join(rnd.choices(LOREM, k=rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), passages[i % 9 // 3])
        rows.append("\n".join(lines))
    rows += [rows[0], rows[3], "", None, "é" * 150, "ab" * 200, "ab" * 130, " \n\t ", "x"]
    return [(i * 2, t, "s0" if i % 3 else None, "g", 1, 2, 3) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def removed(units, size, seen):
    gone = [False] * len(units)
    for s in range(len(units) - size + 1):
        w = tuple(units[s : s + size])
        if w in seen:
            gone[s : s + size] = [True] * size
        seen.add(w)
    return gone


def runs(gone):
    return sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))


@pytest.mark.parametrize("of_words,size", [(True, 20), (False, 100)])
def test_repeats_removed(docs, of_words, size):
    op = substring_dedup.substring_dedup if of_words else suffix_dedup.suffix_dedup
    got = {r["doc_id"]: r for r in op(docs, kept=True).collect()}
    seen = set()
    for i, text, *_ in sorted(corpus()):
        units = re.findall(r"[^\x20\x09-\x0D]+", text or "") if of_words else (text or "").encode()
        gone = removed(units, size, seen)
        left = [u for u, g in zip(units, gone) if not g]
        kept = " ".join(left).encode() if of_words else bytes(left)
        assert got[i]["n_removed"] == sum(gone) and got[i]["n_spans"] == runs(gone), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
        assert got[i]["kept"] == (kept.decode() if of_words else kept)


@pytest.mark.parametrize("op", [line_dedup.line_dedup, substring_dedup.substring_dedup, suffix_dedup.suffix_dedup, simhash.groups, simhash.near_dedup, packing.pack, length_histogram.encoded_lengths])
def test_empty_table(empty, op):
    assert op(empty).count() == 0


def test_empty_tables_of_others(spark, empty):
    assert mixing.mix(empty, {"a": 1.0}).count() == 0
    assert length_histogram.length_histogram(length_histogram.encoded_lengths(empty)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectors.exact_top_k(none, F.col("id") % 2 == 0, 3).count() == 0
    assert vectors.nearest(none, F.col("id") % 2 == 0, 3).count() == 0
    model = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.toxicity(empty, model).count() == 0


def plain_chunks(text):
    lines = text.split("\n")
    marks = [False] + [int(hashlib.md5(f"{a}\n{b}".encode()).hexdigest()[:8], 16) % 2 == 0 for a, b in zip(lines, lines[1:])]
    starts = [0] + [i for i in range(2, len(lines) - 1) if marks[i] and not marks[i - 1]]
    return ["\n".join(lines[a:b]) for a, b in zip(starts, [*starts[1:], len(lines)])]


def test_line_dedup(spark):
    rnd = random.Random(7)
    block = "\n".join(f"line number {i * i} of a passage" for i in range(40))
    rows = [(1, block, 0), (2, "inserted\n" + block + "\nend", 0), (3, "", 0), (4, None, 0), (5, "line number 0 of a passage", 0), (6, block, 0)]
    rows += [(7, block + "\nmore", 0), (7, "other\ntext\n" + block, 0), (7, block + "\nmore", 0), (None, "a\nb\nc", 0), (None, "a\nb\nc", 0), (8, "a\nb\nc", 0), (9, "same\n" * 50, 0), (10, "same\n" * 50, 0)]
    rows += [(20 + i, "\n".join(rnd.choice([block, "x\ny", f"{rnd.random()}"]) for _ in range(5)), 0) for i in range(20)]
    first = {}
    place = lambda i, k: (i is not None, i or 0, k)
    for i, t, _ in rows:
        for k, c in enumerate(plain_chunks(t) if t is not None else []):
            first[c] = min(first.get(c, place(i, k)), place(i, k))
    want = []
    for i, t, _ in rows:
        chunks = plain_chunks(t) if t is not None else []
        kept = [c for k, c in enumerate(chunks) if "\n" not in c or first[c] == place(i, k)]
        want.append((str(i), "\n".join(kept) if t is not None else None, len(chunks), len(chunks) - len(kept)))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, n_removed int"))
    assert sorted(map(str, ((str(r["doc_id"]), r["text"], r["n_chunks"], r["n_removed"]) for r in got.collect()))) == sorted(map(str, want))
    assert sum(w[3] for w in want) > 60


def test_simhash_groups(docs):
    import xxhash

    prints = {}
    for i, text, *_ in corpus():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        h = [xxhash.xxh64(" ".join(words[j : j + 3]).encode(), seed=42).intdigest() for j in range(max(1, len(words) - 2))] if words else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for r in simhash.groups(docs).collect():
        assert r["f"][0] % 2**64 == prints[r["doc_id"]] and r["component_id"] == find(r["doc_id"])


@pytest.mark.parametrize("limit", [4096, 4])
def test_simhash_large_bucket(spark, limit):
    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 2**62))
    f = [base] + [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (60, 2)) if a != b] + [int(x) for x in rng.integers(0, 2**62, 60)]
    f += [base ^ (0b11111 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(5, 50, (60, 2))]
    f = sorted(set(f))
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(f)], "id long, f array<long>")
    found = simhash.components(simhash.links(df, 2, 4, 7, limit)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = {i: i for i in range(len(f))}
    near = [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 2]
    while any(want[i] != want[j] for i, j in near):
        for i, j in near:
            want[i] = want[j] = min(want[i], want[j])
    assert all(root.get(i, i) == want[i] for i in range(len(f)))


def test_simhash_rows_of_one_id(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "x y z"), (5, "x y z"), (6, "q r s"), (6, ""), (7, None)]
    got = sorted((r["doc_id"] or -1, r["f"][0], r["component_id"]) for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(i, c) for i, _, c in got if c == 1 and i in (1, -1)] == [(-1, 1), (1, 1), (1, 1), (1, 1)]
    assert sorted((i, c) for i, _, c in got if i in (5, 6, 7, -1)) == [(-1, 1), (-1, 5), (5, 5), (6, 6), (6, 6), (7, 6)]


def test_near_dedup_recall(spark):
    rnd = random.Random(4)
    rows, pairs = [], []
    for g in range(60):
        words = rnd.choices(LOREM, k=300) if g % 2 else [f"{rnd.random():.9f}" for _ in range(300)]
        rows.append((g * 10, " ".join(words)))
        copy = list(words)
        for _ in range(3):
            copy[rnd.randrange(300)] = "changed"
        rows.append((g * 10 + 1, " ".join(copy)))
        pairs.append(g * 10 + 1)
    rows += [(1000, ""), (1001, None), (1002, "")]
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(g * 10 in kept for g in range(60)) and {1000, 1001, 1002} <= kept
    assert sum(p not in kept for p in pairs) >= 54


def shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def test_near_dedup_repeats_count_once(spark):
    rnd = random.Random(8)

    def own(n):
        return " ".join(f"{rnd.random():.9f}" for _ in range(n))

    line, body = "this line of nine words stands in many texts", own(300)
    rows = [(i, "\n".join([line] * 40 + [own(100)])) for i in range(4)] + [(10 + i, "word " * 100 + own(100)) for i in range(4)]
    rows += [(20, body), (21, body + "\n" + "\n".join([line] * 60)), (22, body), (22, body)]
    kept = [r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [0, 1, 2, 3, 10, 11, 12, 13, 20]


@pytest.mark.parametrize("limit", [1 << 22, 1000])
def test_near_dedup_is_exact(spark, limit):
    rnd = random.Random(9)
    rows = []
    for g in range(150):
        base = [f"{rnd.random():.9f}" for _ in range(200)]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 1 + g % 4):  # each changed word costs five shingles, so similarities lie at 0.7 to 0.9
            copy = list(base)
            for i in rnd.sample(range(10, 190), rnd.randint(2, 7)):
                copy[i] = f"{rnd.random():.9f}"
            rows.append((g * 10 + k, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(4):
        for i in sets:
            for j in sets:
                if i // 10 == j // 10 and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()}
    assert kept == {i for i in sets if root[i] == i}


def test_schedule_keeps_every_window():
    weights = {"a": 0.5, "b": 0.3, "c": 1e-4, "d": 0.1999}
    table = mixing.schedule(weights, {"a": 9000, "b": 5400, "c": 2, "d": 3600, "unknown": 5})
    got = dict.fromkeys(weights, 0)
    total = sum(map(mixing.Fraction, weights.values()))
    ends = None
    for t, (s, j, release, deadline, slot) in enumerate(table):
        assert release <= slot < deadline and j == got[s] and slot == t
        got[s] += 1
        if ends is None:  # until a source is used up, every source is less than a block off its exact weight
            assert all(abs((t + 1) * mixing.Fraction(w) / total - got[k]) < 1 for k, w in weights.items())
            ends = t if got[s] == {"a": 9000, "b": 5400, "c": 2, "d": 3600}[s] else None
    assert ends > 17000 and got == {"a": 9000, "b": 5400, "c": 2, "d": 3600}


def test_mix_many_sources(spark):
    df = spark.range(6000).selectExpr("id AS doc_id", "concat('s', id % 5000) AS source")
    out = mixing.mix(df, {f"s{i}": 1.0 + i for i in range(5000)}, slots=100)
    assert out.count() == 6000 and out.select("mix_slot").distinct().count() == 5000


def test_mix(docs):
    out = mixing.mix(docs, {"s0": 3.0, "": 1.0}, block_rows=2)
    rows = out.orderBy("mix_slot", "mix_rank").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in corpus())
    assert len({(r["mix_slot"], r["mix_rank"]) for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["mix_block"]), set()).add(r["mix_slot"])
        assert r["mix_release"] <= r["mix_slot"] < r["mix_deadline"]
    assert all(len(s) == 1 for s in by.values())
    assert mixing.mixed(docs, {"s0": 1.0}).columns == docs.columns
    assert mixing.mixed(docs, {"s0": 1.0}).count() == docs.count()


def test_pack_block_and_table(spark, docs):
    bins, offsets, capacity = packing.pack_block([4, 3, 3, 2, 2, 1, 0], [4, 8], 1)
    used = {}
    for n, b, o, c in zip([4, 3, 3, 2, 2, 1, 0], bins, offsets, capacity):
        assert o == used.get(b, (0, c))[0]
        used[b] = (o + n, c)
    assert all(u <= c and (c == 4 or u > 4) for u, c in used.values())
    rows = packing.pack(docs, capacities=(16, 32)).collect()
    assert sorted(rows) == sorted(packing.pack(docs.repartition(7), capacities=(16, 32)).collect())
    total = {i: len((t or "").split()) for i, t, *_ in corpus()}
    got = {}
    for r in rows:
        assert r["bin_offset"] + r["n_tokens"] <= r["capacity"]
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == total


def test_histogram(spark):
    h = length_histogram.length_histogram(spark.createDataFrame([(n,) for n in [0, 3, 3, 700, 5, 1300]], "n_tokens long"))
    for r in h.collect():
        ns = [0, 3, 3, 700, 5, 1300]
        limit = r["n_tokens"]
        assert r["docs_at_least"] == sum(n >= limit for n in ns) and r["tokens_at_least"] == sum(n for n in ns if n >= limit)
        assert r["truncated_total"] == sum(min(n, limit) for n in ns) and r["share_at_most"] == sum(n <= limit for n in ns) / 6
    assert length_histogram.total_at(h, 100).first()["n_kept"] == 211
    assert length_histogram.quantile(h, 0.5).first()["n_tokens"] == 3


def vectors_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(300)]
    rows += [(400, None), (401, [1.0, None] * 8), (402, [float("nan")] * 16), (403, [0.0] * 16), (404, []), (405, rows[0][1]), (406, rows[0][1]), (None, rows[1][1]), (407, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_exact_top_k(spark):
    rows, df = vectors_table(spark)
    got = {}
    for r in vectors.exact_top_k(df, F.col("id") % 7 == 0, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(np.array(v) * 256) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all()}
    for q in [i for i in good if i % 7 == 0]:
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_nearest_recall(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    hit = total = 0
    got = vectors.nearest(df, F.col("id") % 20 == 0, 20).collect()
    found = {}
    for r in got:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hit += len(want & found[q])
        total += 20
    assert hit / total >= 0.9
    assert vectors.nearest(vectors_table(spark)[1], F.col("id") % 7 == 0, 3).filter("vec_id = 403 OR query_id IN (400, 401, 402)").count() == 0


def test_toxicity_held_out(spark):
    import zlib

    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = rnd.choices(["alpha", "beta", "gamma", "delta", "omega", "theta"], k=60)
        if toxic:
            for _ in range(4):
                words[rnd.randrange(60)] = rnd.choice(["vileness", "scumbag", "wretched"])
        rows.append((i, " ".join(words), "s", 2))
        labels.append((i, int(toxic)))
    rows += [(1000, "", "s", 2), (1001, None, "s", 2), (1002, "alpha beta " * 200_000, "s", 2), (0, rows[0][1], "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int")
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] not in held] + [(None, 1), (5000, None)], "doc_id long, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.toxicity(docs, model).collect()}
    assert len(out) == 403 and toxicity.toxicity(docs, model).columns == ["doc_id", "text", "score", "predicted"]
    assert sum(out[i]["predicted"] == int(i % 4 == 0) for i in held) / len(held) > 0.97
    assert out[1000]["score"] == out[1001]["score"] and 0 <= out[1000]["score"] < 0.7 and out[1002]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r[0] for r in kept.collect()} == {i for i, r in out.items() if not r["predicted"]}


def test_kneser_ney(spark):
    """Ratios of ten texts against sums over plain dictionaries."""
    from collections import Counter

    texts = [("the ape", 0), ("an apt ape", 0), ("tape", 0), ("idle idiot", 1), ("the idiot", 1), ("Ápe É", 1), ("x", 0), ("", 1), ("id", 1), ("idiom", 0)]
    counts = (Counter(), Counter())
    for t, toxic in texts:
        for w in t.split():
            padded = [0, 0, 0, 0, *(int(toxicity.symbol_table()[ord(c)]) for c in w), 0]
            for i in range(len(padded) - 4):
                counts[toxic][tuple(padded[i : i + 5])] += 1
    seen = set(counts[0]) | set(counts[1])
    levels = {}
    for k in range(4, 0, -1):
        levels[k] = Counter(g[1:] for g in seen)
        seen = set(levels[k])

    def shared(g):
        if not g:
            return 1 / len(levels[1])
        same = [n for x, n in levels[len(g)].items() if x[:-1] == g[:-1]]
        return (max(levels[len(g)][g] - 0.75, 0) + 0.75 * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    def p(c, g):
        n = counts[c]
        d = min(0.95, max(0.1, sum(x == 1 for x in n.values()) / max(1, sum(x == 1 for x in n.values()) + 2 * sum(x == 2 for x in n.values()))))
        same = [x for y, x in n.items() if y[:-1] == g[:-1]]
        return (max(n[g] - d, 0) + d * len(same) * shared(g[1:])) / sum(same) if same else shared(g[1:])

    rows = toxicity.gram_counts(spark.createDataFrame([(t, c) for t, c in texts] + [(None, 1)], "text string, toxic int")).toPandas()
    code = rows["gram"].to_numpy().astype(np.int64)
    got, _ = toxicity.ratios(code, rows["c0"].to_numpy(), rows["c1"].to_numpy())
    grams = {tuple(int(g) >> 5 * k & 31 for k in range(4, -1, -1)): r for g, r in zip(code, got)}
    assert set(grams) == set(counts[0]) | set(counts[1])
    for g, r in grams.items():
        assert abs(r - np.log(p(1, g) / p(0, g))) < 1e-4


def test_ratio_table():
    """The compact table holds each gram's ratio and each history's; equal texts have equal features wherever they stand."""
    rng = np.random.default_rng(4)
    gram = np.unique(rng.integers(0, 32**5, 500))
    ratio, history = toxicity.ratios(gram, rng.integers(0, 5, len(gram)), rng.integers(1, 5, len(gram)))
    place, row = table = toxicity.Model(gram, ratio, history).table()
    plain = np.repeat(history, 32)
    plain[gram] = ratio
    asked = np.r_[gram, (gram[:, None] // 32 * 32 + np.arange(32)).ravel(), rng.integers(0, 32**5, 5000)]
    assert np.abs(row[place[asked // 32] + asked % 32] - plain[asked]).max() <= 2**-17
    texts = ["an apt ape", "", "idle idiots " * 40_000, "an apt ape", "", "tape", "an apt ape"]
    made = toxicity.features(texts, table)
    assert (made[[0, 3, 6]] == made[0]).all() and (made[[1, 4]] == 0).all()
    assert (made[2] == toxicity.features(texts[2:3], table)[0]).all()


def test_encoded_lengths(spark):
    import tiktoken

    texts = ["", "plain words", "Zwölf Boxkämpfer jagen Viktor", "x" * 5000, None]
    got = {r["doc_id"]: r["n_tokens"] for r in length_histogram.encoded_lengths(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    ranks = {__import__("base64").b64decode(t): int(n) for t, n in (x.split() for x in open(length_histogram.VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=length_histogram.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(plain.encode(t)) if t else 0 for i, t in enumerate(texts)}
    assert plain.decode(plain.encode(texts[2])) == texts[2]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "packing"]
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r[0] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).toPandas(), docs.schema)
        assert docs.columns == columns and {r[0] for r in docs.select("doc_id").collect()} <= before
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in docs.select("doc_id").collect()}


def test_pipeline_follows_the_mix(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"text {i} " * (1 + i % 7), "big" if i % 4 else "small") for i in range(400)], "doc_id long, text string, source string")
    rows = [tuple(r) for r in corpus_pipeline.pack(spark, docs, "").collect()]
    slots = {r["doc_id"]: r["mix_slot"] for r in mixing.mix(docs, mixing.tempered_weights(docs)).collect()}
    assert {r[0]: r[-1] for r in rows} == slots
    monkeypatch.setattr(mixing, "tempered_weights", lambda docs: {"big": 1.0, "small": 9.0})
    assert sorted(rows) != sorted(tuple(r) for r in corpus_pipeline.pack(spark, docs, "").collect())


def test_pack_in_order(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 37 % 90), i * 911 % 5000) for i in range(500)] + [(900, None, 7), (901, "w " * 100, 8)], "doc_id long, text string, slot long")
    rows = packing.pack_in_order(docs, "slot", capacities=(16, 32), block_rows=50).collect()
    total, ends, used = {}, {}, {}
    for r in sorted(rows, key=lambda r: (r["block"], r["bin"], r["bin_offset"])):
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        lo, hi = ends.get(r["block"], (r["slot"], r["slot"]))
        ends[r["block"]] = min(lo, r["slot"]), max(hi, r["slot"])
        assert r["bin_offset"] == used.get((r["block"], r["bin"]), 0) and r["bin_offset"] + r["n_tokens"] <= r["capacity"]
        used[r["block"], r["bin"]] = r["bin_offset"] + r["n_tokens"]
    assert total == {**{i: i * 37 % 90 for i in range(500)}, 900: 0, 901: 100}
    spans = [ends[b] for b in sorted(ends)]
    assert len(spans) > 5 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
