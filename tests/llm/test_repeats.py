"""Word and byte dedup against a plain version: repeated rows, one id with two texts, NULL ids, texts above one chunk."""

import hashlib
import random
import re

import pytest

from llm import common, substring_dedup, suffix_dedup, superkmers

LOREM = [f"w{i}" for i in range(300)]


def plain(rows, of_words, size):
    """{(id, text): (n removed, sha256 of what is left)}; a window goes if it starts at a smaller (id, start) anywhere."""
    units = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t or "") if of_words else (t or "").encode() for i, t in rows}
    place = lambda i, s: (i is not None, i or 0, s)
    first = {}
    for (i, t), u in units.items():
        for s in range(len(u) - size + 1):
            w = " ".join(u[s : s + size]) if of_words else u[s : s + size]
            first[w] = min(first.get(w, place(i, s)), place(i, s))
    out = {}
    for (i, t), u in units.items():
        gone, reach = [False] * len(u), 0
        for s in range(len(u) - size + 1):
            w = " ".join(u[s : s + size]) if of_words else u[s : s + size]
            if first[w] < place(i, s):
                for k in range(max(s, reach), s + size):
                    gone[k] = True
                reach = s + size
        left = [x for x, g in zip(u, gone) if not g]
        out[i, t] = sum(gone), hashlib.sha256(" ".join(left).encode() if of_words else bytes(left)).hexdigest()
    return out


def held(spark, rows, of_words, parts=3):
    op = substring_dedup.substring_dedup if of_words else suffix_dedup.suffix_dedup
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_removed"], r["kept_sha256"]) for r in op(df).collect())
    want = plain(rows, of_words, 20 if of_words else 100)
    assert got == sorted((i is not None, i or 0, *want[i, t]) for i, t in rows)
    return [g[2] for g in got]


@pytest.mark.parametrize("of_words", [True, False])
@pytest.mark.parametrize("parts", [1, 4])
def test_rows_of_one_id(spark, of_words, parts):
    rnd = random.Random(3)
    text = lambda n: " ".join(rnd.choices(LOREM, k=n))
    a, b, c = text(60), text(80), text(50)
    rows = [(1, a), (1, a), (2, b), (2, a + " " + c), (2, b), (3, c + " " + b), (3, text(5) + " " + c), (4, a + " end"), (4, a + " fin")]
    rows += [(None, a), (None, c), (None, a), (None, None), (5, ""), (5, None), (6, "x " * 30)]
    held(spark, rows, of_words, parts)
    assert held(spark, [(7, a), (7, a)], of_words, parts) == [0, 0]


@pytest.mark.parametrize("of_words", [True, False])
def test_text_above_one_chunk(spark, of_words):
    rnd = random.Random(4)
    n = superkmers.CHUNK + 5000
    if of_words:
        words = [str(rnd.randrange(10**7)) for _ in range(n)]
        words[-300:-200] = words[1000:1100]
        words[superkmers.CHUNK - 50 : superkmers.CHUNK + 50] = words[2000:2100]
        rows = [(1, " ".join(words)), (2, " ".join(words[superkmers.CHUNK - 200 : superkmers.CHUNK + 200]))]
    else:
        long = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
        long = long[: superkmers.CHUNK - 150] + long[3000:3300] + long[superkmers.CHUNK + 150 :]
        rows = [(1, long), (2, long[superkmers.CHUNK - 500 : superkmers.CHUNK + 500])]
    assert all(held(spark, rows, of_words))


@pytest.mark.parametrize("of_words", [True, False])
def test_shared_parts(spark, of_words):
    rnd = random.Random(5)
    passages = [" ".join(rnd.choices(LOREM, k=rnd.randint(15, 70))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.5 else " ".join(rnd.choices(LOREM, k=rnd.randint(1, 25))) for _ in range(rnd.randint(1, 6))]
        rows.append((i // 2 if i % 10 == 0 else i, " ".join(parts)))
    held(spark, rows, of_words)


def test_frequent_minimiser(spark):
    rows = [(i, f"{i:>90}" + "passage of bytes that is shared by all rows " * 3 + f"{i * 7 % 13:<90}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string")
    spans = lambda peers: {
        (i, k) for i, s, n in ((r["id"], r["start"], r["n"]) for r in suffix_dedup.repeated_spans(common.versions(df), peers=peers).collect()) for k in range(s, s + n)
    }
    assert spans(1) == spans(2000) != set()
