"""Toxicity scores from class-conditional Kneser-Ney models of letters, over words and documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbols: 0 ends a word, 1 to 26 are a to z without case, 27 to 31 hold all other letters by code point.
SYMBOLS = 32
ORDER = 5
#: The share of a toxic text's words that are toxic, and the number of likeliest words that are averaged.
SHARE, BEST = 0.05, 3
FEATURES = ("mean", "mixture", "best", "log_words")
#: Characters that are worked on at once; a longer text is a chunk of its own.
CHUNK = 1 << 18
_symbols: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """The symbol of each code point."""
    if not _symbols:
        out = (27 + np.arange(0x110000) % 5).astype(np.uint8)
        for c in range(0x3000):
            low = chr(c).lower()[:1]
            out[c] = 0 if not low.isalpha() else ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
        _symbols.append(out)
    return _symbols[0]


@dataclass(frozen=True)
class Grams:
    """n-grams of some texts: code and document of each symbol, the words' first and last + 1 symbol, and their documents."""

    code: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    word_doc: np.ndarray


def grams_of(texts: list[str]) -> Grams:
    """Texts as letters; ORDER - 1 zeros begin each word, the first of those behind it ends it."""
    pad = ORDER - 1
    n = np.array([len(t) for t in texts]) + 2
    joined = "\0".join(["", *(t + "\0" for t in texts)])
    s = symbol_table()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")[: n.sum()]]
    doc = np.repeat(np.arange(len(texts)), n)
    keep = (s != 0) | np.r_[True, s[:-1] != 0]
    s, doc = s[keep].astype(np.int64), doc[keep]
    times = np.where(s == 0, pad, 1)
    s, doc = np.repeat(s, times), np.repeat(doc, times)
    code = s.copy()
    for k in range(1, ORDER):
        code[k:] += s[:-k] << (5 * k)
    letter = s != 0
    start = np.flatnonzero(letter & np.r_[True, ~letter[:-1]])
    stop = np.flatnonzero(letter & np.r_[~letter[1:], True]) + 2  # with the 0 behind the word
    code[~letter & np.r_[True, ~letter[:-1]]] = -1
    return Grams(code, doc, start, stop, doc[start])


def chunks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of at most CHUNK characters, or one text."""
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < len(texts) and total + len(texts[j]) <= CHUNK:
            total += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, c0, c1) over all rows (text, toxic); counts combine in each batch before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            toxic = np.array([x is not None and x > 0 for x in b.column(1).to_pylist()], bool)
            for i, some in chunks(texts):
                g = grams_of(some)
                used = g.code >= 0
                key, n = np.unique(g.code[used] * 2 + toxic[i + g.doc[used]], return_counts=True)
                gram, at = np.unique(key >> 1, return_inverse=True)
                c = np.zeros((2, len(gram)), np.int64)
                c[key & 1, at] = n
                yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(c[0]), pa.array(c[1])], ["gram", "c0", "c1"])

    rows = docs.filter("text IS NOT NULL AND toxic IS NOT NULL").select("text", "toxic").mapInArrow(count, "gram int, c0 long, c1 long")
    return rows.groupBy("gram").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def ratios(gram: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood ratios of the grams, and of each history before an unseen symbol: Kneser-Ney for both classes over one shared backoff.

    p_c(x | h) = (max(n_c(hx) - D_c, 0) + D_c t_c(h) s(x | h')) / n_c(h). The lower orders s are
    Kneser-Ney too, from continuation counts of both classes together, so an n-gram that neither class has seen
    gets the same s under both, and only the weights of the histories differ.
    """
    seen = gram
    lower = []
    for k in range(ORDER - 1, 0, -1):
        cont = np.bincount(seen % SYMBOLS**k, minlength=SYMBOLS**k)
        lower.append((k, cont))
        seen = np.flatnonzero(cont)
    s = np.full(len(gram), 1 / max(1, len(seen)))
    for k, cont in reversed(lower):
        table = cont.reshape(-1, SYMBOLS)
        mass, kinds = table.sum(1), (table > 0).sum(1)
        part = gram % SYMBOLS**k
        h = part // SYMBOLS
        m = np.maximum(mass[h], 1)
        s = np.where(mass[h] > 0, (np.maximum(cont[part] - 0.75, 0) + 0.75 * kinds[h] * s) / m, s)
    history = gram // SYMBOLS
    p, weights = [], []
    for c in (c0, c1):
        ones, twos = (c == 1).sum(), (c == 2).sum()
        discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
        size = np.bincount(history, weights=c, minlength=SYMBOLS ** (ORDER - 1))
        types = np.bincount(history, weights=c > 0, minlength=SYMBOLS ** (ORDER - 1))
        w = np.where(size > 0, discount * types / np.maximum(size, 1), 1.0)
        weights.append(w)
        p.append(np.where(size[history] > 0, np.maximum(c - discount, 0) / np.maximum(size[history], 1), 0) + w[history] * s)
    return np.log(p[1] / p[0]).astype(np.float32), np.log(weights[1] / weights[0]).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """Grams seen and their ratios, the histories' ratios, and the calibration. At most SYMBOLS ** ORDER grams."""

    gram: np.ndarray
    ratio: np.ndarray
    history: np.ndarray
    mean: np.ndarray = None
    scale: np.ndarray = None
    weights: np.ndarray = None

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(place, ratio): the ratio of gram g is ratio[place[g // SYMBOLS] + g % SYMBOLS].

        Only histories that were seen have a row of their own; the others share the first, of zeros. Ratios are rounded to
        multiples of 2**-16, so sums over words are exact and don't depend on the texts before.
        """
        seen = np.unique(self.gram // SYMBOLS)
        place = np.zeros(len(self.history), np.int32)
        place[seen] = np.arange(1, len(seen) + 1) * SYMBOLS
        ratio = np.repeat(np.r_[np.float32(0), self.history[seen]], SYMBOLS)
        ratio[place[self.gram // SYMBOLS] + self.gram % SYMBOLS] = self.ratio
        return place, np.round(ratio * 65536) / 65536

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(features)), (features - self.mean) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(texts: list[str], table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each text, length-normalised log-likelihood ratios a word, toxic over ordinary, and the log of its number of words.

    The ratios: of all its words; of a mixture in which SHARE of the words are toxic; of its BEST likeliest words. Zeros for a
    text of no letters.
    """
    out = np.zeros((len(texts), len(FEATURES)))
    place, ratio = table
    for i, some in chunks(texts):
        g = grams_of(some)
        if not len(g.start):
            continue
        known = np.maximum(g.code, 0)
        sums = np.r_[0.0, np.cumsum(np.where(g.code >= 0, ratio[place[known >> 5] + (known & 31)], 0), dtype=np.float64)]
        word = sums[g.stop] - sums[g.start]
        n = np.bincount(g.word_doc, minlength=len(some))
        has = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[has]
        n = n[has]
        order = np.lexsort((-word, g.word_doc))
        rank = np.arange(len(word)) - np.repeat(first, n)
        made = [word, np.logaddexp(np.log(1 - SHARE), np.log(SHARE) + word), np.where(rank < BEST, word[order], 0)]
        for c, (x, size) in enumerate(zip(made, (n, n, np.minimum(n, BEST)), strict=True)):
            out[i + has, c] = np.add.reduceat(x, first) / size
        out[i + has, 3] = np.log1p(n)
    return out


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row, score): every row of docs as a struct, whatever its columns are called, and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value.table()
        for b in batches:
            texts = [t or "" for t in b.column(0).field(at).to_pylist()]
            score = held.value.score(features(texts, table)) if texts else np.empty(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["row", "score"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def fit(docs: DataFrame, labels: DataFrame, calibrate_rows: int = 20_000) -> Model:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); rows without text or label are left out.

    The logistic calibration is fitted on at most calibrate_rows labelled rows: of a quarter, by a hash of the id, those of
    the smallest hashes. All other labelled rows are counted. What goes to the driver and to every task is bounded by the
    alphabet, SYMBOLS ** ORDER grams of 8 bytes at most, however many rows are counted. Several labels of one id: toxic if any
    says so. Rows of one id are each counted. Without rows of both classes every score is 0.
    """
    labels = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("h", F.xxhash64("doc_id"))
    quarter = labels.filter("pmod(h, 4) = 0")
    last = quarter.orderBy("h").limit(calibrate_rows).agg(F.max("h")).first()[0]
    chosen = (F.pmod("h", F.lit(4)) == 0) & (F.col("h") <= F.lit(last if last is not None else -(2**63)))
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL")
    # Labels grow with the corpus, so both sides are shuffled at every size.
    rows = texts.join(labels.filter(~chosen).select("doc_id", "toxic").hint("merge"), "doc_id")
    counts = gram_counts(rows.select("text", "toxic")).toArrow()
    gram = counts["gram"].to_numpy().astype(np.int64)
    ratio, history = ratios(gram, counts["c0"].to_numpy(), counts["c1"].to_numpy())
    model = Model(gram, ratio, history)
    held = texts.join(F.broadcast(labels.filter(chosen).select("doc_id", "toxic")), "doc_id").select("toxic", "text")
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for b in batches:
            table = given.value.table() if table is None else table
            f = features(b.column(1).to_pylist(), table)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(len(FEATURES)))], ["toxic", *FEATURES])

    kind = dict(labels.dtypes)["toxic"]
    found = held.mapInArrow(run, ", ".join([f"toxic {kind}", *(f"{c} double" for c in FEATURES)])).collect()
    y = np.array([r[0] > 0 for r in found], float)
    x = np.array([r[1:] for r in found], float).reshape(-1, len(FEATURES))
    if not 0 < y.sum() < len(y):
        return Model(gram, ratio, history, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.array([-40.0] + [0.0] * len(FEATURES)))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        ridge = np.r_[0.0, np.ones(len(FEATURES))] * 1e-2
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge + 1e-9), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(gram, ratio, history, mean, scale, w)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """docs with score in 0 to 1 and predicted (1 if score >= threshold); own columns of these names are replaced.

    Only the text is used. NULL, empty and letterless texts get the score of a document of no words. Whole texts
    are scored, of any length; equal texts get equal scores; repeated rows stay; an empty table gives no rows.
    """
    rows = scored(docs, model, text)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    return rows.select(*(F.col("row")[c].alias(c) for c in own), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with their own columns."""
    return scored(docs, model, text).filter(F.col("score") < threshold).select(*(F.col("row")[c].alias(c) for c in docs.columns))
