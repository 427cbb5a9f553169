"""Quality rules by divergence from language references, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from llm.common import cut, words

#: Character classes; what is in none of them is a last class of its own.
CLASSES = ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[#*$%&|<>]", r"[\x21-\x22\x27-\x29\x2B-\x2F\x3A-\x3B\x3D\x3F-\x40\x5B-\x60\x7B\x7D-\x7E]", r"[\x{80}-\x{24F}]")
#: Frequent classes are taken away first.
ORDER = (0, 3, 1, 2, 4, 5, 6)
#: Common words of a reference, and characters of one at most.
COMMON, WORD_CHARS = 32, 32
#: A language has a reference of its own if it holds this share of the documents; all others share one.
LEAST_SHARE = 1 / 256
#: Guards: characters and words below which a histogram decides nothing.
LEAST_CHARS, LEAST_WORDS = 100, 50
#: Squared distances, less their expectation for a text of that length, above which a text is rejected.
CLASS_LIMIT, WORD_LIMIT = 0.03, 0.05
#: Words of a window that counts as repeated.
WINDOW = 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def class_counts(text: Column) -> Column:
    """Characters of each class of CLASSES and of none. What a class takes away is not searched for the next one."""

    def gone(kept: Column, left: Sequence[int], counts: list[Column]) -> Column:
        """counts, by class, of a text whose remaining classes are `left`."""
        if not left:
            by = dict(zip(ORDER, counts, strict=True))
            return F.array(*(by[i] for i in range(len(CLASSES))), F.char_length(kept))
        rest = F.regexp_replace(kept, f"{CLASSES[left[0]]}+", "")
        return let(rest, lambda r: gone(r, left[1:], [*counts, F.char_length(kept) - F.char_length(r)]))

    return gone(text, ORDER, [])


def _covered(grams: Column) -> Column:
    """Words covered by windows that occur twice, from the windows' words in order."""

    def of(s: Column) -> Column:
        again = F.filter(s, lambda x, k: (x["g"] == F.get(s, k - 1)["g"]) | (x["g"] == F.get(s, k + 1)["g"]))
        # An index of -1 or beyond the end gives NULL, which filter takes as false unless the other side holds.
        return let(F.sort_array(F.transform(again, lambda x: x["at"])), lambda p: F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")), lambda a, i: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).cast("int").alias("n"), (i + WINDOW).cast("int").alias("end")), lambda a: a["n"]))

    return let(F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at")))), of)


def repeat_words(w: Column) -> Column:
    """Words of w in windows of WINDOW words that occur twice or more in w, the first occurrence included.

    Hashes of windows settle texts without such a window; all others compare the words themselves.
    """
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    exact = _covered(F.transform(starts, lambda i: F.array_join(F.slice(w, i, WINDOW), " ")))
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))), F.lit(1), F.size(h) - (WINDOW - 1)))
    several = let(hashes, lambda g: F.size(g) > F.size(F.array_distinct(g)))
    return F.when(F.size(w) < WINDOW, 0).when(several, exact).otherwise(0)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def js_square(p: Column, q: Column) -> Column:
    """Squared Jensen-Shannon distance (base 2) of two histograms of counts; 0 if either is empty."""

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def distance(sums: Column) -> Column:
        both = F.zip_with(p, q, lambda x, y: F.struct((x / sums[0]).alias("x"), (y / sums[1]).alias("y")))
        each = F.transform(both, lambda z: part(z["x"], (z["x"] + z["y"]) / 2) + part(z["y"], (z["x"] + z["y"]) / 2))
        return F.when((sums[0] > 0) & (sums[1] > 0), F.greatest(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0))).otherwise(0.0)

    return let(F.array(total(p), total(q)), distance)


def _excess(counts: Column, reference: Column, bins: int) -> Column:
    """js_square less what a sample of that many units of the reference has on average, (bins - 1) / (8 n ln 2)."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return js_square(counts, reference) - (bins - 1) / (8 * F.log(F.lit(2.0)) * F.greatest(n, F.lit(1)))


def _summed(column: str, bins: int) -> list[Column]:
    return [F.sum(F.get(column, F.lit(k))).alias(f"{column}_{k}") for k in range(bins)]


def common_words(docs: DataFrame) -> DataFrame:
    """(of, common) for each language group of docs (of, text): its COMMON most frequent words, over all its texts.

    A common word occurs twice at least and has at most WORD_CHARS characters; ties go to the smaller word. Counts combine map-side,
    and only each task's first COMMON words of a group meet.
    """
    every = docs.select("of", F.explode(words(F.col("text"))).alias("w"))
    counts = every.filter(F.char_length("w") <= WORD_CHARS).groupBy("of", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rank = F.row_number().over(W.partitionBy("of").orderBy(F.desc("n"), "w"))
    top = counts.withColumn("rank", rank).filter(F.col("rank") <= COMMON)
    return top.groupBy("of").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "w"))), lambda x: x["w"]).alias("common"))


def measured(docs: DataFrame, common: DataFrame) -> DataFrame:
    """docs (of, text, …) with the rules' counts and both histograms in place of the text."""
    t = F.coalesce("text", F.lit(""))
    common = common.select(F.col("of").alias("group"), "common", F.array_max(F.transform("common", F.octet_length)).alias("longest"))
    rows = docs.join(F.broadcast(common), F.col("of").eqNullSafe(F.col("group")), "left").drop("group")

    def of_words(w: Column) -> Column:
        at = F.transform(F.filter(w, lambda x: (F.octet_length(x) <= F.col("longest")) & F.array_contains("common", x)), lambda x: F.array_position("common", x))
        hist = let(at, lambda a: F.concat(F.transform(F.sequence(F.lit(1), F.lit(COMMON)), lambda k: (F.size(a) - F.size(F.array_remove(a, k.cast("long")))).cast("long")), F.array((F.size(w) - F.size(a)).cast("long"))))
        return F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), F.coalesce(hist, F.array(*[F.lit(0).cast("long")] * COMMON, F.size(w).cast("long"))).alias("word_hist"))

    counted = rows.select(
        *(F.col(f"`{c}`") for c in docs.columns if c != "text"),
        let(words(F.col("text")), of_words).alias("m"),
        F.transform(class_counts(t), lambda x: x.cast("long")).alias("class_hist"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"),
    )
    return counted


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """Each row's id and columns of `carry`, with the rules' counts, both excess distances and verdicts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; base_failed: fewer than 10 words, or over a fifth of the words
    in repeated windows. class_excess and word_excess are squared Jensen-Shannon distances of the document's histograms of character
    classes and of its language's COMMON most frequent words (and all others) from those of the language, less the distance that the
    text's length alone explains. A text is kept unless base_failed, or class_excess is above CLASS_LIMIT with LEAST_CHARS
    characters or more, or word_excess above WORD_LIMIT with LEAST_WORDS words or more.

    A reference sums all documents of a language that pass, first by the histograms of all its documents, then again by
    those of the documents that passed; if none passes, the first ones stay. Languages below LEAST_SHARE of the rows, NULL
    among them, share one reference. A text is split into words once, in its own row: memory follows the longest text. NULL
    and empty texts have zeros and base_failed. Repeated rows are judged alike and all count. Other columns are not read and may have any
    name. An empty table gives no rows.
    """
    kept = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate([id_col, *carry])]
    rows = docs.select(*kept, F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    large = share.crossJoin(F.broadcast(share.agg(F.sum("n").alias("total")))).filter(F.col("lang").isNotNull() & (F.col("n") >= F.col("total") * LEAST_SHARE))
    large = cut(large.select("lang", F.col("lang").alias("of")))  # at most 1 / LEAST_SHARE rows
    rows = rows.join(F.broadcast(large), "lang", "left").drop("lang")
    common = cut(common_words(rows.select("of", "text")))  # one row for each of those, and one for the rest
    m = cut(measured(rows, common))

    shape = {"class_hist": len(CLASSES) + 1, "word_hist": COMMON + 1}
    m = m.select("*", "m.n_words", "m.n_repeat_words", "m.word_hist").drop("m")
    m = m.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))

    def judged(passing: Column, before: DataFrame | None) -> DataFrame:
        source = m if before is None else before
        sums = source.filter(passing).groupBy("of").agg(*(s for c, n in shape.items() for s in _summed(c, n)))
        refs = sums.select(F.col("of").alias("group"), *(F.array(*(f"{c}_{k}" for k in range(n))).alias(f"{c}_ref") for c, n in shape.items()))
        if before is not None:
            source = source.withColumnsRenamed({f"{c}_ref": f"{c}_old" for c in shape}).drop("class_excess", "word_excess", "good")
        out = source.join(F.broadcast(refs), F.col("of").eqNullSafe(F.col("group")), "left").drop("group")
        if before is not None:
            out = out.withColumns({f"{c}_ref": F.coalesce(f"{c}_ref", f"{c}_old") for c in shape}).drop(*(f"{c}_old" for c in shape))
        zero = {c: F.array(*[F.lit(0).cast("long")] * n) for c, n in shape.items()}
        out = out.select("*", *(_excess(F.col(c), F.coalesce(F.col(f"{c}_ref"), zero[c]), n).alias(f"{c.split('_')[0]}_excess") for c, n in shape.items()))
        n_chars = F.aggregate("class_hist", F.lit(0).cast("long"), lambda s, x: s + x)
        bad = ((F.col("class_excess") > CLASS_LIMIT) & (n_chars >= LEAST_CHARS)) | ((F.col("word_excess") > WORD_LIMIT) & (F.col("n_words") >= LEAST_WORDS))
        return out.withColumn("good", ~F.col("base_failed") & ~bad)

    out = judged(F.col("good"), judged(~F.col("base_failed"), None))
    n_chars = F.aggregate("class_hist", F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        *(F.col(f"__{i}").alias(c) for i, c in enumerate([id_col, *carry])),
        "n_words",
        (n_chars - F.get("class_hist", F.lit(3))).alias("word_chars"),
        F.get("class_hist", F.lit(4)).alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "class_excess",
        "word_excess",
        "base_failed",
        F.col("good").alias("kept"),
    )
