"""Registered queries opN_<name> over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import length_histogram, line_dedup, mixing, packing, prefix_trie, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity, vectors, whitening
from llm.common import WORD, load


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs))


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op4_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.length_histogram(length_histogram.encoded_lengths(load(spark, sf_dir, "documents")))


def op3_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(load(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("f")[0]).alias("fingerprint"), "component_id")


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: the remainder of crc32(doc_id) by 3 is not 1."""
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, training_labels(load(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return toxicity.toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(load(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op10_interval_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents"))


def op11_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(load(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pfair_mixing, op2_line_chunks, op3_stable_projections, op4_de_bruijn, op5_best_fit, op6_token_counts, op7_simhash, op8_kneser_ney, op9_block_pruning, op10_interval_expansion, op11_divergence_rules, op12_prefix_trie, op13_whitening)
}

OP2_SQL = f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
m AS (SELECT doc_id, lines, list_transform(range(2, len(lines) + 1),
        lambda i: ('0x' || substr(md5(lines[i - 1] || chr(10) || lines[i]), 1, 8))::BIGINT % {line_dedup.MARKED} = 0) AS ms FROM l),
s AS (SELECT doc_id, lines, list_filter(range(1, len(lines) + 1),
        lambda i: i = 1 OR (i > 2 AND i < len(lines) AND ms[i - 1] AND NOT ms[i - 2])) AS st FROM m),
c AS (SELECT doc_id, unnest(list_transform(range(1, len(st) + 1), lambda k: {{'no': k,
        'n': coalesce(st[k + 1], len(lines) + 1) - st[k],
        'chunk': array_to_string(lines[st[k] : coalesce(st[k + 1], len(lines) + 1) - 1], chr(10))}})) AS p FROM s),
f AS (SELECT doc_id, p.no AS no, p.chunk AS chunk,
        p.n >= 2 AND row_number() OVER (PARTITION BY p.n >= 2, p.chunk ORDER BY doc_id, p.no) > 1 AS gone FROM c)
SELECT d.doc_id, count(f.no) AS n_chunks, count_if(coalesce(f.gone, FALSE)) AS n_removed,
  CASE WHEN any_value(d.text) IS NOT NULL THEN sha256(coalesce(string_agg(CASE WHEN NOT f.gone THEN f.chunk END, chr(10) ORDER BY f.no), '')) END AS kept_sha256
FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {substring_dedup.SIZE} + 2)) AS s FROM t),
k AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(w[s : s + {substring_dedup.SIZE} - 1], ' ') ORDER BY doc_id, s) AS nth FROM p),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + {substring_dedup.SIZE})) AS i FROM k WHERE nth > 1),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' '), '')) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)
"""

OP10_SQL = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS b FROM documents),
c AS (SELECT doc_id, k, substr(b, 512 * k + 1, 2 * (255 + {suffix_dedup.SIZE})) AS c FROM (SELECT doc_id, b, unnest(range(len(b) // 512 + 1)) AS k FROM t)),
p AS (SELECT doc_id, k, c, unnest(range(1, least(256, len(c) // 2 - {suffix_dedup.SIZE} + 1) + 1)) AS i FROM c),
k AS (SELECT doc_id, 256 * k + i AS s, row_number() OVER (PARTITION BY md5(substr(c, 2 * i - 1, {2 * suffix_dedup.SIZE})) ORDER BY doc_id, 256 * k + i) AS nth FROM p),
r AS (SELECT doc_id, s AS i, s + {suffix_dedup.SIZE} AS j FROM k WHERE nth > 1),
o AS (SELECT doc_id, i, j, sum(CASE WHEN i > prev OR prev IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT *, lag(j) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM r)),
m AS (SELECT doc_id, g, min(i) AS i, max(j) AS j FROM o GROUP BY doc_id, g),
q AS (SELECT doc_id, i, j, coalesce(lag(j) OVER w, 1) AS free, lead(i) OVER w IS NULL AS final FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, count(*) AS n, sum(j - i) AS gone, list({{'f': free, 'i': i}} ORDER BY i) AS keep, max(j) AS tail FROM q GROUP BY doc_id)
SELECT t.doc_id, len(b) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN b ELSE array_to_string(list_transform(keep, lambda x: substr(b, 2 * x.f - 1, 2 * (x.i - x.f))), '') || substr(b, 2 * tail - 1) END)) AS kept_sha256
FROM t LEFT JOIN a USING (doc_id)
"""

def _js_square(p: str, q: str) -> str:
    """Squared Jensen-Shannon distance of two lists of counts."""
    a, b = f"({p})[i] / list_sum({p})", f"({q})[i] / list_sum({q})"
    side = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({a} + {b}) / 2)) ELSE 0 END)"
    return f"(CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {side(a)} + {side(b)})) / 2, 0) ELSE 0 END)"


def _op11_sql() -> str:
    q = quality_rules
    space = r"[\x20\x09-\x0D]"
    classes = ", ".join(f"(len(t) - len(regexp_replace(t, '{c}', '', 'g')))::DOUBLE" for c in q.CLASSES)
    k, m = len(q.CLASSES), q.COMMON

    def judged(name: str, source: str, passing: str, before: str) -> str:
        """Tables of the references over the passing rows of source and of the rows judged by them."""
        sums = lambda c, n: f"[{', '.join(f'sum({c}[{i}])' for i in range(1, n + 1))}]"
        bias = lambda c, n: f"{n - 1} / (8 * ln(2.0::DOUBLE) * greatest(list_sum({c}), 1))"
        return f"""
ref{name} AS (SELECT grp, {sums("ch", k + 1)} AS cr, {sums("wh", m + 1)} AS wr FROM {source} WHERE {passing} GROUP BY grp),
j{name} AS MATERIALIZED (SELECT s.* EXCLUDE (oc, ow, good), coalesce(r.cr, s.oc) AS oc, coalesce(r.wr, s.ow) AS ow FROM {source} s LEFT JOIN ref{name} r ON s.grp IS NOT DISTINCT FROM r.grp),
g{name} AS MATERIALIZED (SELECT *, NOT base_failed AND NOT ({_js_square("ch", "oc")} - {bias("ch", k + 1)} > {q.CLASS_LIMIT} AND list_sum(ch) >= {q.LEAST_CHARS})
  AND NOT ({_js_square("wh", "ow")} - {bias("wh", m + 1)} > {q.WORD_LIMIT} AND n_words >= {q.LEAST_WORDS}) AS good FROM j{name})"""

    zero = lambda n: f"list_transform(range({n}), lambda i: 0::DOUBLE)"
    return f"""
WITH big AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= (SELECT count(*) FROM documents) * {q.LEAST_SHARE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, big.lang AS grp, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w
  FROM documents LEFT JOIN big USING (lang)),
f AS (SELECT grp, x, count(*) AS n FROM (SELECT grp, unnest(w) AS x FROM d) WHERE len(x) <= {q.WORD_CHARS} GROUP BY grp, x HAVING count(*) > 1),
o AS (SELECT grp, list(x ORDER BY n DESC, x) AS common FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, x) AS r FROM f) WHERE r <= {m} GROUP BY grp),
p AS (SELECT id, unnest(list_transform(range(1, len(w) - {q.WINDOW - 2}), lambda i: {{'s': i, 'x': array_to_string(w[i : i + {q.WINDOW - 1}], ' ')}})) AS p FROM d),
h AS (SELECT id, p.s AS s, count(*) OVER (PARTITION BY id, p.x) AS c FROM p),
rep AS (SELECT id, count(*) AS n_repeat FROM (SELECT DISTINCT id, unnest(range(s, s + {q.WINDOW})) AS i FROM h WHERE c > 1) GROUP BY id),
ln AS (SELECT id, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^{space[1:]}') GROUP BY id),
wc AS (SELECT id, list_position(common, x) AS i, count(*)::DOUBLE AS c FROM (SELECT id, grp, unnest(w) AS x FROM d) u JOIN o ON u.grp IS NOT DISTINCT FROM o.grp WHERE list_contains(common, x) GROUP BY 1, 2),
wm AS (SELECT id, map(list(i), list(c)) AS by_word, sum(c) AS c FROM wc GROUP BY id),
a AS (SELECT d.id, d.doc_id, d.grp, len(w)::BIGINT AS n_words, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_dup, 0)::BIGINT AS n_dup_lines, len(t) AS n_chars,
  [{classes}] AS c0, list_concat(list_transform(range(1, {m + 1}), lambda i: coalesce(by_word[i], 0)::DOUBLE), [len(w) - coalesce(wm.c, 0)]) AS wh
  FROM d LEFT JOIN rep USING (id) LEFT JOIN ln USING (id) LEFT JOIN wm USING (id)),
m AS MATERIALIZED (SELECT *, list_concat(c0, [n_chars - list_sum(c0)]) AS ch, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, FALSE AS good,
  {zero(k + 1)} AS oc, {zero(m + 1)} AS ow FROM a),{judged("1", "m", "NOT base_failed", "")},{judged("2", "g1", "good", "")}
SELECT doc_id, n_words, (list_sum(ch) - ch[4])::BIGINT AS word_chars, ch[5]::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed, good AS kept FROM g2
"""


OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(text, ''), coalesce(role, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT c, turns, c::VARCHAR AS s FROM t),
z AS (SELECT c, turns, (4294967295 - list_reduce(list_concat([4294967295::BIGINT], range(8 * len(s))), lambda x, i:
  CASE WHEN i % 8 = 0 THEN
    CASE WHEN (xor(x, ascii(substr(s, (i // 8 + 1)::INTEGER, 1))) & 1) = 1 THEN xor(xor(x, ascii(substr(s, (i // 8 + 1)::INTEGER, 1))) >> 1, 3988292384) ELSE xor(x, ascii(substr(s, (i // 8 + 1)::INTEGER, 1))) >> 1 END
  ELSE CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END END)) % 4 AS h FROM k),
b AS (SELECT z.c, list_concat(coalesce(o.turns[1 : z.h], []), z.turns[z.h + 1 :]) AS turns FROM z LEFT JOIN t o ON o.c = z.c - z.c % 20),
v AS (SELECT c, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS d FROM b),
p AS (SELECT c, n, d, CASE WHEN d = 0 THEN [] ELSE turns[1 : d] END AS prefix, CASE WHEN d < 2 THEN [] ELSE turns[1 : d - 1] END AS above, CASE WHEN d = 0 THEN '' ELSE turns[d].t END AS last FROM v),
g AS (SELECT d, prefix, any_value(above) AS above, min(c) AS c, count(*) AS n_convs, max(n) AS deepest, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d) AS ends,
  (count(*) - 1) * len(regexp_extract_all(any_value(last), '{WORD}')) AS saved FROM p GROUP BY d, prefix),
u AS (SELECT d AS e, prefix, CASE WHEN d = deepest THEN 1 ELSE 0 END AS leaf, saved, unnest(range(0, d + 1)) AS d FROM g),
s AS (SELECT d, CASE WHEN d = 0 THEN [] ELSE prefix[1 : d] END AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM u GROUP BY 1, 2),
w AS (SELECT d - 1 AS d, above AS prefix, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2)
SELECT g.c AS conv_id, g.d AS depth, q.c AS parent_conv_id, g.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(g.ends, '')) AS ends_sha256
FROM g JOIN s ON g.d = s.d AND g.prefix = s.prefix LEFT JOIN w ON g.d = w.d AND g.prefix = w.prefix LEFT JOIN g q ON q.d = g.d - 1 AND q.prefix = g.above
"""

ORACLE_SQL: dict[str, str] = {"op10_interval_expansion": OP10_SQL, "op4_de_bruijn": OP4_SQL, "op2_line_chunks": OP2_SQL, "op9_block_pruning": OP9_SQL, "op11_divergence_rules": _op11_sql(), "op12_prefix_trie": OP12_SQL}
