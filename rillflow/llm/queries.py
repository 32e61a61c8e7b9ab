"""One query for each operator of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import bpe, embedding_dedup, html_extract, langid, line_dedup, mixing, ngram_join, passages, quality, sharding

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark, sf_dir):
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_mixing(spark, sf_dir):
    plan = mixing.mixing_plan(_table(spark, sf_dir, "documents"))
    taken = plan.select("doc_id", "size", "source_size", "target", (F.size("positions") * F.col("size")).alias("taken"), _millionth(F.try_element_at("positions", F.lit(1))).alias("first_position"), _millionth(F.try_element_at("positions", F.lit(-1))).alias("last_position"))
    return taken.orderBy("first_position", "doc_id")


def _millionth(position):
    """A training time in [0, 1] as whole millionths, for an exact comparison."""
    return F.floor(position * 1_000_000).cast("long")


def op4_line_dedup(spark, sf_dir):
    done = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_passages(spark, sf_dir):
    done = passages.remove_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_langid(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_quality(spark, sf_dir):
    done = quality.verdicts(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_sharding(spark, sf_dir):
    return sharding.shard_plan(_table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(public_tokenizers.path(VOCABULARY)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_html, op2_ngram_join, op3_mixing, op4_line_dedup, op5_passages, op6_langid, op7_quality, op8_sharding, op9_embeddings, op10_bpe]
    return {f.__name__: f for f in found}


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_MIX = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\v\\f\\r]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight,
         CAST([-0.4, 0.2, 0.6][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS ramp
  FROM d GROUP BY source),
a AS (SELECT *, 3 * source_size AS lim, 3 * source_size / weight AS ratio FROM s),
b AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(lim) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM a WINDOW w AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, first_value(CASE WHEN level < ratio THEN level END IGNORE NULLS) OVER (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS shared FROM b),
t AS (SELECT source, source_size, ramp, CASE WHEN shared IS NULL OR ratio <= shared THEN CAST(lim AS DOUBLE) ELSE CAST(shared * weight AS DOUBLE) END AS target FROM c),
p AS (
  SELECT d.*, t.source_size, t.target, t.ramp,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, list_transform(list_filter([0, 1, 2], lambda e: 2 * (e * source_size + start) + size < 2 * target),
    lambda e: (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * ((e * source_size + start) / target)) - 1 + ramp) / (2 * ramp)) AS positions
  FROM p)
SELECT doc_id, size, source_size, target, CAST(size * len(positions) AS BIGINT) AS taken,
       CAST(floor(positions[1] * 1000000) AS BIGINT) AS first_position, CAST(floor(positions[-1] * 1000000) AS BIGINT) AS last_position
FROM q"""
_LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_SPACES}) AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, coalesce(k.doc_id < r.last, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

#: All pairs of distinct shingle sets that share a shingle, and all classes reachable from each.
_JOIN = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM w),
c AS (SELECT s, min(doc_id) AS c, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT c, n, unnest(s) AS g FROM c),
e AS (
  SELECT a.c AS u, b.c AS v FROM x a JOIN x b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
f AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r(c, reached) AS (SELECT c, c FROM c UNION SELECT r.c, f.v FROM r JOIN f ON r.reached = f.u),
m AS (SELECT c, min(reached) AS component_id FROM r GROUP BY c)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON c.c = m.c"""
#: Every string of 400 bytes; what is kept is put together as hexadecimal digits.
_PASSAGES = """
WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, md5(array_slice(h, i + 1, i + 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM h)),
t AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER w + 400, true) AS opens FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
q AS (SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
spans AS (SELECT doc_id, min(i) AS lo, max(i) + 400 AS hi FROM q GROUP BY doc_id, run),
cut AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM spans),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, max(hi) AS last, string_agg(hex(array_slice(h, before + 1, lo)), '' ORDER BY lo) AS kept
  FROM cut JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || hex(array_slice(h, coalesce(last, 0) + 1, n)))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)"""
#: All pairs of a label.
_VECTORS = """
WITH RECURSIVE d AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM d a JOIN d b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(vec_id, reached) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.v FROM r JOIN e ON r.reached = e.u),
m AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
l AS (SELECT u AS vec_id, count(*) AS n FROM e GROUP BY u)
SELECT m.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN l USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """Duplicate ids apart, the SQL of the operators that need no model, hash function or tokenizer of their own."""
    return {"op2_ngram_join": _JOIN, "op3_mixing": _MIX, "op4_line_dedup": _LINES, "op5_passages": _PASSAGES, "op9_embeddings": _VECTORS}
