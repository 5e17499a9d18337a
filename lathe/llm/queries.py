"""The queries of the training-data operators; SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embedding_dedup, licenses, line_dedup, mixing, ngram_join, pii, token_counts, toxicity
from ._common import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM l),
p AS (
  SELECT a.doc_id AS d1, b.doc_id AS d2, a.i AS i1, b.i AS i2, a.words,
         a.i - row_number() OVER (PARTITION BY a.doc_id, b.doc_id, b.i - a.i ORDER BY a.i) AS run
  FROM w a JOIN w b ON a.line = b.line AND (a.doc_id, a.i) < (b.doc_id, b.i)),
r AS (SELECT d2, min(i2) AS first, max(i2) AS last FROM p GROUP BY d1, d2, i2 - i1, run HAVING sum(words) >= 50),
x AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN r ON w.doc_id = r.d2 AND w.i BETWEEN r.first AND r.last),
k AS (SELECT w.doc_id, count(*) AS n_lines, count(x.i) AS n_removed, coalesce(string_agg(CASE WHEN x.i IS NULL THEN w.line END, chr(10) ORDER BY w.i), '') AS kept
      FROM w LEFT JOIN x ON w.doc_id = x.doc_id AND w.i = x.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(k.kept) END AS text_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(spark, table(spark, sf_dir, "documents"), Scratch(spark, "pii"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_secret", "n_account", "n_spans")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"), Scratch(spark, "join"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(spark, table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(CAST('0x' || left(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM documents),
p AS (
  SELECT source, sum(size) AS s, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(s) OVER () AS total,
         coalesce(sum(s) OVER (ORDER BY s * 10 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s_before,
         sum(w) OVER (ORDER BY s * 10 // w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM p),
c AS (SELECT *, s * 200 * w_rest <= w * (total * 150 - s_before * 200) AS capped FROM o),
t AS (
  SELECT source, s, CASE WHEN capped THEN CAST(s * 2 AS DOUBLE)
         ELSE CAST(total * 150 - coalesce(sum(CASE WHEN capped THEN s END) OVER (), 0) * 200 AS DOUBLE) / 100.0 * CAST(w AS DOUBLE)
              / CAST(sum(CASE WHEN NOT capped THEN w END) OVER () AS DOUBLE) END AS target
  FROM c),
r AS (SELECT *, CASE WHEN s > 0 THEN target / CAST(s AS DOUBLE) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = Scratch(spark, "lengths").put(token_counts.length_histogram(spark, table(spark, sf_dir, "documents")))
    return token_counts.suffix_sums(sums)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(spark, docs, labels, Scratch(spark, "toxic"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return toxicity.score_documents(spark, docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, Scratch(spark, "nearest"))


def queries() -> dict[str, Query]:
    own = (op1_line_dedup, op2_embedding_dedup, op3_personal_data, op4_ngram_join, op5_licenses, op6_bpe, op7_mix_sources, op8_token_counts, op9_toxicity, op10_nearest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op5_licenses": licenses.oracle(), "op7_mix_sources": OP7_SQL}
