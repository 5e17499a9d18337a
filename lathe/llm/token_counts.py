"""Exact length histogram: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe

#: Lengths a block: suffix sums run within blocks, and over one row a block.
BLOCK = 512


def length_histogram(spark: SparkSession, docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; one row a distinct length, whatever the corpus.

    Null and empty texts count as length 0, repeated rows each count, and ids and other columns are not looked at.
    An empty table has an empty histogram.
    """
    return bpe.encode_documents(spark, docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), path=path, ids=False, decoded=False).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L of the histogram: documents and tokens of at least L, and what stays if texts are cut to L.

    n_tokens, n_docs, docs_before (shorter), docs_from, tokens_from (at least as long), total_tokens, total_docs,
    truncated_total (sum of min(length, L)). The sums run in two steps, within blocks of lengths and over blocks,
    so no window holds the whole histogram.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("t").alias("b_tokens"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("b_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(all_).alias("total_docs"),
        F.sum("b_tokens").over(all_).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs_from = F.sum("n_docs").over(own)
    tokens_from = F.sum("t").over(own)
    h = h.withColumn("d", docs_from).withColumn("s", tokens_from).join(blocks, "block")
    h = h.withColumn("docs_from", F.col("d") + F.col("later_docs")).withColumn("tokens_from", F.col("s") + F.col("later_tokens"))
    return h.select(
        "n_tokens",
        "n_docs",
        (F.col("total_docs") - F.col("docs_from")).alias("docs_before"),
        "docs_from",
        "tokens_from",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(context_limit, truncated_total, docs_over) for any limits: tokens that remain if every text is cut there.

    The answer comes from the first length above the limit. An empty histogram gives no rows.
    """
    per = []
    for x in limits:
        longer = F.col("n_tokens") > int(x)
        docs = F.coalesce(F.max(F.when(longer, F.col("docs_from"))), F.lit(0))
        tokens = F.coalesce(F.max(F.when(longer, F.col("tokens_from"))), F.lit(0))
        per.append(F.struct(F.lit(int(x)).cast("long").alias("context_limit"), (F.max("total_tokens") - tokens + docs * int(x)).alias("truncated_total"), docs.alias("docs_over")))
    return sums.agg(F.array(*per).alias("a"), F.count("*").alias("n")).where("n > 0").select(F.inline("a"))


def quantiles(sums: DataFrame, points: Sequence[float]) -> DataFrame:
    """(q, n_tokens): the smallest length that at least a share q of the documents does not exceed."""
    reach = (F.col("docs_before") + F.col("n_docs")).cast("double")
    per = [F.struct(F.lit(float(q)).alias("q"), F.min(F.when(reach >= F.lit(float(q)) * F.col("total_docs"), F.col("n_tokens"))).alias("n_tokens")) for q in points]
    return sums.agg(F.array(*per).alias("a"), F.count("*").alias("n")).where("n > 0").select(F.inline("a"))
