"""Mixing sources to target weights: token sums per source, repetition rates, floor copies and one seeded draw."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, column, unused, word_count


def source_rates(sizes: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, source_size, target, rate): shares by weight of `percent` of all sizes, none above `most` times its source.

    Sources are ordered by code point, null last, and take the weights in turn. Caps are filled lowest first:
    in order of size over weight, a source is capped if its share of what is left reaches the cap. The windows
    run over one row a source, already summed, never over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    scale = 1
    for w in weights:
        scale *= w
    wide = "decimal(38,0)"
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", pick.cast(wide)).withColumn("s", F.col("source_size").cast(wide))
    order = Window.orderBy((F.col("s") * scale / F.col("w")).cast(wide), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("s").over(everything))
        .withColumn("s_before", F.coalesce(F.sum("s").over(before), F.lit(0)).cast(wide))
        .withColumn("w_rest", F.sum("w").over(after))
        .withColumn("capped", F.col("s") * most * 100 * F.col("w_rest") <= F.col("w") * (F.col("total") * percent - F.col("s_before") * most * 100))
    )
    rest = Window.partitionBy()
    per = per.withColumn("s_capped", F.coalesce(F.sum(F.when(F.col("capped"), F.col("s"))).over(rest), F.lit(0)).cast(wide)).withColumn("w_open", F.sum(F.when(~F.col("capped"), F.col("w"))).over(rest))
    left = (F.col("total") * percent - F.col("s_capped") * most * 100).cast("double") / 100.0
    share = left * F.col("w").cast("double") / F.col("w_open").cast("double")
    target = F.when(F.col("capped"), (F.col("s") * most).cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) fixed by seed, id and text: reruns and lost executors draw the same."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def plan_mix(docs: DataFrame, scratch: Scratch, *, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies.

    Null texts and ids are allowed (size 0; the id counts as empty in the draw), as are null sources (one more
    source, last). Equal rows draw alike. An empty table gives no rows. Other columns are not looked at.
    """
    sizes = scratch.put(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("u")))
    rates = scratch.put(source_rates(sizes, weights, percent, most))
    whole = F.floor("rate")
    extra = (F.col("u") < F.col("rate") - whole).cast("long")
    r = rates.select(F.col("source").alias("r_source"), "source_size", "target", "rate")
    return sizes.join(r, F.col("source").eqNullSafe(F.col("r_source"))).select("doc_id", "source", "size", "source_size", "target", "rate", (whole + extra).alias("copies"), "u")


def mix_documents(docs: DataFrame, scratch: Scratch, *, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: str = "mix") -> DataFrame:
    """The mixed corpus itself: every document of `docs`, all its columns, as often as the mix takes it.

    The rate depends on the source alone and the draw on the row alone, so the documents are not shuffled. Null and
    empty texts have size 0 and are taken like the others of their source; null sources are one more source, null ids
    count as empty in the draw, equal rows draw alike. An empty table gives no rows. No column name clashes with what
    is used inside.
    """
    p = unused("lathe_", docs)
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = scratch.put(source_rates(sizes, weights, percent, most)).select(F.col("source").alias(f"{p}source"), F.col("rate").alias(f"{p}rate"))
    rate = F.col(f"{p}rate")
    copies = F.floor(rate) + (draw(seed, F.col("doc_id"), F.col("text")) < rate - F.floor(rate)).cast("long")
    out = docs.join(rates, F.col("source").eqNullSafe(F.col(f"{p}source"))).withColumn(f"{p}copies", copies.cast("int")).where(F.col(f"{p}copies") > 0)
    return out.select(*map(column, docs.columns), F.explode(F.array_repeat(F.lit(1), F.col(f"{p}copies"))).alias(f"{p}copy")).drop(f"{p}copy")
