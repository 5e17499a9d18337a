"""Streams of log lines: templates, salience and token counts over event-time windows, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking
from ..functions import text as T
from ..operators import store


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A folder of growing text files as a stream of (line, seen_at)."""
    return spark.readStream.format("text").load(path).select(F.col("value").alias("line"), F.current_timestamp().alias("seen_at"))


def template_counts(lines: DataFrame, at: str = "seen_at", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, key, template, uses, worst_rank) by window; state is bounded by the watermark and the number of formats."""
    m = masking.mask(F.col("line"))["template"]
    own = lines.withWatermark(at, late).withColumn("template", m).withColumn("key", masking.template_key(F.col("template"))).withColumn("rank", T.rank(F.col("line")))
    got = own.groupBy(F.window(at, window).alias("w"), "key").agg(F.min("template").alias("template"), F.count("*").alias("uses"), F.max("rank").alias("worst_rank"))
    return got.select(F.col("w.start").alias("start"), "key", "template", "uses", "worst_rank")


def salient(lines: DataFrame) -> DataFrame:
    """Lines to look at at once; no state."""
    line = F.col("line")
    return lines.where(T.is_salient(line) & ~T.is_noise(line)).withColumn("rank", T.rank(line))


def store_new(texts: DataFrame, at: str = "seen_at", late: str = "1 hour") -> DataFrame:
    """Rows for the content store, each content once within the watermark."""
    own = texts.withWatermark(at, late).withColumn("id", store.id_for(F.col("text")))
    return own.dropDuplicatesWithinWatermark(["id"]).select("id", F.col("text").alias("body"), F.length("text").alias("chars"), F.col(at).alias("stored_at"))
