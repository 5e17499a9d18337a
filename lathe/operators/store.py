"""Content-addressed store of originals: an append-only table store(id, body, chars, stored_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ID = r"^(?i)[0-9a-f]{6,64}$"


def id_for(text: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of the text in UTF-8."""
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def put(store: DataFrame | None, texts: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows to append for texts(text): each content once, none that the store holds."""
    new = texts.where(F.col("text").isNotNull()).select(id_for(F.col("text")).alias("id"), F.col("text").alias("body")).dropDuplicates(["id"])
    if store is not None:
        new = new.join(store.select("id"), "id", "left_anti")
    return new.select("id", "body", F.length("body").alias("chars"), (F.current_timestamp() if at is None else at).alias("stored_at"))


def get(store: DataFrame, id_: str) -> DataFrame:
    """The entry of an id; none for what is no id."""
    return store.where((F.col("id") == id_.lower()) & F.lit(id_).rlike(ID))


def slice_lines(store: DataFrame, from_line: int = 1, n: int = 200) -> DataFrame:
    """(id, slice): n lines from a line on, counted from 1."""
    ls = F.split("body", "\r?\n", -1)
    return store.select("id", F.array_join(F.slice(ls, max(1, from_line), n), "\n").alias("slice"))


def grep(store: DataFrame, pattern: str, most: int = 100, ignore_case: bool = True) -> DataFrame:
    """(id, line, text): the first matching lines of every entry, numbered from 1."""
    hit = store.select("id", F.posexplode(F.split("body", "\r?\n", -1)).alias("i", "text")).where(F.col("text").rlike(("(?i)" if ignore_case else "") + pattern))
    order = Window.partitionBy("id").orderBy("i")
    return hit.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("id", (F.col("i") + 1).alias("line"), "text")


def prune(store: DataFrame, most: int = 500, max_age_days: int = 7, now: Column | None = None) -> DataFrame:
    """What stays: the newest `most` entries that are not too old.

    The cut is found by a top-k over (stored_at, id), so no task ranks the whole store.
    """
    now = F.current_timestamp() if now is None else now
    fresh = store.where(F.col("stored_at") >= now - F.expr(f"INTERVAL {int(max_age_days)} DAYS"))
    newest = fresh.select("id", "stored_at").orderBy(F.col("stored_at").desc(), "id").limit(most)
    return fresh.join(newest.select("id"), "id", "left_semi")


def clear(store: DataFrame) -> DataFrame:
    """What stays of a store that is emptied: its columns, no entry."""
    return store.where(F.lit(False))


def has(store: DataFrame, id_: str) -> DataFrame:
    return get(store, id_).agg((F.count("*") > 0).alias("found"))


def stats(store: DataFrame) -> DataFrame:
    """entries, chars and bytes of the store."""
    return store.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("body")), F.lit(0)).alias("chars"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes"))


def needles_kept(text: Column, needles: Column) -> Column:
    return F.forall(needles, lambda n: F.contains(text, n))


def kind_stats(results: DataFrame) -> DataFrame:
    """Calls and characters in and out by kind, and in all (kind null), of results(kind, original_chars, compressed_chars)."""
    return (
        results.rollup("kind")
        .agg(F.count("*").alias("calls"), F.count_if(F.col("compressed_chars") < F.col("original_chars")).alias("compressed_calls"), F.sum("original_chars").alias("chars_in"), F.sum("compressed_chars").alias("chars_out"))
        .withColumn("chars_saved", F.col("chars_in") - F.col("chars_out"))
        .withColumn("ratio", T.ratio(F.col("chars_in"), F.col("chars_out")))
    )


__all__ = ["clear", "get", "grep", "has", "id_for", "kind_stats", "needles_kept", "prune", "put", "slice_lines", "stats"]
