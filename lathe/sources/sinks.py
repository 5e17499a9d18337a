"""Where reduced corpora go: texts, results as JSON, and a line of statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_results(reduced: DataFrame, path: str, form: str = "parquet") -> None:
    """The whole result, in any of Spark's formats; a rerun replaces it."""
    reduced.write.format(form).mode("overwrite").save(path)


def write_texts(reduced: DataFrame, path: str) -> None:
    """The reduced texts alone, one JSON line each, with their notes beside them."""
    reduced.select("artifact_id", "text", "note").write.mode("overwrite").json(path)


def as_json(reduced: DataFrame) -> DataFrame:
    """(artifact_id, result): every row as a JSON object, nulls included."""
    return reduced.select("artifact_id", F.to_json(F.struct(*reduced.columns), {"ignoreNullFields": "false"}).alias("result"))


def stats_line(calls: Column, chars_in: Column, chars_out: Column) -> Column:
    """What was saved, in words."""
    share = F.when(chars_in > 0, F.round((chars_in - chars_out) * 100 / chars_in, 1)).otherwise(F.lit(0.0))
    return F.concat(calls.cast("string"), F.lit(" texts, "), chars_in.cast("string"), F.lit(" to "), chars_out.cast("string"), F.lit(" chars, "), share.cast("string"), F.lit(" % saved"))
