"""Inputs of the query catalogue: the given tables, and logs made of event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_line() -> F.Column:
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    value = F.col("value").cast("decimal(12,2)").cast("string")
    return F.concat(stamp, F.lit(" "), F.upper("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), value, F.lit(" "), "props")


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(artifact_id, line_no, line): a log a user, in order of time."""
    events = read(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("artifact_id"), (F.row_number().over(order) - 1).cast("long").alias("line_no"), event_line().alias("line"))


#: The same in DuckDB's SQL.
LOG_SQL = """log AS (
  SELECT user_id AS artifact_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, event_id,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || upper(event_type) || ' user=' || user_id || ' value=' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) || ' ' || props AS line
  FROM events)"""


def log_artifacts(spark: SparkSession, sf_dir: str, budget: int = 4000) -> DataFrame:
    """artifacts(artifact_id, text, budget): the same logs as texts."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return log_lines(spark, sf_dir).groupBy("artifact_id").agg(text.alias("text")).withColumn("budget", F.lit(budget))
