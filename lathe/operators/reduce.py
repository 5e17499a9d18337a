"""Reducers that drop what matters least for a kind of text. Row-wise ones are Columns and shuffle nothing."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The line patterns of each kind.
DIFF_KEEP = r"^(diff --git|--- |\+\+\+ |@@ |new file|deleted file|rename |[+-])"
FRAME = r"^\s+at "
LIBRARY = r"node:internal|[\\/]node_modules[\\/]"
SUMMARY = r"(?i)^\s*#\s*(pass|fail|tests|skipped|todo|cancelled|duration)|^\s*\d+ (passing|failing|passed|failed|skipped){b}"
ANNOUNCED = r"(?i)^\s*#\s*Subtest:"
PASSING = r"(?i)^\s*(ok|✓|√|PASS){b}"
FAILING = r"(?i)^\s*(not ok|✗|×|FAIL|✕){b}"
VERDICT = r"(?i)^\s*(ok|not ok|✓|✗){b}"
DIAGNOSTICS = 24
SALIENT_LINES, TAIL_LINES, SALIENT_SHARE = 200, 40, 0.75


def all_lines(text: Column) -> Column:
    """Lines as they are split at LF or CRLF; a final line end leaves an empty last line."""
    return F.split(T.unify(text), "\n", -1)


def shrink_diff(text: Column, budget: Column | int) -> Column:
    """Headers, hunks and changed lines; context is counted and dropped."""
    ls = all_lines(text)
    kept = F.filter(ls, lambda x: x.rlike(DIFF_KEEP))
    gone = F.size(ls) - F.size(kept)
    note = F.when(gone > 0, F.array(F.concat(F.lit("[compressed: "), gone.cast("string"), F.lit(" unchanged context lines omitted]")))).otherwise(F.array().cast("array<string>"))
    return T.head_tail(F.array_join(F.concat(note, kept), "\n"), budget)


def shrink_stacktrace(text: Column, budget: Column | int) -> Column:
    """All but the frames of libraries and of the runtime, whose number follows at the end."""
    ls = all_lines(text)
    kept = F.filter(ls, lambda x: ~(x.rlike(FRAME) & x.rlike(LIBRARY)))
    gone = F.size(ls) - F.size(kept)
    note = F.when(gone > 0, F.array(F.concat(F.lit("[compressed: "), gone.cast("string"), F.lit(" library/internal frames omitted]")))).otherwise(F.array().cast("array<string>"))
    return T.head_tail(F.array_join(F.concat(kept, note), "\n"), budget)


def shrink_log(text: Column, budget: Column | int) -> Column:
    """Salient lines if they leave room, then the last lines; else both ends."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    ls = all_lines(text)
    body = F.array_join(ls, "\n")
    salient = F.filter(ls, lambda x: T.is_salient(x) & ~T.is_noise(x))
    block = F.array_join(F.slice(salient, 1, SALIENT_LINES), "\n")
    room = F.greatest(budget - F.length(block) - 80, F.lit(0)).cast("int")
    tail = F.array_join(F.slice(ls, F.greatest(F.size(ls) - TAIL_LINES + 1, F.lit(1)), F.lit(TAIL_LINES)), "\n")
    parts = F.concat(F.lit("[compressed: "), F.size(ls).cast("string"), F.lit(" lines → salient lines + tail]\n"), block, F.lit("\n\n--- tail ---\n"), F.right(tail, room))
    use = (F.size(salient) > 0) & (F.length(block) <= budget * SALIENT_SHARE)
    return F.when(F.length(body) <= budget, body).when(use, parts).otherwise(T.head_tail(body, budget))


def shrink_tests(artifacts: DataFrame) -> DataFrame:
    """artifacts(artifact_id, text, budget) with `reduced`: failures with what follows them, and the summary.

    A failure keeps up to 24 lines that are not blank, up to the next verdict. Blocks are numbered by a running count
    of verdicts; within a block, a failure mark among the lines of an earlier failure starts nothing, which a fold
    over the block's failures decides, of which those that start something are at least that far apart.
    """
    rows = artifacts.select("artifact_id", F.posexplode(all_lines(F.col("text"))).alias("i", "line"))
    is_ = lambda p: F.col("line").rlike(T.spark_re(p))
    order = Window.partitionBy("artifact_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("block", F.sum(is_(VERDICT).cast("int")).over(order))
    kind = F.when(is_(SUMMARY), "summary").when(is_(ANNOUNCED) | is_(PASSING), "passing").when(is_(FAILING), "failing").when(is_(T.SALIENT) & ~is_(T.NOISE), "salient")
    rows = rows.withColumn("kind", kind)
    in_block = Window.partitionBy("artifact_id", "block")
    # Which failures start: decided once a block, then told to their own rows alone.
    far = lambda s, x: F.when((F.size(s) == 0) | (x > F.element_at(s, -1) + DIAGNOSTICS), F.array_append(s, x)).otherwise(s)
    failures = rows.where("kind = 'failing'").groupBy("artifact_id", "block").agg(F.array_sort(F.collect_list("i")).alias("at"))
    starts = failures.select("artifact_id", F.explode(F.aggregate("at", F.array().cast("array<int>"), far)).alias("i"), F.lit(True).alias("starts"))
    rows = rows.join(starts, ["artifact_id", "i"], "left")
    last = F.last(F.when(F.col("starts"), F.col("i")), ignorenulls=True).over(in_block.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("start", last).withColumn("inside", F.coalesce((F.col("i") > F.col("start")) & (F.col("i") <= F.col("start") + DIAGNOSTICS), F.lit(False)))
    keep = F.when(F.col("inside"), F.trim("line") != "").otherwise(F.coalesce(F.col("kind").isin("failing", "salient"), F.lit(False)))
    summary = ~F.col("inside") & (F.col("kind") == "summary")
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("i", "line")))), lambda x: x["line"])
    got = rows.groupBy("artifact_id").agg(pick(keep).alias("kept"), pick(summary).alias("summary"), F.count_if(~F.col("inside") & (F.col("kind") == "passing")).alias("passing"))
    note = F.when(F.col("passing") > 0, F.array(F.concat(F.lit("[compressed: "), F.col("passing").cast("string"), F.lit(" passing lines omitted]")))).otherwise(F.array().cast("array<string>"))
    close = F.when(F.size("summary") > 0, F.concat(F.array(F.lit("")), F.col("summary"))).otherwise(F.col("summary"))
    got = got.select("artifact_id", F.array_join(F.concat(note, "kept", close), "\n").alias("body"))
    return artifacts.join(got, "artifact_id", "left").withColumn("reduced", T.head_tail(F.col("body"), F.col("budget"))).drop("body")


def shrink_value(v, most_items: int = 3, most_chars: int = 200, depth: int = 0):
    """The shape of a JSON value: short arrays and strings, and no more than seven levels."""
    if isinstance(v, str):
        return v if len(v) <= most_chars else f"{v[:most_chars]}…[+{len(v) - most_chars} chars]"
    if isinstance(v, list):
        if depth > 6:
            return f"[Array({len(v)})]"
        head = [shrink_value(x, most_items, most_chars, depth + 1) for x in v[:most_items]]
        return head + [f"…[+{len(v) - most_items} more items]"] * (len(v) > most_items)
    if isinstance(v, dict):
        return "[Object]" if depth > 6 else {k: shrink_value(x, most_items, most_chars, depth + 1) for k, x in v.items()}
    return v


def _shapes(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(shrink_value(json.loads(t)), indent=2, ensure_ascii=False) if t is not None and T.parses(t) else None)


def json_shape(text: Column) -> Column:
    """Recursion over values of unknown shape, key order kept: no built-in does it. Null for what isn't JSON."""
    return F.pandas_udf(_shapes, "string")(text)


def shrink_json(text: Column, budget: Column | int) -> Column:
    return T.head_tail(F.coalesce(json_shape(F.when(T.may_be_json(text), text)), text), budget)
