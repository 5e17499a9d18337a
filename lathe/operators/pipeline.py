"""The reduction pipeline: lossless stages before lossy ones, each only where the text is still over budget and the stage applies.

artifacts(artifact_id, text, budget) come back with the reduced text and a record of what was tried. A stage is a
DataFrame to DataFrame step that proposes `rendered`; it is used only if it is shorter, so texts never grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html
from ..functions import text as T
from . import reduce, store, tables, templates
from .cut import cut

APPLIED = "array<struct<id:string,applied:boolean,lossless:boolean,reason:string,before:int,after:int>>"
Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Stage:
    """`applies` is a cheap condition over (text, kind, budget). A row-wise stage gives `make`, a Column of the new text;
    another gives `run`, which takes the rows that need it and adds `rendered`."""

    id: str
    lossless: bool
    applies: Callable[[], Column]
    run: Step | None = None
    make: Callable[[Column], Column] | None = None
    closes: bool = False  # what it makes may not be cut any more


def validate(stage: Stage) -> Stage:
    if not stage.id or not callable(stage.applies) or not (callable(stage.run) or callable(stage.make)):
        raise ValueError(f"no stage: {stage!r}")
    return stage


def of_kind(*kinds: str) -> Callable[[], Column]:
    return lambda: F.col("kind").isin(*kinds) & F.col("open")


def _fit_templates(df: DataFrame) -> DataFrame:
    """Row forms cut to their budget: rows of rank best first, then ordinary ones in turns over the templates."""
    whole = df.withColumn("header", F.substring_index("text", "\n---\n", 1))
    rows = cut(whole.select("artifact_id", F.greatest(F.lit(200), F.col("budget") - F.length("header") - 120).alias("available"), F.posexplode(F.split(F.expr("substring(text, instr(text, '\n---\n') + 5)"), "\n", -1)).alias("line_no", "row")))
    fitting = templates.fit_rows(rows).withColumn("keep", F.lit(True))
    own = rows.withColumn("line_no", F.col("line_no").cast("long")).join(fitting, ["artifact_id", "line_no"], "left").withColumn("keep", F.coalesce("keep", F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("line_no", "row"))))
    got = own.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n").alias("body"), F.count_if(~F.col("keep")).alias("gone"), F.count_if(~F.col("keep") & (T.rank(F.col("row")) > 0)).alias("lost"))
    out = whole.join(got, "artifact_id", "left")
    note = F.concat(F.lit("\n["), F.col("gone").cast("string"), F.lit(" row(s) dropped, "), F.when(F.col("lost") == 0, "every error and warning kept").otherwise(F.concat(F.col("lost").cast("string"), F.lit(" of them errors or warnings"))), F.lit("]"))
    return out.withColumn("rendered", F.when(F.col("gone") > 0, F.concat("header", F.lit("\n---\n"), "body", note))).drop("header", "body", "gone", "lost")


def templated() -> Column:
    return F.exists("applied", lambda a: (a["id"] == "log-templates") & a["applied"])


STAGES: list[Stage] = [
    Stage("html-to-markdown", False, lambda: (F.length("text") > 300) & html.looks_like_html(F.col("text")), make=lambda t: html.let(html.to_markdown(t), lambda md: F.when(F.length(md) >= 40, md))),
    Stage("json-tables", True, lambda: (F.length("text") > 200) & (F.col("kind") == "json"), make=lambda t: tables.compacted_json(t), closes=True),
    Stage("md-tables", True, lambda: (F.length("text") > 400) & F.col("text").contains("\n") & F.col("text").rlike("[|,]") & (F.col("kind") != "json"), lambda df: tables.md_tables(df).drop("tables"), closes=True),
    Stage("log-templates", True, lambda: (F.length("text") > 500) & F.col("text").contains("\n") & (F.col("kind") != "json"), lambda df: templates.log_templates(df).drop("form", "templates_found"), closes=True),
    Stage("template-rows", False, templated, _fit_templates, closes=True),
    Stage("test-output", False, of_kind("test"), lambda df: reduce.shrink_tests(df).withColumnRenamed("reduced", "rendered")),
    Stage("diff", False, of_kind("diff"), make=lambda t: reduce.shrink_diff(t, F.col("budget"))),
    Stage("stacktrace", False, of_kind("stacktrace"), make=lambda t: reduce.shrink_stacktrace(t, F.col("budget"))),
    Stage("json", False, of_kind("json"), make=lambda t: reduce.shrink_json(t, F.col("budget")), closes=True),
    Stage("log", False, of_kind("log", "listing"), make=lambda t: reduce.shrink_log(t, F.col("budget"))),
    Stage("head-tail", False, lambda: F.col("open"), make=lambda t: T.head_tail(t, F.col("budget"))),
]


def step(df: DataFrame, stage: Stage) -> DataFrame:
    """One stage. Rows that don't need it are passed by: a null text for a row-wise stage, a branch of their own else.

    The branch reads its input several times, so the plan is cut before it. A stage that can't even be planned is
    recorded as failed for the rows that need it, and the others go on; row-wise stages decline texts they can't handle.
    """
    needs = F.coalesce((F.length("text") > F.col("budget")) & validate(stage).applies(), F.lit(False))
    columns = df.columns
    if stage.make is not None:
        todo = df.withColumn("needs", needs)
        made = proposed(lambda: todo.withColumn("rendered", stage.make(F.when(F.col("needs"), F.col("text")))), todo)
        return recorded(made[0], stage, F.col("needs"), made[1]).select(*columns)
    df = cut(df.withColumn("needs", needs))
    todo = df.where("needs").drop("needs")
    made = proposed(lambda: stage.run(todo), todo)
    return df.where("not needs").select(*columns).unionByName(recorded(made[0], stage, F.lit(True), made[1]).select(*columns))


def proposed(run: Callable[[], DataFrame], todo: DataFrame) -> tuple[DataFrame, str | None]:
    """(rows with `rendered`, None), or nothing proposed and what went wrong."""
    try:
        out = run()
        if missing := {*todo.columns, "rendered"} - {*out.columns}:
            raise ValueError(f"no {sorted(missing)} in what the stage gives")
    except Exception as e:  # whatever a stage of the user raises
        return todo.withColumn("rendered", F.lit(None).cast("string")), f"failed: {type(e).__name__}"
    return out, None


def recorded(todo: DataFrame, stage: Stage, tried: Column, failure: str | None = None) -> DataFrame:
    """The stage's proposal taken if it is shorter, and a record of it for the rows that tried it."""
    use = tried & F.col("rendered").isNotNull() & (F.length("rendered") < F.length("text"))
    reason = F.when(use, "shorter").when(F.col("rendered").isNull(), failure or "declined").otherwise("would grow")
    record = F.struct(F.lit(stage.id).alias("id"), use.alias("applied"), F.lit(stage.lossless).alias("lossless"), reason.alias("reason"), F.length("text").alias("before"), F.when(use, F.length("rendered")).otherwise(F.length("text")).alias("after"))
    todo = todo.withColumn("use", use).withColumn("applied", F.when(tried, F.array_append("applied", record)).otherwise(F.col("applied")))
    return todo.withColumn("open", F.col("open") & ~(F.col("use") & F.lit(stage.closes))).withColumn("text", F.when(F.col("use"), F.col("rendered")).otherwise(F.col("text")))


def reduce_corpus(artifacts: DataFrame, stages: list[Stage] | None = None) -> DataFrame:
    """artifact_id, kind, original, text, original_chars, compressed_chars, ratio, tokens before and after, lossy, retrieval_id, note, applied.

    Null texts count as empty and come back unchanged. `lossy` says whether anything was removed; `retrieval_id`
    finds the original in a store, whether or not anything was.
    """
    df = artifacts.select("artifact_id", F.coalesce("text", F.lit("")).alias("text"), F.col("budget").cast("int").alias("budget"))
    df = df.withColumn("original", F.col("text")).withColumn("kind", T.detect_kind(F.col("text"))).withColumn("open", F.lit(True)).withColumn("applied", F.array().cast(APPLIED))
    for s in STAGES if stages is None else stages:
        df = step(df, s)
    # What callers filter or join must not be worked into the stages' expressions.
    df = cut(df)
    lossy = F.exists("applied", lambda a: a["applied"] & ~a["lossless"])
    changed = F.exists("applied", lambda a: a["applied"])
    names = F.array_join(F.transform(F.filter("applied", lambda a: a["applied"]), lambda a: a["id"]), ", ")
    note = F.when(changed, F.concat(F.lit("["), F.col("kind"), F.lit(": "), F.length("original").cast("string"), F.lit(" to "), F.length("text").cast("string"), F.lit(" chars by "), names, F.when(lossy, "; parts were removed").otherwise("; nothing was removed"), F.lit("; original: "), store.id_for(F.col("original")), F.lit("]")))
    return df.select(
        "artifact_id", "kind", "original", "text", F.length("original").alias("original_chars"), F.length("text").alias("compressed_chars"), T.ratio(F.length("original"), F.length("text")).alias("ratio"),
        T.estimate_tokens(F.col("original")).alias("original_tokens"), T.estimate_tokens(F.col("text")).alias("compressed_tokens"), lossy.alias("lossy"), F.when(changed, store.id_for(F.col("original"))).alias("retrieval_id"), note.alias("note"), "applied",
    )
