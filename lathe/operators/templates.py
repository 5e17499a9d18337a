"""Log templates: formats stated once, their values by row or by column, per artifact.

Every function takes lines(artifact_id, line_no, line). All per-artifact steps share the key artifact_id, so one
exchange serves them; formats are pre-aggregated before anything is collected, and an artifact's text is put together
only at the end. Fixed values of the format: `T<id>` rows, `V<line>` verbatim rows, `---` after the header, U+0004
between the fields of a column row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cells, columnar, masking, text
from ..functions.html import let
from .cut import cut

MIN_USES = 3
MAX_TEMPLATES = 500
FIELD = "\x04"


def masked(lines: DataFrame, key: str = "anchors3") -> DataFrame:
    m = lines.withColumn("m", masking.mask(F.col("line")))
    return m.select("artifact_id", "line_no", "line", F.col("m.template").alias("template"), F.col("m.values").alias("values")).withColumn("key", masking.template_key(F.col("template"), key))


def mine(m: DataFrame, min_uses: int = MIN_USES, max_templates: int = MAX_TEMPLATES) -> DataFrame:
    """templates(artifact_id, key, template, uses, first_line, template_id): formats met at least `min_uses` times.

    A format is represented by its first line; ids follow first appearance. Only the first `max_templates` formats
    of an artifact count.
    """
    own = m.groupBy("artifact_id", "key").agg(F.min_by("template", "line_no").alias("template"), F.count("*").alias("uses"), F.min("line_no").alias("first_line"))
    order = Window.partitionBy("artifact_id").orderBy("first_line")
    own = own.withColumn("seen", F.row_number().over(order)).where((F.col("seen") <= max_templates) & (F.col("uses") >= min_uses)).drop("seen")
    return own.withColumn("template_id", F.row_number().over(order))


def placed(m: DataFrame, templates: DataFrame) -> DataFrame:
    """Masked lines with the template that gives exactly the line back, if there is one."""
    t = templates.select("artifact_id", "key", F.col("template").alias("t_template"), "template_id")
    out = m.join(t, ["artifact_id", "key"], "left")
    exact = masking.unmask(F.col("t_template"), F.col("values")).eqNullSafe(F.col("line")) & (masking.slot_count(F.col("t_template")) == F.size("values"))
    return out.withColumn("template_id", F.when(exact, F.col("template_id"))).drop("t_template")


def row_line(values, template_id, line):
    t = F.concat(F.lit("T"), template_id.cast("string"))
    return F.when(template_id.isNull(), line).when(F.size(values) == 0, t).otherwise(F.concat(t, F.lit(" "), cells.encode_row(values)))


def headers(templates: DataFrame) -> DataFrame:
    """(artifact_id, header): a line a format, in order of ids."""
    line = F.concat(F.lit("T"), F.col("template_id").cast("string"), F.lit("  "), F.col("template"))
    ordered = F.array_sort(F.collect_list(F.struct("template_id", line.alias("line"))))
    return templates.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("header"))


def render_rows(m: DataFrame, templates: DataFrame) -> DataFrame:
    """(artifact_id, row_form): header, `---`, then a row a line. Lines that no template restores exactly stay as they are."""
    rows = placed(m, templates).withColumn("row", row_line(F.col("values"), F.col("template_id"), F.col("line")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "row")))
    body = rows.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n").alias("body"))
    return body.join(headers(templates), "artifact_id").select("artifact_id", F.concat("header", F.lit("\n---\n"), "body").alias("row_form"))


def render_columns(m: DataFrame, templates: DataFrame) -> DataFrame:
    """(artifact_id, column_form): a row a format, with line numbers and each value column in its shortest encoding.

    Lines that rank above 0, and lines without a template, stay readable as `V<line>` rows.
    """
    rows = placed(m, templates).withColumn("template_id", F.when(text.rank(F.col("line")) == 0, F.col("template_id")))
    grouped = rows.where("template_id is not null").groupBy("artifact_id", "template_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "values"))).alias("r"))
    width = F.size(F.get("r", F.lit(0))["values"])
    columns = F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.transform("r", lambda x: F.get(x["values"], c)))).otherwise(F.array().cast("array<array<string>>"))
    index = F.array(F.transform("r", lambda x: x["line_no"].cast("string")))
    encoded = F.transform(F.concat(index, columns), columnar.encode_column)
    fields = F.transform(encoded, lambda e: F.concat(e["encoding"], F.lit(":"), e["text"]))
    line = F.concat_ws(FIELD, F.concat(F.lit("T"), F.col("template_id").cast("string")), F.size("r").cast("string"), fields)
    some = grouped.select("artifact_id", F.lit(0).alias("part"), F.get("r", F.lit(0))["line_no"].cast("long").alias("at"), line.alias("row"))
    rest = rows.where("template_id is null").select("artifact_id", F.lit(1).alias("part"), F.col("line_no").cast("long").alias("at"), F.concat(F.lit("V"), F.col("line_no").cast("string"), F.lit(FIELD), "line").alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("part", "at", "row")))
    body = some.union(rest).groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["row"]), "\n").alias("body"))
    return body.join(headers(templates), "artifact_id").select("artifact_id", F.concat("header", F.lit("\n---\n"), "body").alias("column_form"))


def expand_columns(forms: DataFrame) -> DataFrame:
    """lines(artifact_id, line_no, line) from (artifact_id, column_form)."""
    whole = forms.select("artifact_id", F.substring_index("column_form", "\n---\n", 1).alias("head"), F.expr("substring(column_form, instr(column_form, '\n---\n') + 5)").alias("body"))
    heads = whole.select("artifact_id", F.explode(F.split("head", "\n", -1)).alias("h")).select("artifact_id", F.regexp_extract("h", r"^T(\d+)  ", 1).alias("id"), F.regexp_replace("h", r"^T\d+  ", "").alias("template"))
    rows = whole.select("artifact_id", F.explode(F.split("body", "\n", -1)).alias("row")).where("row <> ''").withColumn("f", F.split("row", FIELD, -1))
    own = rows.where(F.col("row").startswith("V")).select("artifact_id", F.substring(F.get("f", F.lit(0)), F.lit(2), F.lit(18)).cast("long").alias("line_no"), F.array_join(F.slice("f", F.lit(2), F.size("f")), FIELD).alias("line"))
    t = rows.where(F.col("row").startswith("T")).withColumn("id", F.substring(F.get("f", F.lit(0)), F.lit(2), F.lit(18))).join(heads, ["artifact_id", "id"])
    decoded = F.transform(F.slice("f", F.lit(3), F.size("f") - 2), lambda x: columnar.decode_column(F.substring_index(x, ":", 1), F.regexp_replace(x, "(?s)^[a-z]+:", "")))
    # Columns are decoded once an artifact and format, and turned into rows before they are exploded.
    turned = let(decoded, lambda c: F.transform(F.get(c, F.lit(0)), lambda at, i: F.struct(at.alias("line_no"), F.transform(F.slice(c, F.lit(2), F.size(c)), lambda v: F.get(v, i)).alias("values"))))
    t = t.select("artifact_id", "template", F.inline(turned))
    return t.select("artifact_id", F.col("line_no").cast("long").alias("line_no"), masking.unmask(F.col("template"), F.col("values")).alias("line")).union(own)


def expand_rows(forms: DataFrame) -> DataFrame:
    """(artifact_id, text) from (artifact_id, row_form): formats filled in, other rows as they stand.

    Rows are read one by one, since values hold no line end; cells are taken as text.
    """
    whole = forms.select("artifact_id", F.substring_index("row_form", "\n---\n", 1).alias("head"), F.expr("substring(row_form, instr(row_form, '\n---\n') + 5)").alias("body"))
    heads = whole.select("artifact_id", F.explode(F.split("head", "\n", -1)).alias("h")).select("artifact_id", F.regexp_extract("h", r"^T(\d+)  ", 1).alias("id"), F.regexp_replace("h", r"^T\d+  ", "").alias("template"))
    rows = whole.select("artifact_id", F.posexplode(F.split("body", "\n", -1)).alias("i", "row")).withColumn("id", F.regexp_extract("row", r"^T(\d+)(?: |$)", 1))
    raw = F.regexp_extract_all(F.regexp_replace("row", r"^T\d+ ?", ""), F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    plain = F.transform(raw, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    own = rows.join(heads, ["artifact_id", "id"], "left")
    line = F.when(F.col("template").isNull(), F.col("row")).otherwise(masking.unmask(F.col("template"), plain))
    ordered = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    return own.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def log_templates(artifacts: DataFrame, key: str = "anchors3") -> DataFrame:
    """artifacts(artifact_id, text, budget) with `rendered`, `templates_found` and `form`: the shorter form if it fits, and only if smaller.

    Texts with CRLF, or whose lines look like rows of the form themselves, are declined (rendered null): what can't
    be given back exactly is not used. The final line end is kept.
    """
    texts = artifacts.where((F.length("text") > 500) & F.col("text").contains("\n") & ~F.col("text").contains("\r") & ~F.col("text").rlike(r"(?m)^[TV]\d+(?:[ \x04]|$)|\x01|\x02|\x03|\x04|^---$"))
    rows = texts.select("artifact_id", F.posexplode(text.lines(F.col("text"))).alias("line_no", "line"))
    # Masks are dear and read by several branches.
    m = cut(masked(rows, key))
    t = cut(mine(m))
    forms = render_rows(m, t).join(render_columns(m, t), "artifact_id").join(t.groupBy("artifact_id").agg(F.count("*").alias("templates_found")), "artifact_id")
    out = artifacts.join(forms, "artifact_id", "left")
    by_column = (F.length("column_form") <= F.col("budget")) & (F.length("column_form") < F.length("row_form"))
    body = F.concat(F.when(by_column, F.col("column_form")).otherwise(F.col("row_form")), F.when(F.col("text").endswith("\n"), "\n").otherwise(""))
    smaller = F.length(body) < F.length("text")
    out = out.withColumn("form", F.when(smaller, F.when(by_column, "columns").otherwise("rows"))).withColumn("rendered", F.when(smaller, body))
    return out.drop("row_form", "column_form")


def _in_turns(queues: pd.Series, spent: pd.Series, room: pd.Series) -> pd.Series:
    """Numbers of the lines that are taken from each queue: in order, a template being through at its first that doesn't fit."""

    def take(queue, used: int, available: int) -> list[int]:
        shut, taken = set(), []
        for x in queue:
            if x["since"] in shut:
                continue
            if used + x["size"] > available:
                shut.add(x["since"])
                continue
            used += x["size"]
            taken.append(x["line_no"])
        return taken

    return pd.Series([take(q, int(u), int(a)) for q, u, a in zip(queues, spent, room, strict=True)], dtype=object)


def fit_rows(rows: DataFrame, available: int | None = None) -> DataFrame:
    """rows(artifact_id, line_no, row) that fit: those of rank above 0 first, best first, up to the first that doesn't fit;
    then ordinary rows in turns over their templates, a template being through at its first row that doesn't fit.

    Lengths count the line end. `available` is one for all, or a column of `rows`. The turns depend on each other, so
    an artifact's ordinary rows are walked once, in order of (turn, template).
    """
    r = rows.withColumn("rank", text.rank(F.col("row"))).withColumn("size", F.length("row") + 1)
    if available is not None:
        r = r.withColumn("available", F.lit(available))
    best = Window.partitionBy("artifact_id").orderBy(F.col("rank").desc(), "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = r.where("rank > 0").withColumn("used", F.sum("size").over(best)).where(F.col("used") <= F.col("available"))
    spent = kept.groupBy("artifact_id").agg(F.max("used").alias("spent"))
    tid = F.coalesce(F.nullif(F.regexp_extract("row", r"^[TV](\d+)", 1), F.lit("")), F.lit("?"))
    plain = r.where("rank = 0").withColumn("tid", tid)
    per = Window.partitionBy("artifact_id", "tid")
    plain = plain.withColumn("turn", F.row_number().over(per.orderBy("line_no"))).withColumn("since", F.min("line_no").over(per))
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("since").cast("long").alias("since"), F.col("line_no").cast("long").alias("line_no"), F.col("size").cast("long").alias("size"))))
    queue = plain.groupBy("artifact_id").agg(ordered.alias("q"), F.first("available").alias("available")).join(spent, "artifact_id", "left")
    walk = F.pandas_udf(_in_turns, "array<bigint>")
    taken = queue.select("artifact_id", F.explode(walk("q", F.coalesce("spent", F.lit(0)).cast("long"), F.col("available").cast("long"))).alias("line_no"))
    return kept.select("artifact_id", F.col("line_no").cast("long").alias("line_no")).union(taken)
