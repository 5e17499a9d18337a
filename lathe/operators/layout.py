"""Page layout from positioned lines and runs: gutters, reading order, running heads, column edges, page ranges.

runs(artifact_id, page, run_no, text, x, y, size, width); lines(artifact_id, page, line_no, text, x, y, size, width).
Pages are small, so every window is over one page; what spans pages is a group by with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["artifact_id", "page"]
# Shares and distances of the layout rules.
NARROW, GUTTER, SIDE, LEAST_SIDE, LEAST_LINES = 0.7, 0.04, 0.15, 2, 8
EDGE_GAP, EDGE_LINES, RUNNING_PAGES, RUNNING_SHARE, DRIFT = 1.8, 5, 3, 0.6, 1.5
COLUMN_GAP = 0.8


def gutters(lines: DataFrame) -> DataFrame:
    """(artifact_id, page, start, stop): gaps of at least 4 % of the page between the merged extents of narrow lines."""
    page = Window.partitionBy(*PAGE)
    right = F.col("x") + F.col("width")
    wide = lines.withColumn("right", right).withColumn("lo", F.min("x").over(page)).withColumn("hi", F.max("right").over(page)).withColumn("span", F.col("hi") - F.col("lo"))
    narrow = wide.where(F.col("width") < F.col("span") * NARROW)
    before = F.max("right").over(page.orderBy("x", "right").rowsBetween(Window.unboundedPreceding, -1))
    return narrow.withColumn("reach", before).where((F.col("reach").isNotNull()) & (F.col("x") - F.col("reach") >= F.col("span") * GUTTER)).select(*PAGE, F.col("reach").alias("start"), F.col("x").alias("stop"))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with `pos`, their place in reading order on the page: bands between lines that span the gutter, left before right.

    Pages without one clear gutter, with fewer than 8 lines, or with too few lines on a side read from the top down.
    """
    g = gutters(lines).withColumn("k", F.row_number().over(Window.partitionBy(*PAGE).orderBy((F.col("stop") - F.col("start")).desc(), "start"))).where("k = 1").drop("k")
    own = lines.join(g, PAGE, "left")
    right = F.col("x") + F.col("width")
    side = F.when(F.col("start").isNull(), "span").when(right <= F.col("start") + 1, "left").when(F.col("x") >= F.col("stop") - 1, "right").otherwise("span")
    page = Window.partitionBy(*PAGE)
    own = own.withColumn("side", side).withColumn("n", F.count("*").over(page))
    for s in ("left", "right"):
        own = own.withColumn(f"n_{s}", F.count_if(F.col("side") == s).over(page))
    least = F.greatest(F.lit(LEAST_SIDE), F.ceil(F.col("n") * SIDE))
    own = own.withColumn("split", (F.col("n") >= LEAST_LINES) & (F.col("n_left") >= least) & (F.col("n_right") >= least))
    down = page.orderBy(F.col("y").desc(), "x", "line_no")
    spans = F.sum((F.col("side") == "span").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    band = F.when(F.col("split"), spans * 2 + F.when(F.col("side") == "span", 0).otherwise(1)).otherwise(0)
    own = own.withColumn("band", band).withColumn("half", F.when(F.col("split") & (F.col("side") == "right"), 1).otherwise(0))
    return own.withColumn("pos", F.row_number().over(page.orderBy("band", "half", F.col("y").desc(), "x", "line_no"))).select(*lines.columns, "side", "pos")


def digits_out(text: Column) -> Column:
    """A line without what changes from page to page: digits as #, blanks collapsed, lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d+", "#"), r"\s+", " "))


def body_range(lines: DataFrame) -> DataFrame:
    """(artifact_id, top, bottom): upper medians over pages of where the body starts and ends, its far edges cut off."""
    page = Window.partitionBy(*PAGE)
    down = page.orderBy(F.col("y").desc(), "line_no")
    r = lines.withColumn("gap", F.lag("y").over(down) - F.col("y")).withColumn("i", F.row_number().over(down)).withColumn("n", F.count("*").over(page)).where(F.col("n") >= EDGE_LINES)
    gaps = r.groupBy(*PAGE).agg(F.array_sort(F.collect_list("gap")).alias("g"), F.array_sort(F.collect_list(F.struct("i", "y", F.coalesce("gap", F.lit(0.0)).alias("gap")))).alias("l"), F.first("n").alias("n"))
    mid = F.get("g", F.floor(F.size("g") / 2).cast("int"))
    at = lambda i: F.get("l", i)
    top = F.when(at(F.lit(1))["gap"] > mid * EDGE_GAP, at(F.lit(1))["y"]).otherwise(at(F.lit(0))["y"])
    end = F.size("l")
    bottom = F.when(at(end - 1)["gap"] > mid * EDGE_GAP, at(end - 2)["y"]).otherwise(at(end - 1)["y"])
    per = gaps.select("artifact_id", top.alias("top"), bottom.alias("bottom"))
    upper = lambda c: F.get(F.array_sort(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int"))
    return per.groupBy("artifact_id").agg(upper("top").alias("top"), upper("bottom").alias("bottom"))


def running_content(lines: DataFrame) -> DataFrame:
    """(artifact_id, zone, key, pages, sample): heads and feet that stand on at least 60 % of three pages or more, at one height."""
    total = lines.groupBy("artifact_id").agg(F.count_distinct("page").alias("total")).where(F.col("total") >= RUNNING_PAGES)
    own = lines.join(body_range(lines), "artifact_id").join(total, "artifact_id")
    zone = F.when(F.col("y") > F.col("top"), "head").when(F.col("y") < F.col("bottom"), "foot")
    own = own.withColumn("zone", zone).where("zone is not null").withColumn("key", digits_out(F.col("text")))
    got = own.groupBy("artifact_id", "zone", "key").agg(F.count_distinct("page").alias("pages"), F.min(F.struct("page", "line_no", "text")).alias("f"), (F.max("y") - F.min("y")).alias("spread"), F.max("size").alias("size"), F.first("total").alias("total"))
    return got.where((F.col("pages") >= F.col("total") * RUNNING_SHARE) & (F.col("pages") >= RUNNING_PAGES) & (F.col("spread") <= F.col("size") * DRIFT)).select("artifact_id", "zone", "key", "pages", F.col("f.text").alias("sample"))


def strip_running(lines: DataFrame) -> DataFrame:
    """Lines without running heads and feet."""
    found = running_content(lines).select("artifact_id", "zone", "key")
    own = lines.join(body_range(lines), "artifact_id", "left")
    zone = F.when(F.col("y") > F.col("top"), "head").when(F.col("y") < F.col("bottom"), "foot")
    return own.withColumn("zone", zone).withColumn("key", digits_out(F.col("text"))).join(found, ["artifact_id", "zone", "key"], "left_anti").select(*lines.columns)


def most_common(rows: DataFrame, by: list[str], value: str, at: str) -> DataFrame:
    """The most frequent value of each group, of equals the one met first."""
    n = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), "first")
    return n.withColumn("k", F.row_number().over(order)).where("k = 1").select(*by, value, "n")


def column_edges(runs: DataFrame) -> DataFrame:
    """(artifact_id, page, col, x): left edges, where starts of runs lie more than .8 of the upper median size apart."""
    page = Window.partitionBy(*PAGE)
    sizes = F.array_sort(F.collect_list("size").over(page))
    r = runs.withColumn("mid", F.get(sizes, F.floor(F.size(sizes) / 2).cast("int")))
    order = page.orderBy("x", "run_no")
    r = r.withColumn("new", F.coalesce((F.col("x") - F.lag("x").over(order) > F.col("mid") * COLUMN_GAP).cast("int"), F.lit(0)))
    r = r.withColumn("col", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy(*PAGE, "col").agg(F.min("x").alias("x"))


def assign_columns(runs: DataFrame, edges: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Runs with `col`, the rightmost column that starts at or before them: an as-of join within the page."""
    e = edges.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("x", "col"))).alias("edges"))
    own = runs.join(e, PAGE, "left")
    fit = F.filter("edges", lambda c: c["x"] - tolerance <= F.col("x"))
    return own.withColumn("col", F.when(F.size(fit) > 0, F.element_at(fit, -1)["col"])).drop("edges")


def band_columns(cells: DataFrame, least_rows: int = 3, least_columns: int = 2, share: float = 0.6) -> DataFrame:
    """(artifact_id, page, rows, columns) of what is a table: rows enough, and columns that most rows fill."""
    n = cells.groupBy(*PAGE).agg(F.count_distinct("row").alias("rows"))
    filled = cells.where(F.col("col").isNotNull()).groupBy(*PAGE, "col").agg(F.count_distinct("row").alias("filled")).join(n, PAGE).where(F.col("filled") >= F.col("rows") * share)
    return filled.groupBy(*PAGE).agg(F.first("rows").alias("rows"), F.count("*").alias("columns")).where((F.col("rows") >= least_rows) & (F.col("columns") >= least_columns))


def as_ranges(numbers: DataFrame, by: list[str], value: str) -> DataFrame:
    """Integers of each group as ranges such as `1-3, 7`."""
    own = numbers.select(*by, F.col(value).cast("long").alias("v")).distinct()
    order = Window.partitionBy(*by).orderBy("v")
    isles = own.withColumn("island", F.col("v") - F.row_number().over(order)).groupBy(*by, "island").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    part = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    return isles.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", part.alias("p")))), lambda x: x["p"]), ", ").alias("ranges"))
