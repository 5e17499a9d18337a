"""Line dedup by a suffix array over line ids, built by prefix doubling in DataFrame operations only.

The corpus is a sequence of line ids, a document's end being a border. Suffixes are ranked by their first line, then by
their first 2, 4, 8, ... lines; a rank is an order-keeping id of a class of suffixes with that common prefix. A suffix
whose prefix occurs once leaves the array, since it starts no longer repeat. A longest-common-prefix interval of depth L
is a class of suffixes that share L lines; two ranks of overlapping powers of two name it for any L. Of every interval
deep enough to hold `min_words` words, the first suffix in text order stays and the others are later copies; what
later copies cover, merged, are the maximal repeated runs, and these lines are deleted.

Doubling stops at the depth where the words are reached, because deeper intervals delete nothing more: a later copy of
a longer run is covered by later copies of its shortest stretches of `min_words` words, ending or beginning at each line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD, Scratch, column, perhaps_among, unused, word_count

DOC = ["d_id", "d_h"]
LEAST = -(1 << 63)
#: Columns that `dedup_lines` adds.
ADDED = ("n_lines", "n_removed", "n_words", "n_words_left")


def with_key(docs: DataFrame) -> DataFrame:
    """A document is its id and text; a null id sorts first."""
    return docs.withColumn("d_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn("d_h", F.xxhash64("text"))


def ranked(classes: DataFrame, *cols: str) -> DataFrame:
    """Ranks in the order of `cols`, which are distinct: a range sort, whose partition and row make the id."""
    return classes.orderBy(*cols).withColumn("rank", F.monotonically_increasing_id())


def stretches(active: DataFrame, min_words: int) -> DataFrame:
    """(document, start, len) of the shortest stretches of `min_words` words that begin or end at a line, all its lines occurring elsewhere."""
    in_doc = Window.partitionBy(*DOC).orderBy("line_no")
    runs = active.withColumn("run", F.col("line_no") - F.row_number().over(in_doc))
    in_run = Window.partitionBy(*DOC, "run").orderBy("line_no")
    c0 = F.coalesce(F.sum("words").over(in_run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("c0", c0).withColumn("last", F.lead("line_no").over(in_run).isNull())
    here = F.struct(F.col("line_no").alias("at"), F.col("c0").alias("before"))
    after = F.struct((F.col("line_no") + 1).alias("at"), (F.col("c0") + F.col("words")).alias("before"))
    marks = runs.select(*DOC, "run", F.inline(F.when(F.col("last"), F.array(here, after)).otherwise(F.array(here))))
    own = Window.partitionBy(*DOC, "run")
    stop = F.min("at").over(own.orderBy(F.col("before").desc()).rangeBetween(Window.unboundedPreceding, -min_words))
    begin = F.max("at").over(own.orderBy(F.col("before").asc()).rangeBetween(Window.unboundedPreceding, -min_words))
    marks = marks.withColumn("stop", stop).withColumn("begin", begin)
    span = lambda a, b: F.struct(a.alias("start"), (b - a).alias("len"))
    both = F.array_distinct(F.array(F.when(F.col("stop").isNotNull(), span(F.col("at"), F.col("stop"))), F.when(F.col("begin").isNotNull(), span(F.col("begin"), F.col("at")))))
    out = marks.select(*DOC, F.inline(F.filter(both, lambda x: x.isNotNull())))
    return out.withColumn("k", F.floor(F.log2(F.col("len").cast("double")) + F.lit(1e-9)).cast("int")).distinct()


def later_copies(spark: SparkSession, docs: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(document, first, stop): the maximal runs of lines to delete, from line `first` to before `stop`."""
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = with_key(docs.where(F.col("text").isNotNull()).select("doc_id", "text")).select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = F.regexp_count("line", F.lit(WORD)).cast("long")
    lines = scratch.put(lines.select(*DOC, "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("#"), "line").alias("h2"), words.alias("words")))
    repeated = scratch.put(ranked(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "h1", "h2"))
    # Rows that repeat a document, id and text, are one document here.
    level = lines.join(repeated, ["h1", "h2"]).select(*DOC, "line_no", "words", "rank")
    level = scratch.put(level.repartition(n_parts, *DOC).dropDuplicates([*DOC, "line_no"]))
    scratch.drop(lines, repeated)
    spans = scratch.put(stretches(level, min_words))
    deepest = spans.agg(F.max("k")).first()[0]
    named, k = None, 0
    while deepest is not None:
        a = level.select(*DOC, F.col("line_no").alias("start"), F.col("rank").alias("a"))
        b = level.select(*DOC, F.col("line_no").alias("tail"), F.col("rank").alias("b"))
        own = spans.where(F.col("k") == k).join(a, [*DOC, "start"]).withColumn("tail", F.col("start") + F.col("len") - (1 << k)).join(b, [*DOC, "tail"])
        own = scratch.put(own.select(*DOC, "start", "len", "a", "b"))
        named = own if named is None else named.union(own)
        if k == deepest:
            break
        ahead = Window.partitionBy(*DOC).orderBy("line_no").rangeBetween(1 << k, 1 << k)
        pairs = scratch.put(level.select(*DOC, "line_no", "rank", F.max("rank").over(ahead).alias("next")).where("next is not null"))
        classes = scratch.put(ranked(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")).where("n > 1").drop("n").withColumnRenamed("rank", "head"), "head", "next"))
        level = scratch.put(pairs.withColumnRenamed("rank", "head").join(classes, ["head", "next"]).select(*DOC, "line_no", "rank"))
        scratch.drop(pairs, classes)
        k += 1
    if named is None:
        return spark.createDataFrame([], "d_id long, d_h long, first int, stop int")
    interval = ["len", "a", "b"]
    place = F.struct(*DOC, "start")
    firsts = scratch.put(named.groupBy(*interval).agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = named.join(firsts, interval).where(place > F.col("origin")).select(*DOC, F.col("start").alias("first"), (F.col("start") + F.col("len")).alias("stop"))
    order = Window.partitionBy(*DOC).orderBy("first", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return scratch.put(islands.groupBy(*DOC, "island").agg(F.min("first").alias("first"), F.max("stop").alias("stop")).drop("island"))


def dedup_lines(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, min_words: int = 50) -> DataFrame:
    """`docs` with text shortened, and n_lines, n_removed (lines), n_words (of the distinct lines that were there) and
    n_words_left (of the text that remains) added: every row comes back, all its other columns kept.

    Lines end at LF and compare as they are. A run of consecutive lines with at least `min_words` words that occurred
    before, in order of (doc_id, line), is deleted; shorter repeats stay, such as a licence line. Blank lines belong
    to runs and hold no words. Null texts stay null with 0 lines; an empty text has one line. Null ids come first.
    Rows that repeat both id and text are one document, and each is treated like it. A text may become empty.
    Columns of `docs` with the names of the added ones, in whatever case, are replaced by them; no other name clashes
    with what is used inside. Only texts that may lose lines are shuffled; a filter of a fixed size
    finds them, for which `docs` is read twice.
    """
    within = scratch.within("runs")
    runs = scratch.put(later_copies(spark, docs, within, min_words))
    within.clear()
    p = unused("lathe_", docs)
    cut = runs.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias(f"{p}cut")).withColumnsRenamed({"d_id": f"{p}id", "d_h": f"{p}h"})
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    own = docs.select(*map(column, keep), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias(f"{p}d"), F.xxhash64("text").alias(f"{p}x"))
    own, may_lose = perhaps_among(own, F.xxhash64(f"{p}d", f"{p}x"), runs, F.xxhash64(*DOC))
    hit = own.where(may_lose).join(cut, (F.col(f"{p}d") == F.col(f"{p}id")) & (F.col(f"{p}x") == F.col(f"{p}h")), "left")
    at = F.col(f"{p}cut")
    lines = F.split("text", "\n", -1)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    removed = F.aggregate(at, F.lit(0), lambda s, x: s + x["stop"] - x["first"])
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x["stop"]))
    stops = F.concat(F.transform(at, lambda x: x["first"]), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda z: F.slice(lines, z["a"] + 1, z["b"] - z["a"])))
    # A column of its own, so that the text is put together once for all that is made of it.
    hit = hit.withColumn(f"{p}text", F.when(at.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    text = F.col(f"{p}text")
    words = word_count(F.array_join(F.array_distinct(lines), "\n"))
    cut_rows = hit.select(*[text.alias(c) if c.lower() == "text" else column(c) for c in keep], n, F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"), words.alias("n_words"), word_count(text).alias("n_words_left"))
    same = own.where(~may_lose).select(*map(column, keep), n, F.lit(0).cast("long").alias("n_removed"), words.alias("n_words"), word_count(F.col("text")).alias("n_words_left"))
    return same.union(cut_rows)


def keep_rest(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, min_words: int = 50, most_removed: int = 80) -> DataFrame:
    """The documents without repeated runs of lines: the columns of `docs`, n_chars following the text.

    A document of whose distinct lines at least `most_removed` percent of the words are gone says little new: it is a
    copy, or a near-copy of which loose lines are left, and goes as a whole; a text that only repeats itself stays.
    Null texts and texts without words stay. Else as `dedup_lines`.
    """
    # Columns with the names of the added ones are put aside meanwhile.
    aside = {c: f"{unused('lathe_', docs)}{i}" for i, c in enumerate(docs.columns) if c.lower() in ADDED}
    out = dedup_lines(spark, docs.select(*[column(c).alias(aside.get(c, c)) for c in docs.columns]), scratch, min_words=min_words)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_words") == 0) | (100 * F.col("n_words_left") > (100 - most_removed) * F.col("n_words")))
    return out.select(*[F.length("text").cast(t).alias(c) if c.lower() == "n_chars" else column(aside.get(c, c)).alias(c) for c, t in docs.dtypes])
