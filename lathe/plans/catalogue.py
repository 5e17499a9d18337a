"""The query catalogue of the engine: one named query an operator, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import blocks, cells, columnar, commands, html, masking
from ..functions import text as T
from ..functions.masking import DUCK_ANY, duck_mask
from ..functions.text import duck_re
from ..operators import layout, pipeline, reduce, store, tables, templates
from ..sources import formats
from ..sources.tables import LOG_SQL, log_artifacts, log_lines, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def lit(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def value_sql(s: str | None) -> str:
    return "NULL" if s is None else lit(s)


def rank_sql(line: str) -> str:
    apart = f"regexp_replace({line}, '([a-z])([A-Z])', '\\1 \\2', 'g')"
    return "CASE " + " ".join(f"WHEN regexp_matches({apart}, {lit(duck_re(p))}) THEN {r}" for r, p in T.RANKS) + " ELSE 0 END"


def kind_sql(t: str) -> str:
    case = " ".join("WHEN " + " OR ".join(f"regexp_matches({f'left({t}, {T.HEAD})' if head else t}, {lit(duck_re(p))})" for p, head in signs) + f" THEN '{k}'" for k, signs in T.KINDS)
    return f"CASE WHEN regexp_matches({t}, '^\\s*[\\[{{]') AND json_valid({t}) THEN 'json' {case} ELSE 'log' END"


def head_tail_sql(t: str, budget: str) -> str:
    half = f"greatest(200, CAST(floor(({budget} - 60) / 2) AS INT))"
    return f"CASE WHEN length({t}) <= {budget} THEN {t} ELSE left({t}, {half}) || chr(10) || chr(10) || '…[compressed: ' || (length({t}) - 2 * {half}) || ' chars omitted from the middle]…' || chr(10) || chr(10) || right({t}, {half}) END"


def unify_sql(t: str) -> str:
    return f"replace(coalesce({t}, ''), chr(13) || chr(10), chr(10))"


def lines_sql(t: str) -> str:
    u = unify_sql(t)
    return f"CASE WHEN {u} = '' THEN [] ELSE string_split(CASE WHEN ends_with({u}, chr(10)) THEN left({u}, length({u}) - 1) ELSE {u} END, chr(10)) END"


DOC_LINES = f"dl AS (SELECT doc_id, unnest({lines_sql('text')}) AS line, unnest(range(len({lines_sql('text')}))) AS i FROM documents)"


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))


# Classification and lines


@query(f"SELECT kind, count(*) AS n FROM (SELECT {kind_sql('text')} AS kind FROM documents UNION ALL SELECT {kind_sql('text')} FROM conversations UNION ALL SELECT {kind_sql('html')} FROM pages UNION ALL SELECT {kind_sql('props')} FROM events) GROUP BY kind")
def detect_kind(spark: SparkSession, sf: str) -> DataFrame:
    texts = [read(spark, sf, n).select(F.col(c).alias("t")) for n, c in (("documents", "text"), ("conversations", "text"), ("pages", "html"), ("events", "props"))]
    every = texts[0].union(texts[1]).union(texts[2]).union(texts[3])
    return every.select(T.detect_kind(F.col("t")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def all_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all documents and logs."""
    return doc_lines(spark, sf).select("line").union(log_lines(spark, sf).select("line"))


ALL_LINES = f"{LOG_SQL}, {DOC_LINES}, every AS (SELECT line FROM dl UNION ALL SELECT line FROM log)"


@query(f"WITH {ALL_LINES} SELECT {rank_sql('line')} AS rank, count(*) AS n FROM every GROUP BY 1")
def line_rank_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return all_lines(spark, sf).select(T.rank(F.col("line")).alias("rank")).groupBy("rank").agg(F.count("*").alias("n"))


SALIENT_SQL = f"regexp_matches(line, {lit(duck_re(T.SALIENT))})"
NOISE_SQL = f"regexp_matches(line, {lit(duck_re(T.NOISE))})"


@query(f"WITH {LOG_SQL} SELECT artifact_id, line_no, line, {rank_sql('line')} AS rank FROM log WHERE {SALIENT_SQL} AND NOT {NOISE_SQL}")
def salient_lines(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line")
    return log_lines(spark, sf).where(T.is_salient(line) & ~T.is_noise(line)).withColumn("rank", T.rank(line))


@query(f"WITH {ALL_LINES} SELECT {rank_sql('line')} > 0 AS interesting, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM every GROUP BY 1")
def interesting_lines(spark: SparkSession, sf: str) -> DataFrame:
    return all_lines(spark, sf).select(T.is_interesting(F.col("line")).alias("interesting"), "line").groupBy("interesting").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("SELECT doc_id, coalesce(text, '') AS restored FROM documents")
def line_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.join_lines(T.line_set(F.col("text"))).alias("restored"))


@query(f"WITH {DOC_LINES} SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS restored FROM dl GROUP BY 1")
def unfold_runs(spark: SparkSession, sf: str) -> DataFrame:
    ls = read(spark, sf, "documents").select("doc_id", T.lines(F.col("text")).alias("ls")).where(F.size("ls") > 0)
    return ls.select("doc_id", F.array_join(columnar.unfold(columnar.runs(F.col("ls"))), "\n").alias("restored"))


@query(f"WITH {DOC_LINES}, c AS (SELECT *, CASE WHEN line IS NOT DISTINCT FROM lag(line) OVER (PARTITION BY doc_id ORDER BY i) AND i > 0 THEN 0 ELSE 1 END AS new FROM dl), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) SELECT doc_id, min(i) AS first, any_value(line) AS line, count(*) AS n FROM r GROUP BY doc_id, run HAVING count(*) > 1")
def fold_runs(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("i")
    r = doc_lines(spark, sf).withColumn("new", (~F.col("line").eqNullSafe(F.lag("line").over(order)) | (F.col("i") == 0)).cast("int"))
    r = r.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return r.groupBy("doc_id", "run").agg(F.min("i").cast("long").alias("first"), F.min("line").alias("line"), F.count("*").alias("n")).where("n > 1").drop("run")


TOKENS_SQL = "(SELECT coalesce(list_sum(list_transform(regexp_extract_all(t, '[A-Za-z0-9_]+'), lambda w: greatest(1, CAST(ceil(length(w) / 4.0) AS BIGINT)))), 0)) + len(regexp_extract_all(t, '[^A-Za-z0-9_\\s]')) + len(regexp_extract_all(t, '\\n'))"


@query(f"SELECT doc_id, CAST({TOKENS_SQL} AS BIGINT) AS tokens, CAST(greatest(200, floor(CAST({TOKENS_SQL} AS DOUBLE) * CAST(3.6 AS DOUBLE) + 0.5)) AS BIGINT) AS chars FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
    return d.withColumn("chars", T.chars_for_tokens(F.col("tokens")).cast("long"))


@query("SELECT CAST(range AS BIGINT) AS tokens, CAST(greatest(200, floor(CAST(range AS DOUBLE) * CAST(3.6 AS DOUBLE) + 0.5)) AS BIGINT) AS chars FROM range(0, 2000)")
def chars_for_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(2000).select(F.col("id").alias("tokens"), T.chars_for_tokens(F.col("id")).cast("long").alias("chars"))


@query(f"SELECT doc_id, {head_tail_sql('text', '1000')} AS reduced FROM documents")
def head_tail(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", T.head_tail(F.col("text"), 1000).alias("reduced"))


# A command a hook's payload, and what is expected of it: the kind and the nature of its output, none for the quiet ones.
COMMANDS = [
    ('{"tool_input":{"command":"npm run test"}}', "test", "a test suite"), ('{"input":{"command":"node --test x.mjs"}}', "test", "a test run"), ('{"command":"cargo  test --all"}', "test", "a test run"),
    ('{"toolInput":{"command":"pnpm install left-pad"}}', "log", "an install log"), ('{"params":{"command":"cargo build"}}', "log", "a build log"), ('{"arguments":{"command":"npm run build"}}', "log", "a build log"),
    ('{"command":"git diff HEAD~3"}', "diff", "git output that is often long"), ('{"tool_input":{"script":"kubectl logs web-1"}}', "log", "container logs"), ('{"input":{"script":"cat /var/log/app.log"}}', None, "a file that may be large"),
    ('{"command":"curl -s https://example.com/a"}', "json", "a network response"), ('{"command":"ls -laR /"}', None, "a recursive listing"), ('{"command":"ls -la"}', None, None), ('{"command":"pytest -q"}', None, None), ('{"command":"make > /dev/null"}', None, None),
    ('{"command":"npm ci --silent"}', None, None), ('{"tool_input":{"command":" "},"command":"git show x"}', "diff", "git output that is often long"), ('{"other":1}', None, None), ('{"command":"git status"}', None, None), ('{"command":"echo latest"}', None, None),
]


@query(f"SELECT o_orderkey, x.kind, x.why FROM orders JOIN (VALUES {', '.join(f'({i}, {value_sql(k)}, {value_sql(w)})' for i, (_, k, w) in enumerate(COMMANDS))}) x(i, kind, why) ON o_orderkey % {len(COMMANDS)} = x.i")
def command_advice(spark: SparkSession, sf: str) -> DataFrame:
    payload = F.element_at(F.array(*[F.lit(c) for c, _, _ in COMMANDS]), (F.col("o_orderkey") % len(COMMANDS) + 1).cast("int"))
    a = read(spark, sf, "orders").select("o_orderkey", commands.advice(commands.command_of(payload)).alias("a"))
    return a.select("o_orderkey", "a.kind", "a.why")


# Masking and templates


def masked_sql(source: str = "log") -> str:
    template, values = duck_mask("line")
    return f"m AS (SELECT *, {template} AS template, {values} AS vals FROM {source})"


def key_sql(t: str = "template") -> str:
    anchors = f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda x: x <> '' AND NOT regexp_full_match(x, '{masking.SLOT}'))[1:3]"
    return f"len(regexp_split_to_array({t}, '\\s+')) || chr(1) || array_to_string({anchors}, chr(1))"


@query(f"WITH {LOG_SQL}, {masked_sql()}, k AS (SELECT *, {key_sql()} AS key FROM m) SELECT arg_min(template, event_id) AS template, count(*) AS uses, min(event_id) AS first_line, CAST(sum(length(line)) - sum(list_sum(list_transform(vals, lambda v: length(v) + 1))) AS BIGINT) AS chars_saved FROM k GROUP BY key HAVING count(*) >= 3")
def mask_templates(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.tables import event_line

    e = read(spark, sf, "events").select(F.lit(0).alias("artifact_id"), F.col("event_id").alias("line_no"), event_line().alias("line"))
    m = templates.masked(e)
    spent = F.aggregate("values", F.lit(0), lambda n, v: n + F.length(v) + 1)
    own = m.groupBy("key").agg(F.min_by("template", "line_no").alias("template"), F.count("*").alias("uses"), F.min("line_no").alias("first_line"), (F.sum(F.length("line")) - F.sum(spent)).alias("chars_saved"))
    return own.where(F.col("uses") >= templates.MIN_USES).drop("key")


@query(f"WITH {LOG_SQL}, {masked_sql()} SELECT artifact_id, line_no, template, CAST(len(vals) AS INT) AS slots, {key_sql().replace('chr(1)', 'chr(1)')} AS key, line AS restored FROM m")
def mask_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(log_lines(spark, sf))
    key = F.replace(F.col("key"), F.lit(masking.KEY_SEP), F.lit("\x01"))
    return m.select("artifact_id", "line_no", "template", masking.slot_count(F.col("template")).alias("slots"), key.alias("key"), masking.unmask(F.col("template"), F.col("values")).alias("restored"))


MINED = f"{LOG_SQL}, {masked_sql()}, k AS (SELECT *, {key_sql()} AS key FROM m), t0 AS (SELECT artifact_id, key, arg_min(template, line_no) AS rep, count(*) AS uses, min(line_no) AS first FROM k GROUP BY 1, 2 HAVING count(*) >= 3), t AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY first) AS id FROM t0)"
CELL_SQL = "CASE WHEN regexp_matches(v, '[,\"\\n\\r]') OR v IN ('', 'true', 'false', '∅') OR regexp_full_match(v, '-?\\d+(\\.\\d+)?') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END"
ROW_SQL = f"CASE WHEN t.id IS NULL THEN k.line WHEN len(k.vals) = 0 THEN 'T' || t.id ELSE 'T' || t.id || ' ' || array_to_string(list_transform(k.vals, lambda v: {CELL_SQL}), ',') END"
EXACT = f"t.rep = k.template OR len(regexp_extract_all(t.rep, '{masking.SLOT}')) = len(k.vals) AND array_to_string(list_transform(list_zip(regexp_split_to_array(t.rep, '{masking.SLOT}'), k.vals), lambda z: z[1] || coalesce(z[2], '')), '') = k.line"
ROWS = f"{MINED}, r AS (SELECT k.artifact_id, k.line_no, {ROW_SQL} AS row FROM k LEFT JOIN t ON k.artifact_id = t.artifact_id AND k.key = t.key AND ({EXACT}))"


@query(f"WITH {ROWS}, h AS (SELECT artifact_id, string_agg('T' || id || '  ' || rep, chr(10) ORDER BY id) AS header FROM t GROUP BY 1), b AS (SELECT artifact_id, string_agg(row, chr(10) ORDER BY line_no) AS body FROM r GROUP BY 1) SELECT artifact_id, header || chr(10) || '---' || chr(10) || body AS row_form FROM h JOIN b USING (artifact_id)")
def template_rows_render(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(log_lines(spark, sf))
    return templates.render_rows(m, templates.mine(m))


@query(f"WITH {MINED} SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM k WHERE artifact_id IN (SELECT artifact_id FROM t) GROUP BY 1")
def template_rows_expand(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(log_lines(spark, sf))
    return templates.expand_rows(templates.render_rows(m, templates.mine(m)))


@query(f"WITH {MINED} SELECT artifact_id, line_no, line FROM k WHERE artifact_id IN (SELECT artifact_id FROM t)")
def template_columns_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(log_lines(spark, sf))
    return templates.expand_columns(templates.render_columns(m, templates.mine(m)))


@query(f"WITH {MINED}, x AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM log GROUP BY 1), n AS (SELECT artifact_id, count(*) AS templates_found FROM t GROUP BY 1) SELECT x.artifact_id, templates_found, text AS restored FROM x LEFT JOIN n ON x.artifact_id = n.artifact_id AND length(text) > 500")
def log_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Whichever form was chosen gives the text back."""
    out = templates.log_templates(log_artifacts(spark, sf, 1500)).select("artifact_id", "text", "form", "templates_found", "rendered")
    by_row = templates.expand_rows(out.where("form = 'rows'").select("artifact_id", F.col("rendered").alias("row_form")))
    cells_back = templates.expand_columns(out.where("form = 'columns'").select("artifact_id", F.col("rendered").alias("column_form")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    by_column = cells_back.groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
    back = by_row.union(by_column.select("artifact_id", "text")).withColumnRenamed("text", "back")
    return out.join(back, "artifact_id", "left").select("artifact_id", "templates_found", F.when(F.col("form").isNull(), F.col("text")).otherwise(F.col("back")).alias("restored"))


@query(f"WITH {LOG_SQL}, x AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM log GROUP BY 1) SELECT artifact_id, length(text) > 1500 AS long, true AS shorter FROM x WHERE length(text) > 1500")
def log_templates_shrink(spark: SparkSession, sf: str) -> DataFrame:
    out = templates.log_templates(log_artifacts(spark, sf, 1500)).where("length(text) > 1500")
    return out.select("artifact_id", (F.length("text") > 1500).alias("long"), F.coalesce(F.length("rendered") < F.length("text"), F.lit(False)).alias("shorter"))


def flagged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Logs in which every fifth line has a failure among its values."""
    note = F.when(F.col("line_no") % 5 == 0, ' note="request failed"').otherwise(' note="fine"')
    return log_lines(spark, sf).withColumn("line", F.concat("line", note))


FLAGGED = LOG_SQL.replace("log AS (", "log0 AS (", 1) + """, log AS (SELECT artifact_id, line_no, event_id, line || CASE WHEN line_no % 5 = 0 THEN ' note="request failed"' ELSE ' note="fine"' END AS line FROM log0)"""


def fitted_sql(available: int) -> str:
    """Rows with rank and size (x), those of rank above 0 that fit (u), and the ordinary ones in turns (q)."""
    return f"""{ROWS.replace(LOG_SQL, FLAGGED)}, x AS (SELECT artifact_id, line_no, row, {rank_sql('row')} AS rank, length(row) + 1 AS size FROM r),
u0 AS (SELECT *, sum(size) OVER (PARTITION BY artifact_id ORDER BY rank DESC, line_no ROWS UNBOUNDED PRECEDING) AS used FROM x WHERE rank > 0),
u AS (SELECT artifact_id, line_no, used FROM u0 WHERE used <= {available}),
p AS (SELECT artifact_id, line_no, size, coalesce(nullif(regexp_extract(row, '^[TV](\\d+)', 1), ''), '?') AS tid FROM x WHERE rank = 0),
w AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, tid ORDER BY line_no) AS turn, min(line_no) OVER (PARTITION BY artifact_id, tid) AS since FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY turn, since, line_no) AS k FROM w)"""


def template_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = templates.masked(flagged_lines(spark, sf))
    return templates.placed(m, templates.mine(m)).select("artifact_id", "line_no", templates.row_line(F.col("values"), F.col("template_id"), F.col("line")).alias("row"))


@query(f"WITH {fitted_sql(300)} SELECT artifact_id, line_no FROM u")
def template_rows_budget(spark: SparkSession, sf: str) -> DataFrame:
    return templates.fit_rows(template_rows(spark, sf).where(T.rank(F.col("row")) > 0), 300)


@query(f"""WITH RECURSIVE {fitted_sql(900)}, f AS (
  SELECT DISTINCT q.artifact_id, CAST(0 AS BIGINT) AS k, CAST(coalesce(s.spent, 0) AS BIGINT) AS used, CAST([] AS BIGINT[]) AS shut, CAST(NULL AS BIGINT) AS took
  FROM q LEFT JOIN (SELECT artifact_id, max(used) AS spent FROM u GROUP BY 1) s ON q.artifact_id = s.artifact_id
  UNION ALL
  SELECT f.artifact_id, q.k, CASE WHEN NOT list_contains(f.shut, q.since) AND f.used + q.size <= 900 THEN f.used + q.size ELSE f.used END,
         CASE WHEN f.used + q.size > 900 THEN list_append(f.shut, q.since) ELSE f.shut END,
         CASE WHEN NOT list_contains(f.shut, q.since) AND f.used + q.size <= 900 THEN q.line_no END
  FROM f JOIN q ON q.artifact_id = f.artifact_id AND q.k = f.k + 1)
SELECT artifact_id, line_no FROM u UNION ALL SELECT artifact_id, took FROM f WHERE took IS NOT NULL""")
def template_rows_fair(spark: SparkSession, sf: str) -> DataFrame:
    return templates.fit_rows(template_rows(spark, sf), 900)


# Column encodings


def per_order(spark: SparkSession, sf: str, value: str) -> DataFrame:
    return read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col(value).cast("string").alias("v")))), lambda x: x["v"]).alias("a"))


def per_order_sql(value: str) -> str:
    return f"o AS (SELECT l_orderkey, list(CAST({value} AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey, CAST({value} AS VARCHAR)) AS a FROM lineitem GROUP BY 1)"


DELTA_SQL = "array_to_string([a[1]] || list_transform(range(2, len(a) + 1), lambda i: CASE WHEN CAST(a[i] AS BIGINT) >= CAST(a[i - 1] AS BIGINT) THEN '+' ELSE '' END || (CAST(a[i] AS BIGINT) - CAST(a[i - 1] AS BIGINT))), ' ')"
UNIQUE = "list_filter(a, lambda x, i: list_position(a, x) = i)"
DICT_SQL = f"CASE WHEN len({UNIQUE}) <= len(a) / 2.0 THEN array_to_string({UNIQUE}, chr(2)) || chr(3) || array_to_string(list_transform(a, lambda v: chr(1) || (list_position({UNIQUE}, v) - 1)), '') END"
STARTS = "list_filter(range(1, len(a) + 1), lambda i: i = 1 OR a[i] IS DISTINCT FROM a[i - 1])"
RUNS_SQL = f"array_to_string(list_transform({STARTS}, lambda i: a[i] || CASE WHEN coalesce(list_min(list_filter({STARTS}, lambda j: j > i)), len(a) + 1) - i > 1 THEN chr(1) || (coalesce(list_min(list_filter({STARTS}, lambda j: j > i)), len(a) + 1) - i) ELSE '' END), chr(2))"


@query(f"WITH {per_order_sql('l_partkey')} SELECT l_orderkey, {DELTA_SQL} AS encoded, array_to_string(a, ',') AS restored FROM o")
def delta_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = per_order(spark, sf, "l_partkey").withColumn("encoded", columnar.encode_delta(F.col("a")))
    return e.select("l_orderkey", "encoded", F.array_join(columnar.decode_delta(F.col("encoded")), ",").alias("restored"))


@query(f"WITH {per_order_sql('l_returnflag')} SELECT l_orderkey, {DICT_SQL} AS encoded, CASE WHEN ({DICT_SQL}) IS NOT NULL THEN array_to_string(a, ',') END AS restored FROM o")
def dict_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = per_order(spark, sf, "l_returnflag").withColumn("encoded", columnar.encode_dict(F.col("a")))
    return e.select("l_orderkey", "encoded", F.array_join(columnar.decode_dict(F.col("encoded")), ",").alias("restored"))


@query(f"WITH {per_order_sql('l_linestatus')} SELECT l_orderkey, {RUNS_SQL} AS encoded, array_to_string(a, ',') AS restored FROM o")
def rle_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = per_order(spark, sf, "l_linestatus").withColumn("encoded", columnar.encode_runs(F.col("a")))
    return e.select("l_orderkey", "encoded", F.array_join(columnar.decode_runs(F.col("encoded")), ",").alias("restored"))


@query(f"WITH {per_order_sql('l_suppkey')} SELECT l_orderkey, array_to_string(a, chr(2)) AS encoded, array_to_string(a, ',') AS restored FROM o")
def verbatim_encode(spark: SparkSession, sf: str) -> DataFrame:
    e = per_order(spark, sf, "l_suppkey").withColumn("encoded", columnar.encode_verbatim(F.col("a")))
    return e.select("l_orderkey", "encoded", F.array_join(columnar.decode_verbatim(F.col("encoded")), ",").alias("restored"))


@query("""WITH o AS (SELECT user_id, list(epoch(date_trunc('second', ts))::BIGINT ORDER BY ts, event_id) AS s, string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), ',' ORDER BY ts, event_id) AS a FROM events GROUP BY 1)
SELECT user_id, 'T||Z' || chr(3) || array_to_string([CAST(s[1] AS VARCHAR)] || list_transform(range(2, len(s) + 1), lambda i: CASE WHEN s[i] >= s[i - 1] THEN '+' ELSE '' END || (s[i] - s[i - 1])), ' ') AS encoded, a AS restored FROM o""")
def stamps_encode(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    a = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", stamp.alias("v")))), lambda x: x["v"])
    e = read(spark, sf, "events").groupBy("user_id").agg(a.alias("a")).withColumn("encoded", columnar.encode_stamps(F.col("a")))
    return e.select("user_id", "encoded", F.array_join(columnar.decode_stamps(F.col("encoded")), ",").alias("restored"))


BEST_SQL = f"""c AS (SELECT l_orderkey, a, array_to_string(a, chr(2)) AS v, {DELTA_SQL} AS d, {DICT_SQL} AS k, {RUNS_SQL} AS r FROM o),
e AS (SELECT *, list_sort([struct_pack(n := length(v), p := 0, name := 'verbatim', t := v)] || CASE WHEN len(a) < 4 THEN [] ELSE [struct_pack(n := length(d), p := 1, name := 'delta', t := d), struct_pack(n := coalesce(length(k), 999999999), p := 2, name := 'dict', t := k), struct_pack(n := length(r), p := 3, name := 'runs', t := r)] END)[1] AS b FROM c)"""


@query(f"WITH {per_order_sql('CAST(l_quantity AS BIGINT)')}, {BEST_SQL} SELECT l_orderkey, b.name AS encoding, b.t AS text, CAST(len(a) AS INT) AS rows, array_to_string(a, ',') AS restored FROM e")
def best_encoding(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").withColumn("q", F.col("l_quantity").cast("long"))
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("q").cast("string").alias("q")))), lambda x: x["q"])
    e = li.groupBy("l_orderkey").agg(a.alias("a")).withColumn("e", columnar.encode_column(F.col("a")))
    return e.select("l_orderkey", "e.encoding", "e.text", "e.rows", F.array_join(columnar.decode_column(F.col("e.encoding"), F.col("e.text")), ",").alias("restored"))


# Tables


RECORD = ["l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate"]


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS DECIMAL(12,2)) AS VARCHAR), l_returnflag, strftime(l_shipdate, '%Y-%m-%d')] AS c FROM lineitem)
SELECT l_orderkey, '{",".join(RECORD)}' || chr(10) || string_agg(array_to_string(list_transform(c, lambda v: {CELL_SQL}), ','), chr(10) ORDER BY l_linenumber, array_to_string(list_transform(c, lambda v: {CELL_SQL}), ',')) AS "table", count(*) AS rows FROM s GROUP BY 1""")
def record_table(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_quantity").cast("decimal(12,2)").cast("string").alias("l_quantity"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    return tables.record_table(li, ["l_orderkey"], "k", RECORD)


@query("""WITH k AS (SELECT o_custkey AS g, 'o_orderkey' AS key FROM orders UNION ALL SELECT o_custkey, 'o_comment' FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_custkey, 'o_rare' FROM orders WHERE o_orderkey % 7 = 0 AND o_custkey % 2 = 0),
n AS (SELECT o_custkey AS g, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT k.g, key, count(*) AS c, any_value(n.n) AS n FROM k JOIN n USING (g) GROUP BY 1, 2)
SELECT g, CASE WHEN bool_and(c >= n * 0.6) AND any_value(n) >= 3 THEN array_to_string(list(key ORDER BY c DESC, key), ',') END AS columns FROM c GROUP BY 1""")
def tabulable_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rec = F.to_json(F.struct("o_orderkey", F.when(k % 4 > 0, "c").alias("o_comment"), F.when((k % 7 == 0) & (F.col("o_custkey") % 2 == 0), True).alias("o_rare")))
    text = F.concat(F.lit("["), F.array_join(F.collect_list(rec), ","), F.lit("]"))
    own = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("g")).agg(text.alias("t"))
    return own.select("g", F.array_join(tables.tabulable_columns(F.col("t")), ",").alias("columns"))


def csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A text an order priority and month: a sentence with commas, then comma-separated rows."""
    o = read(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("artifact_id"), F.col("o_orderkey").alias("k"), F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("line"))
    first = o.select("artifact_id").distinct().select("artifact_id", F.lit(-1).cast("long").alias("k"), F.lit("These are the orders of the month, which were many of them").alias("line"))
    order = Window.partitionBy("artifact_id").orderBy("k")
    return o.union(first.select("artifact_id", "k", "line")).select("artifact_id", (F.row_number().over(order) - 1).alias("line_no"), "line")


CSV_SQL = """o AS (SELECT strftime(o_orderdate, '%Y-%m') AS artifact_id, o_orderkey AS k, o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',' || o_custkey AS line FROM orders),
f AS (SELECT DISTINCT artifact_id, -1 AS k, 'These are the orders of the month, which were many of them' AS line FROM o),
csv AS (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY k) - 1 AS line_no, line FROM (SELECT * FROM o UNION ALL SELECT * FROM f))"""


@query(f"WITH {CSV_SQL} SELECT artifact_id, min(line_no) AS first, max(line_no) AS last, count(*) AS rows FROM csv WHERE line NOT LIKE 'These%' GROUP BY 1 HAVING count(*) >= 6")
def dense_table_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.segments(csv_lines(spark, sf)).where("form = 'dense'")
    return s.groupBy("artifact_id", "segment").agg(F.min("line_no").cast("long").alias("first"), F.max("line_no").cast("long").alias("last"), F.count("*").alias("rows")).drop("segment")


def pipe_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows as a piped table with a head and a ruler, an escaped bar in every third row; prose after it."""
    own = csv_lines(spark, sf)
    cells_ = F.split("line", ",")
    row = F.concat(F.lit("| "), F.array_join(F.when(F.col("line_no") % 3 == 0, F.transform(cells_, lambda c: F.concat(c, F.lit("\\|")))).otherwise(cells_), " | "), F.lit(" |"))
    order = F.when(F.col("line_no") == 0, F.array(F.struct(F.lit(0).alias("k"), F.lit("| key | priority | status | customer |").alias("line")), F.struct(F.lit(1).alias("k"), F.lit("| --- | --- | --- | --- |").alias("line")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), row.alias("line"))))
    rows = own.select("artifact_id", F.col("line_no").alias("at"), F.inline(order))
    last = own.groupBy("artifact_id").agg((F.max("line_no") + 1).cast("long").alias("at")).select("artifact_id", "at", F.lit(0).alias("k"), F.lit("After the table | come words.").alias("line"))
    w = Window.partitionBy("artifact_id").orderBy("at", "k")
    return rows.select("artifact_id", F.col("at").cast("long").alias("at"), "k", "line").union(last).select("artifact_id", (F.row_number().over(w) - 1).alias("line_no"), "line")


@query(f"WITH {CSV_SQL}, n AS (SELECT artifact_id, count(*) - 1 AS n FROM csv GROUP BY 1) SELECT artifact_id, CAST(0 AS BIGINT) AS first, CAST(n + 1 AS BIGINT) AS last, CAST(n + 1 AS BIGINT) AS rows FROM n WHERE n + 1 >= 6")
def pipe_table_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = tables.segments(pipe_lines(spark, sf)).where("form = 'pipe'")
    return s.groupBy("artifact_id", "segment").agg(F.min("line_no").cast("long").alias("first"), F.max("line_no").cast("long").alias("last"), F.count_if(~F.col("is_separator")).alias("rows")).drop("segment")


@query(f"WITH {CSV_SQL} SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM csv GROUP BY 1")
def md_tables_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.encode_tables(csv_lines(spark, sf))
    return e.select("artifact_id", tables.decode_tables(F.col("encoded")).alias("text"))


@query(f"WITH s AS (SELECT o_orderkey, [o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 1 THEN 'a,b' WHEN o_orderkey % 5 = 2 THEN 'say \"x\"' ELSE 'true' END] AS c FROM orders) SELECT o_orderkey, array_to_string(list_transform(c, lambda v: {CELL_SQL}), ',') AS row, CAST(list_sum(list_transform(c, lambda v: CASE WHEN v IN ('', 'true', 'false', '∅') OR regexp_full_match(v, '-?\\d+(\\.\\d+)?') THEN 1 ELSE 0 END)) AS INT) AS ambiguous FROM s")
def encode_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    odd = F.when(k == 0, "").when(k == 1, "a,b").when(k == 2, 'say "x"').otherwise("true")
    c = F.array("o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"), odd)
    return read(spark, sf, "orders").select("o_orderkey", cells.encode_row(c).alias("row"), F.aggregate(c, F.lit(0), lambda n, v: n + cells.is_ambiguous(v).cast("int")).alias("ambiguous"))


JSON_SQL = """g AS (SELECT o_custkey, count(*) AS n,
  '{"status":"ok","data":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '","o_custkey":' || o_custkey || '}', ',' ORDER BY o_orderkey) || ']}' AS t,
  '{' || chr(10) || '  "status": "ok",' || chr(10) || '  "data": {' || chr(10) || '    "__table": "o_custkey,o_orderkey,o_orderpriority,o_orderstatus\\n' || string_agg(o_custkey || ',' || o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus, '\\n' ORDER BY o_orderkey) || '",' || chr(10) || '    "__rows": ' || count(*) || chr(10) || '  }' || chr(10) || '}' AS c FROM orders GROUP BY 1)"""


@query(f"WITH {JSON_SQL} SELECT o_custkey, n >= 3 AND (length(t) - length(c)) / length(t) >= 0.15 AS applied, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS tables, CASE WHEN n >= 3 AND (length(t) - length(c)) / length(t) >= 0.15 THEN c ELSE t END AS text FROM g")
def json_compact(spark: SparkSession, sf: str) -> DataFrame:
    rec = F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", "o_custkey"))
    j = read(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.lit("ok").alias("status"), F.array_sort(rec).alias("data"))).alias("t"))
    return j.withColumn("c", tables.compact_json(F.col("t"))).select("o_custkey", "c.applied", "c.tables", "c.text")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, '{' || chr(10) || '  "data": [' || chr(10) || string_agg('    {' || chr(10) || '      "o_orderkey": ' || o_orderkey || ',' || chr(10) || '      "o_orderpriority": "' || o_orderpriority || '"' || chr(10) || '    }', ',' || chr(10) ORDER BY k)
  || CASE WHEN any_value(n) > 3 THEN ',' || chr(10) || '    "…[+' || (any_value(n) - 3) || ' more items]"' ELSE '' END || chr(10) || '  ]' || chr(10) || '}' AS shape FROM k WHERE k <= 3 GROUP BY 1""")
def json_shape_shrink(spark: SparkSession, sf: str) -> DataFrame:
    rec = F.collect_list(F.struct("o_orderkey", "o_orderpriority"))
    j = read(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.array_sort(rec).alias("data"))).alias("t"))
    return j.select("o_custkey", reduce.json_shape(F.col("t")).alias("shape"))


# Reducers


NOTE = "'[compressed: ' || {n} || ' {what}]'"


def texts_sql(make: str, where: str = "true") -> str:
    return f"x AS (SELECT artifact_id, string_agg({make}, chr(10) ORDER BY line_no) AS text, count(*) AS n FROM log WHERE {where} GROUP BY 1)"


def user_texts(spark: SparkSession, sf: str, make: F.Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("line_no", make.alias("v"))))
    return log_lines(spark, sf).groupBy("artifact_id").agg(F.array_join(F.transform(ordered, lambda x: x["v"]), "\n").alias("text")).withColumn("budget", F.lit(900))


DIFF_LINE = "CASE line_no % 4 WHEN 0 THEN '+' || line WHEN 1 THEN '-' || line WHEN 2 THEN ' ' || line ELSE '@@ ' || line END"


@query(f"WITH {LOG_SQL}, l AS (SELECT artifact_id, line_no, {DIFF_LINE} AS v FROM log), y AS (SELECT artifact_id, count(*) FILTER (line_no % 4 = 2) AS gone, string_agg(CASE WHEN line_no % 4 <> 2 THEN v END, chr(10) ORDER BY line_no) AS kept FROM l GROUP BY 1), z AS (SELECT artifact_id, CASE WHEN gone > 0 THEN {NOTE.format(n='gone', what='unchanged context lines omitted')} || CASE WHEN kept IS NULL THEN '' ELSE chr(10) || kept END ELSE kept END AS t FROM y) SELECT artifact_id, {head_tail_sql('t', '900')} AS reduced FROM z")
def reduce_diff(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line_no") % 4
    v = F.concat(F.when(k == 0, "+").when(k == 1, "-").when(k == 2, " ").otherwise("@@ "), "line")
    return user_texts(spark, sf, v).select("artifact_id", reduce.shrink_diff(F.col("text"), F.col("budget")).alias("reduced"))


@query(f"WITH {LOG_SQL}, l AS (SELECT artifact_id, line_no, '    at f' || line_no || CASE line_no % 3 WHEN 0 THEN ' (/app/src/a.js:1:2)' WHEN 1 THEN ' (node:internal/x:1:2)' ELSE ' (/app/node_modules/y/z.js:1:2)' END AS v FROM log), y AS (SELECT artifact_id, count(*) FILTER (line_no % 3 <> 0) AS gone, string_agg(CASE WHEN line_no % 3 = 0 THEN v END, chr(10) ORDER BY line_no) AS kept FROM l GROUP BY 1), z AS (SELECT artifact_id, kept || CASE WHEN gone > 0 THEN chr(10) || {NOTE.format(n='gone', what='library/internal frames omitted')} ELSE '' END AS t FROM y) SELECT artifact_id, {head_tail_sql('t', '900')} AS reduced FROM z")
def reduce_stack(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("line_no") % 3
    v = F.concat(F.lit("    at f"), F.col("line_no").cast("string"), F.when(k == 0, " (/app/src/a.js:1:2)").when(k == 1, " (node:internal/x:1:2)").otherwise(" (/app/node_modules/y/z.js:1:2)"))
    return user_texts(spark, sf, v).select("artifact_id", reduce.shrink_stacktrace(F.col("text"), F.col("budget")).alias("reduced"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT artifact_id, line_no, line, {SALIENT_SQL} AND NOT {NOISE_SQL} AS sal, row_number() OVER (PARTITION BY artifact_id ORDER BY line_no DESC) AS back FROM log),
f AS (SELECT *, sum(CASE WHEN sal THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id ORDER BY line_no) AS k FROM s),
g AS (SELECT artifact_id, count(*) AS n, string_agg(line, chr(10) ORDER BY line_no) AS body, string_agg(CASE WHEN sal AND k <= 200 THEN line END, chr(10) ORDER BY line_no) AS block, string_agg(CASE WHEN back <= 40 THEN line END, chr(10) ORDER BY line_no) AS tail FROM f GROUP BY 1)
SELECT artifact_id, CASE WHEN length(body) <= 900 THEN body WHEN block IS NOT NULL AND length(block) <= 675 THEN '[compressed: ' || n || ' lines → salient lines + tail]' || chr(10) || block || chr(10) || chr(10) || '--- tail ---' || chr(10) || right(tail, greatest(900 - length(block) - 80, 0)) ELSE {head_tail_sql('body', '900')} END AS reduced FROM g""")
def reduce_log(spark: SparkSession, sf: str) -> DataFrame:
    return user_texts(spark, sf, F.col("line")).select("artifact_id", reduce.shrink_log(F.col("text"), F.col("budget")).alias("reduced"))


@query(f"""WITH {LOG_SQL}, l AS (SELECT artifact_id, line_no * 2 AS i, CASE WHEN line LIKE '% ERROR %' THEN 'not ok ' ELSE 'ok ' END || line_no || ' - case' AS v FROM log UNION ALL SELECT artifact_id, line_no * 2 + 1, '  detail ' || line_no FROM log),
y AS (SELECT artifact_id, count(*) FILTER (v LIKE 'ok %') AS ok, string_agg(CASE WHEN v LIKE 'not ok%' THEN v END, chr(10)) AS x FROM l GROUP BY 1),
b AS (SELECT *, max(CASE WHEN v LIKE 'ok %' OR v LIKE 'not ok %' THEN i END) OVER (PARTITION BY artifact_id ORDER BY i) AS head FROM l),
k AS (SELECT b.artifact_id, b.i, b.v FROM b JOIN l h ON h.artifact_id = b.artifact_id AND h.i = b.head AND h.v LIKE 'not ok%'),
z AS (SELECT y.artifact_id, CASE WHEN ok > 0 THEN {NOTE.format(n='ok', what='passing lines omitted')} END AS note, (SELECT string_agg(k.v, chr(10) ORDER BY k.i) FROM k WHERE k.artifact_id = y.artifact_id) AS kept FROM y),
w AS (SELECT artifact_id, concat_ws(chr(10), note, kept) AS t FROM z)
SELECT artifact_id, {head_tail_sql('t', '900')} AS reduced FROM w""")
def reduce_test(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.concat(F.when(F.col("line").contains(" ERROR "), "not ok ").otherwise("ok "), F.col("line_no").cast("string"), F.lit(" - case\n  detail "), F.col("line_no").cast("string"))
    return reduce.shrink_tests(user_texts(spark, sf, verdict)).select("artifact_id", "reduced")


# Accounting


@query(f"WITH k AS (SELECT {kind_sql('text')} AS kind, length(text) AS a, length({head_tail_sql('text', '1000')}) AS b FROM documents) SELECT kind, count(*) AS calls, count(*) FILTER (b < a) AS compressed_calls, CAST(sum(a) AS BIGINT) AS chars_in, CAST(sum(b) AS BIGINT) AS chars_out, CAST(sum(a) - sum(b) AS BIGINT) AS chars_saved, round(sum(b) / sum(a), 3) AS ratio FROM k GROUP BY ROLLUP (kind)")
def kind_stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    r = d.select(T.detect_kind(F.col("text")).alias("kind"), F.length("text").alias("original_chars"), F.length(T.head_tail(F.col("text"), 1000)).alias("compressed_chars"))
    return store.kind_stats(r)


@query(f"WITH {LOG_SQL}, x AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text, list(DISTINCT split_part(line, ' ', 2)) AS needles FROM log GROUP BY 1), r AS (SELECT artifact_id, needles, {head_tail_sql('text', '600')} AS t FROM x) SELECT artifact_id, len(needles) = len(list_filter(needles, lambda n: contains(t, n))) AS kept FROM r")
def needle_fidelity(spark: SparkSession, sf: str) -> DataFrame:
    needles = log_lines(spark, sf).groupBy("artifact_id").agg(F.collect_set(F.split_part(F.col("line"), F.lit(" "), F.lit(2))).alias("needles"))
    return log_artifacts(spark, sf).join(needles, "artifact_id").select("artifact_id", store.needles_kept(T.head_tail(F.col("text"), 600), F.col("needles")).alias("kept"))


@query(f"WITH {LOG_SQL}, x AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM log GROUP BY 1), r AS (SELECT artifact_id, unnest(string_split({head_tail_sql('text', '600')}, chr(10))) AS line FROM x) SELECT l.artifact_id, count(*) AS lines, count(*) FILTER (EXISTS (SELECT 1 FROM r WHERE r.artifact_id = l.artifact_id AND r.line = l.line)) AS covered FROM log l GROUP BY 1")
def coverage_at_budget(spark: SparkSession, sf: str) -> DataFrame:
    kept = log_artifacts(spark, sf).select("artifact_id", F.explode(F.split(T.head_tail(F.col("text"), 600), "\n", -1)).alias("line")).distinct().withColumn("hit", F.lit(1))
    return log_lines(spark, sf).join(kept, ["artifact_id", "line"], "left").groupBy("artifact_id").agg(F.count("*").alias("lines"), F.count("hit").alias("covered"))


# HTML


def tag_sql(tag: str) -> str:
    return f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>"


def region_sql() -> str:
    s = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?i)<!doctype[^>]*>', ' ', 'g')"
    body, parts = f"regexp_extract(s, '{tag_sql('body')}', 1)", ""
    for t in ("main", "article"):
        inner = f"regexp_extract(s, '{tag_sql(t)}', 1)"
        parts += f" WHEN length({inner}) > 200 THEN {inner}"
    return f"s AS (SELECT page_id, {s} AS s FROM pages), region AS (SELECT page_id, CASE{parts} WHEN regexp_matches(s, '{tag_sql('body')}') THEN {body} ELSE s END AS r FROM s)"


@query(f"SELECT page_id, regexp_matches(left(html, 4000), '(?i)^\\s*<(?:!doctype html|html|head|body)\\b') OR len(list_distinct(regexp_extract_all(lower(left(html, 4000)), '</?({html.TAGS})\\b', 1))) >= 3 AS is_html FROM pages")
def html_looks_like(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", html.looks_like_html(F.col("html")).alias("is_html"))


@query(f"WITH {region_sql()} SELECT page_id, r AS region FROM region")
def html_main_region(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", html.main_region(html.strip_comments(F.col("html"))).alias("region"))


def dropped_sql(t: str) -> str:
    for tag in html.DROP:
        for _ in range(3):  # no page here is nested deeper
            t = f"regexp_replace({t}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
        t = f"regexp_replace({t}, '(?i)<{tag}\\b[^>]*/?>', ' ', 'g')"
    return t


@query(f"SELECT page_id, {dropped_sql('html')} AS left_over FROM pages")
def html_drop_elements(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", html.drop_elements(F.col("html")).alias("left_over"))


@query("WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a\\s*>')) AS m FROM pages), h AS (SELECT page_id, regexp_extract(m, '(?is)^<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"', 1) AS href, trim(regexp_replace(regexp_replace(m, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS label FROM l) SELECT page_id, CASE WHEN href = '' OR starts_with(href, '#') THEN label WHEN label = '' THEN href ELSE '[' || label || '](' || href || ')' END AS link, count(*) AS n FROM h GROUP BY 1, 2")
def html_links(spark: SparkSession, sf: str) -> DataFrame:
    m = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?</a\s*>"), F.lit(0))).alias("m"))
    return m.select("page_id", html.links(F.col("m")).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


HEADINGS_SQL = " UNION ALL ".join(f"SELECT page_id, CAST({n} AS INT) AS level, '{'#' * n} ' || unnest(regexp_extract_all(html, '(?is)<h{n}\\b[^>]*>\\s*(.*?)\\s*</h{n}\\s*>', 1)) AS heading FROM pages" for n in range(1, 7))


@query(HEADINGS_SQL)
def html_headings(spark: SparkSession, sf: str) -> DataFrame:
    def level(n: int) -> F.Column:
        found = F.regexp_extract_all("html", F.lit(rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>"), F.lit(1))
        return F.transform(found, lambda t: F.struct(F.lit(n).alias("level"), F.concat(F.lit("#" * n + " "), t).alias("heading")))

    return read(spark, sf, "pages").select("page_id", F.inline(F.flatten(F.array(*map(level, range(1, 7))))))


@query("WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<ul\\b[^>]*>.*?</ul\\s*>')) AS b FROM pages), i AS (SELECT page_id, list_transform(regexp_extract_all(b, '(?is)<li\\b[^>]*>(.*?)</li\\s*>', 1), lambda x: '- ' || trim(x)) AS items FROM u) SELECT page_id, chr(10) || chr(10) || array_to_string(items, chr(10)) || chr(10) || chr(10) AS list FROM i")
def html_list_items(spark: SparkSession, sf: str) -> DataFrame:
    u = read(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<ul\b[^>]*>.*?</ul\s*>"), F.lit(0))).alias("b"))
    return u.select("page_id", html.list_markdown(F.col("b"), False).alias("list"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({lit(k)}, {lit('<' + v + '|' + v + '|&' + k + '>')})" for k, v in html.ENTITIES.items()) + ") t(name, decoded)")
def html_named_entities(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.createDataFrame([(k,) for k in html.ENTITIES], "name string")
    return n.select("name", html.decode_entities(F.concat(F.lit("<&"), F.col("name"), F.lit(";|&"), F.upper("name"), F.lit(";|&"), F.col("name"), F.lit(">"))).alias("decoded"))


@query("WITH n AS (SELECT unnest(range(33, 2000)) AS n) SELECT n, chr(CAST(n AS INT)) AS dec_char, chr(CAST(n AS INT)) AS hex_char FROM n")
def html_entities(spark: SparkSession, sf: str) -> DataFrame:
    n = spark.range(33, 2000).select(F.col("id").alias("n"))
    return n.select("n", html.decode_entities(F.concat(F.lit("&#"), F.col("n").cast("string"), F.lit(";"))).alias("dec_char"), html.decode_entities(F.concat(F.lit("&#x"), F.hex("n"), F.lit(";"))).alias("hex_char"))


def markdown_sql() -> str:
    """The given pages' Markdown, step by step: they hold headings, paragraphs, breaks, unclosed tags and entities, and no lists or tables outside what is dropped."""
    t = dropped_sql("r")
    for n in range(6, 0, -1):
        t = f"regexp_replace({t}, '(?is)<h{n}\\b[^>]*>\\s*(.*?)\\s*</h{n}\\s*>', chr(10) || chr(10) || '{'#' * n} \\1' || chr(10) || chr(10), 'g')"
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, '(?i)</p\\s*>', chr(10) || chr(10), 'g'), '(?i)<p\\b[^>]*>', '', 'g'), '(?i)<br\\b[^>]*/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', '', 'g')"
    for k, v in html.ENTITIES.items():
        t = f"replace({t}, '&{k};', {lit(v)})"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"md AS (SELECT region.page_id, regexp_replace({t}, '^\\s+|\\s+$', '', 'g') AS markdown, CASE WHEN length(r) < length(s.s) * 0.6 THEN 'Only the main content region was read; page furniture was skipped.' END AS note FROM region JOIN s ON region.page_id = s.page_id)"


@query(f"WITH {region_sql()}, {markdown_sql()} SELECT page_id, markdown, note FROM md")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", html.to_markdown(F.col("html")).alias("markdown"), html.region_note(F.col("html")).alias("note"))


@query(f"""WITH {region_sql()}, {markdown_sql()}, c AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(markdown, '\\n{{2,}}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS c FROM md),
u AS (SELECT page_id, unnest(range(len(c))) AS ord, unnest(c) AS b FROM c)
SELECT page_id, CAST(ord AS INT) AS ord, CASE WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN 'heading' ELSE 'paragraph' END AS type, CASE WHEN regexp_matches(b, '^#{{1,6}}\\s') THEN CAST(length(regexp_extract(b, '^(#+)', 1)) AS INT) ELSE CAST(0 AS INT) END AS level, CAST(length(b) AS INT) AS chars FROM u""")
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = read(spark, sf, "pages").select("page_id", F.posexplode(blocks.segment(html.to_markdown(F.col("html")))).alias("ord", "b"))
    return b.select("page_id", "ord", "b.type", F.coalesce("b.level", F.lit(0)).alias("level"), F.length(blocks.render_block(F.col("b"))).alias("chars"))


# Document model


def order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    row = F.array(F.col("l_partkey").cast("string"), F.concat(F.lit("a|b, "), "l_returnflag"), F.when(F.col("l_linenumber") % 2 == 0, F.lit('q"q')).otherwise(F.col("l_linestatus")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))), lambda x: x["r"])
    head = F.array(F.lit("part"), F.lit("flag"), F.lit("status"))
    return li.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.array(blocks.block("heading", level=9, text=F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))), blocks.block("table", head=head, rows=F.col("rows"))).alias("b"))


DOC_SQL = "r AS (SELECT l_orderkey, l_linenumber, [CAST(l_partkey AS VARCHAR), 'a|b, ' || l_returnflag, CASE WHEN l_linenumber % 2 = 0 THEN 'q\"q' ELSE l_linestatus END] AS c FROM lineitem)"


@query(f"WITH {DOC_SQL} SELECT l_orderkey, '###### Order ' || l_orderkey || chr(10) || chr(10) || 'part,flag,status' || chr(10) || string_agg(array_to_string(list_transform(c, lambda v: CASE WHEN regexp_matches(v, '[\",]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END), ','), chr(10) ORDER BY l_linenumber, c) AS markdown FROM r GROUP BY 1")
def doc_render_dense(spark: SparkSession, sf: str) -> DataFrame:
    return order_blocks(spark, sf).select("l_orderkey", blocks.render(F.col("b")).alias("markdown"))


@query(f"WITH {DOC_SQL} SELECT l_orderkey, '###### Order ' || l_orderkey || chr(10) || chr(10) || '| part | flag | status |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || array_to_string(list_transform(c, lambda v: replace(v, '|', '\\|')), ' | ') || ' |', chr(10) ORDER BY l_linenumber, c) AS markdown FROM r GROUP BY 1")
def doc_render_pipe(spark: SparkSession, sf: str) -> DataFrame:
    return order_blocks(spark, sf).select("l_orderkey", blocks.render(F.col("b"), mode="preserve").alias("markdown"))


# Pipeline and formats


@query(f"WITH {LOG_SQL}, x AS (SELECT artifact_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM log GROUP BY 1) SELECT artifact_id, {kind_sql('text')} AS kind, CAST(length(text) AS INT) AS original_chars, text AS original, length(text) > 1500 AS changed, CASE WHEN length(text) > 1500 THEN left(sha256(text), 16) END AS retrieval_id, true AS fits FROM x")
def reduce_logs_account(spark: SparkSession, sf: str) -> DataFrame:
    """What a reduced log says of its original, and that it fits: the budget, or the least that templates with all failures take."""
    r = pipeline.reduce_corpus(log_artifacts(spark, sf, 1500))
    fits = (F.col("compressed_chars") <= F.greatest(F.lit(1500 + 200), F.col("original_chars") * 0.6)) | (F.col("text") == F.col("original"))
    return r.select("artifact_id", "kind", "original_chars", "original", (F.col("text") != F.col("original")).alias("changed"), "retrieval_id", fits.alias("fits"))


@query()
def reduce_logs(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.reduce_corpus(log_artifacts(spark, sf, 1500)).drop("text", "original")


@query()
def reduce_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages").select(F.col("page_id").alias("artifact_id"), F.col("html").alias("text"), F.lit(4000).alias("budget"))
    return pipeline.reduce_corpus(pages).drop("text", "original")


MAGIC = {"pdf": "255044462D312E37", "png": "89504E470D0A1A0A", "jpg": "FFD8FFE0", "gif": "474946383961", "webp": "52494646000000005745425000", "bmp": "424D0000", "tif": "49492A00", "office": "D0CF11E0A1B11AE1", "zip": "504B0304", "binary": "410042", "text": "68656C6C6F"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{v}', '{k}')" for k, v in MAGIC.items()) + ") t(bytes, format)")
def magic_format(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in MAGIC.values()], "bytes string").select("bytes", formats.magic_format(F.unhex("bytes")).alias("format"))


@query("SELECT CAST(range AS BIGINT) AS n, CASE WHEN range > 60 THEN strftime(DATE '1970-01-01' + CAST(range - 25569 AS INT), '%Y-%m-%d') END AS day FROM range(0, 60000, 7)")
def excel_serial_date(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(0, 60000, 7).select(F.col("id").alias("n"), formats.serial_date(F.col("id").cast("double")).alias("day"))


@query("SELECT c AS ref, CAST(CASE len(c) WHEN 1 THEN ascii(c) - 65 ELSE (ascii(c) - 64) * 26 + ascii(c[2]) - 65 END AS INT) AS col FROM (SELECT chr(CAST(65 + a AS INT)) AS c FROM range(26) x(a) UNION ALL SELECT chr(CAST(65 + a AS INT)) || chr(CAST(65 + b AS INT)) FROM range(26) x(a), range(26) y(b))")
def excel_column_index(spark: SparkSession, sf: str) -> DataFrame:
    one = spark.range(26).select(F.char(F.col("id") + 65).alias("ref"))
    two = spark.range(676).select(F.concat(F.char(F.floor(F.col("id") / 26) + 65), F.char(F.col("id") % 26 + 65)).alias("ref"))
    return one.union(two).select("ref", formats.column_index(F.col("ref")).alias("col"))


# What the made files hold: name, kind, why not, number of blocks, Markdown.
INGESTED = [
    ("a.docx", "docx", None, 3, "# Report\n\nKept added\n\na,b\n1,2"),
    ("b.xlsx", "xlsx", None, 2, "## Sales\n\nday,units\n2023-03-15,7"),
    ("c.pptx", "pptx", None, 2, "## Plan\n\n- one\n- two"),
    ("d.pdf", "pdf", None, 1, "Hello\nWorld again"),
    ("e.txt", "text", None, 1, "plain\ntext"),
    ("f.html", "html", None, 2, "# Title\n\n" + " ".join(["Some text of the page."] * 12)),
    ("g.png", "png", "ValueError: no text in a png file", 0, ""),
    ("h.doc", "office", "ValueError: an office file of before 2007; save it in the newer format", 0, ""),
    ("i.zip", "zip", "ValueError: an archive, but no office file", 0, ""),
    ("j.bin", "binary", "ValueError: no text in a binary file", 0, ""),
    ("k.pdf", "pdf", "ValueError: the PDF is damaged", 0, ""),
    ("l.docx", "docx", None, 3, 'Before the anchor after.\n\n## Comments\n\n- Ann: on "the anchor": Check this'),
    ("m.pdf", "pdf", None, 2, "e\u0301ßc •\nAB ABA\nHi\nj\n\nitem,units,price\nbolt,7,1.50\nnut,12,0.25\nwasher,,0.10"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{k}', {'false' if why else 'true'}, {value_sql(why)}, CAST({size} AS INT), {lit(md)})" for n, k, why, size, md in INGESTED) + ") t(name, kind, ok, reason, n_blocks, markdown)")
def ingest_fixtures(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame(formats.fixtures(), "name string, content binary").where("name <> 'n.pdf'")
    return formats.ingest(files).select("name", "kind", "ok", "reason", F.size("blocks").alias("n_blocks"), blocks.render(F.col("blocks")).alias("markdown"))


@query("""SELECT CAST(p AS BIGINT) AS page, CAST(c * 6 + k + 1 AS INT) AS pos, 'p' || p || CASE c WHEN 0 THEN ' left ' ELSE ' right ' END || k || ' of the text' AS text
FROM range(1, 5) a(p), range(0, 2) b(c), range(0, 6) d(k) WHERE c = 0 OR p IN (2, 3)""")
def pdf_read(spark: SparkSession, sf: str) -> DataFrame:
    """A file of four pages, two in two columns, from its bytes: in reading order, without running heads and feet."""
    files = spark.createDataFrame(formats.fixtures(), "name string, content binary").where("name = 'n.pdf'")
    return formats.read_pdfs(files).select("page", "pos", "text")


@query("SELECT * FROM (VALUES ('d.pdf', 'mixed', 1, 1, 0, false, false, false, 0), ('k.pdf', 'damaged', 0, 0, 0, false, false, false, 0), ('m.pdf', 'mixed', 1, 4, 1, true, true, true, 1), ('n.pdf', 'text', 4, 1, 0, false, false, false, 0)) t(name, verdict, pages, fonts, to_unicode, standard_encoding, differences, identity_encoded, subset_fonts)")
def pdf_classes(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame(formats.fixtures(), "name string, content binary").where("name LIKE '%.pdf'")
    s = files.select("name", formats.classify_pdf(F.col("content")).alias("verdict"), formats.pdf_signals(F.col("content")).alias("s"))
    return s.select("name", "verdict", *[f"s.{c}" for c in ("pages", "fonts", "to_unicode", "standard_encoding", "differences", "identity_encoded", "subset_fonts")])


# Store


@query("SELECT doc_id, left(sha256(text), 16) AS id FROM documents WHERE text IS NOT NULL")
def store_ids(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").where("text is not null").select("doc_id", store.id_for(F.col("text")).alias("id"))


def doc_store(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    # The store's clock is the document's number here, so that reruns agree.
    return d.where("text is not null").groupBy(store.id_for(F.col("text")).alias("id")).agg(F.first("text").alias("body"), F.timestamp_seconds(F.min("doc_id") * 3600).alias("stored_at")).withColumn("chars", F.length("body"))


@query("SELECT left(sha256(text), 16) AS id, length(text) AS chars FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL AND text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) GROUP BY 1, 2")
def store_put(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    old = store.put(None, d.where("doc_id % 3 = 0"))
    return store.put(old, d.where("doc_id % 3 <> 0")).select("id", F.col("chars").cast("long"))


@query("SELECT left(sha256(text), 16) AS id, array_to_string(regexp_split_to_array(text, '\\r?\\n')[2:4], chr(10)) AS slice FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def store_slice(spark: SparkSession, sf: str) -> DataFrame:
    return store.slice_lines(doc_store(spark, sf), 2, 3)


@query("WITH s AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), l AS (SELECT left(sha256(text), 16) AS id, unnest(regexp_split_to_array(text, '\\r?\\n')) AS t, unnest(range(1, len(regexp_split_to_array(text, '\\r?\\n')) + 1)) AS line FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY line) AS k FROM l WHERE regexp_matches(t, '(?i)licen[cs]e|token')) SELECT id, CAST(line AS INT) AS line, t AS text FROM g WHERE k <= 100")
def store_grep(spark: SparkSession, sf: str) -> DataFrame:
    return store.grep(doc_store(spark, sf), "licen[cs]e|token")


@query("WITH s AS (SELECT left(sha256(text), 16) AS id, min(doc_id) AS d FROM documents WHERE text IS NOT NULL GROUP BY text), f AS (SELECT id, d FROM s WHERE d >= (SELECT max(d) FROM s) - 168) SELECT id FROM f ORDER BY d DESC, id LIMIT 50")
def store_prune(spark: SparkSession, sf: str) -> DataFrame:
    own = doc_store(spark, sf)
    return store.prune(own, 50, 7, own.agg(F.max("stored_at")).scalar()).select("id")


@query("SELECT count(*) AS entries, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.stats(doc_store(spark, sf))


# Layout


@query("WITH p AS (SELECT DISTINCT p_brand, p_size FROM part), g AS (SELECT *, p_size - row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS isle FROM p), r AS (SELECT p_brand, min(p_size) AS a, max(p_size) AS b FROM g GROUP BY p_brand, isle) SELECT p_brand, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM r GROUP BY 1")
def as_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return layout.as_ranges(read(spark, sf, "part"), ["p_brand"], "p_size")


# Pages of lines, two columns on pages that 3 divides, with a head and a foot: fixed rules over range(), alike in both engines.
PAGE_LINES = [
    "SELECT CAST(d AS BIGINT) AS artifact_id, CAST(p AS BIGINT) AS page, CAST(k AS BIGINT) AS line_no, {text} AS text, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y, 10.0D AS size, CAST({w} AS DOUBLE) AS width",
    "CASE WHEN k = 0 THEN concat('Report ', p) WHEN k = 1 THEN concat('page ', p, ' of 9') ELSE concat('L', k) END",
    "CASE WHEN p % 3 = 0 AND k % 2 = 1 AND k > 1 THEN 320 ELSE 72 END",
    "CASE WHEN k = 0 THEN 760 WHEN k = 1 THEN 50 ELSE 700 - 14 * floor(k / 2) END",
    "CASE WHEN p % 3 = 0 AND k > 1 THEN 200 ELSE 448 END",
]


def page_lines_sql(source: str, real: str) -> str:
    return PAGE_LINES[0].format(text=PAGE_LINES[1], x=PAGE_LINES[2], y=PAGE_LINES[3], w=PAGE_LINES[4]).replace("10.0D", real) + f" FROM {source}"


SPARK_LINES = page_lines_sql("(SELECT explode(sequence(1, 5)) AS d) JOIN (SELECT explode(sequence(1, 9)) AS p) JOIN (SELECT explode(sequence(0, 25)) AS k)", "10.0D")
DUCK_LINES = "ln AS (" + page_lines_sql("range(1, 6) a(d), range(1, 10) b(p), range(0, 26) c(k)", "CAST(10.0 AS DOUBLE)") + ")"


@query(f"WITH {DUCK_LINES}, n AS (SELECT *, x + width AS r, min(x) OVER w AS lo, max(x + width) OVER w AS hi FROM ln WINDOW w AS (PARTITION BY artifact_id, page)), m AS (SELECT *, max(r) OVER (PARTITION BY artifact_id, page ORDER BY x, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM n WHERE width < (hi - lo) * 0.7) SELECT artifact_id, page, reach AS start, x AS stop FROM m WHERE x - reach >= (hi - lo) * 0.04")
def pdf_gutters(spark: SparkSession, sf: str) -> DataFrame:
    return layout.gutters(spark.sql(SPARK_LINES))


@query(f"WITH {DUCK_LINES}, s AS (SELECT *, CASE WHEN p3 AND width = 200 AND x = 72 THEN 'left' WHEN p3 AND width = 200 THEN 'right' ELSE 'span' END AS side FROM (SELECT *, page % 3 = 0 AS p3 FROM ln)), b AS (SELECT *, CASE WHEN p3 THEN 2 * sum(CASE WHEN side = 'span' THEN 1 ELSE 0 END) OVER (PARTITION BY artifact_id, page ORDER BY y DESC, x, line_no ROWS UNBOUNDED PRECEDING) + CASE WHEN side = 'span' THEN 0 ELSE 1 END ELSE 0 END AS band FROM s) SELECT artifact_id, page, line_no, side, CAST(row_number() OVER (PARTITION BY artifact_id, page ORDER BY band, CASE WHEN side = 'right' THEN 1 ELSE 0 END, y DESC, x, line_no) AS INT) AS pos FROM b")
def pdf_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(spark.sql(SPARK_LINES)).select("artifact_id", "page", "line_no", "side", "pos")


@query(f"WITH {DUCK_LINES} SELECT artifact_id, CASE WHEN y > 700 THEN 'head' ELSE 'foot' END AS zone, trim(regexp_replace(lower(text), '\\d+', '#', 'g')) AS key, count(DISTINCT page) AS pages, arg_min(text, page) AS sample FROM ln WHERE line_no < 2 GROUP BY 1, 2, 3")
def pdf_running(spark: SparkSession, sf: str) -> DataFrame:
    return layout.running_content(spark.sql(SPARK_LINES))


@query(f"WITH {DUCK_LINES} SELECT artifact_id, page, count(*) AS n FROM ln WHERE line_no > 1 GROUP BY 1, 2")
def pdf_strip_running(spark: SparkSession, sf: str) -> DataFrame:
    return layout.strip_running(spark.sql(SPARK_LINES)).groupBy("artifact_id", "page").agg(F.count("*").alias("n"))


RUNS = "SELECT CAST(p AS BIGINT) AS artifact_id, 1L AS page, CAST(k AS BIGINT) AS run_no, concat('c', k % 3) AS text, CAST(72 + (k % 3) * 94 + (k % 2) AS DOUBLE) AS x, CAST(700 - 14 * floor(k / 3) AS DOUBLE) AS y, CAST(10.0 AS DOUBLE) AS size, CAST(40.0 AS DOUBLE) AS width FROM "
SPARK_RUNS = RUNS + "(SELECT explode(sequence(1, 20)) AS p) JOIN (SELECT explode(sequence(0, 11)) AS k)"
DUCK_RUNS = "rn AS (" + RUNS.replace("1L", "CAST(1 AS BIGINT)") + "range(1, 21) a(p), range(0, 12) b(k))"
EDGES = "g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY artifact_id, page ORDER BY x, run_no) > 8 THEN 1 ELSE 0 END AS new FROM rn), e AS (SELECT *, sum(new) OVER (PARTITION BY artifact_id, page ORDER BY x, run_no ROWS UNBOUNDED PRECEDING) AS col FROM g)"


@query(f"WITH {DUCK_RUNS}, {EDGES} SELECT artifact_id, page, CAST(col AS BIGINT) AS col, min(x) AS x FROM e GROUP BY 1, 2, 3")
def pdf_column_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return layout.column_edges(spark.sql(SPARK_RUNS))


@query(f"WITH {DUCK_RUNS} SELECT artifact_id, page, run_no, CAST(run_no % 3 AS BIGINT) AS col FROM rn")
def pdf_assign_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.sql(SPARK_RUNS)
    return layout.assign_columns(r, layout.column_edges(r)).select("artifact_id", "page", "run_no", "col")


@query("SELECT CAST(p AS BIGINT) AS artifact_id, CAST(1 AS BIGINT) AS page, CAST(4 AS BIGINT) AS rows, CAST(3 AS BIGINT) AS columns FROM range(1, 21) a(p)")
def pdf_table_bands(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.sql(SPARK_RUNS)
    return layout.band_columns(layout.assign_columns(r, layout.column_edges(r)).withColumn("row", F.col("y")))


@query("WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS k FROM c) SELECT o_custkey, o_orderpriority, n FROM k WHERE k = 1")
def most_common(spark: SparkSession, sf: str) -> DataFrame:
    return layout.most_common(read(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
