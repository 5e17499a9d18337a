"""The engine's own operators: round trips, refusals and needles on small fixtures."""

import base64
import hashlib
import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lathe.functions import blocks, cells, columnar, html, masking
from lathe.functions import text as T
from lathe.operators import pipeline, reduce, store, tables, templates
from lathe.operators.cut import cut
from lathe.plans import catalogue
from lathe.sources import formats, pdf, sinks
from lathe.streaming import logs

LINES = [
    "2026-08-03T14:00:00Z worker-3 done in 31ms", "2026-08-03 14:00:00.123 ready", "14:00:01 tick", "GET /api/v1/users from 10.0.0.1:8080", 'said "hello" twice', "id 123e4567-e89b-12d3-a456-426614174000 ok",
    "commit 0123456789abcdef0123456789abcdef01234567", r"C:\app\src\main.ts:10:5 bad", "nothing here", "", "  padded  ", "0", "007", "3.14159 1e5 0x1F", "a" * 300, "50% done, 50%x",
]


def values(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_mask_round_trip(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, line string").withColumn("m", masking.mask(F.col("line")))
    got = df.select("line", "m.template", masking.unmask(F.col("m.template"), F.col("m.values")).alias("back"), masking.slot_count(F.col("m.template")).alias("n"), F.size("m.values").alias("k")).collect()
    assert all(r.back == r.line and r.n == r.k for r in got)
    t = {r.line: r.template for r in got}
    assert t[LINES[0]] == "<ts> worker-<n> done in <n>" and t[LINES[5]] == "id <id> ok" and t[LINES[3]] == "GET <path> from <ip>" and t["007"] == "<n>"


@pytest.mark.parametrize("line, want", [("AssertionError: x", 3), ("terror", 0), ("not ok 2 - b", 3), ("a warning", 2), ("# pass 3", 2), ("---", 1), ("plain", 0)])
def test_rank(spark, line, want):
    assert spark.createDataFrame([(line,)], "l string").select(T.rank(F.col("l"))).first()[0] == want


def test_lines_round_trip(spark):
    texts = ["", "a", "a\n", "a\r\nb", "a\r\nb\r\n", "\n", "a\n\nb"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert values(df, T.join_lines(T.line_set(F.col("t")))) == texts
    assert values(df, F.size(T.lines(F.col("t")))) == [0, 1, 1, 2, 2, 1, 3]


COLUMNS = [
    [f"2026-08-03T14:00:{i:02d}Z" for i in range(10)], [f"worker-{i % 3}" for i in range(12)], ["info"] * 11 + ["warn"], ["1000001", "1000002", "1000003", "1000004", "1000005"], list("abcdef"), [""] * 5, ["1.5", "2.5", "3.25", "4"], ["-1", "-5", "3", "-9"],
    ["007", "008", "009", "010"], ["a,b", "c,d", "a,b", "c,d"], ['x"y', "z", 'x"y', "z"], ["x\ny", "x\ny", "z", "z"], ["2026-01-01T00:00:05Z", "2026-01-01T00:00:01Z", "2025-12-31T23:59:59Z", "2026-01-01T00:00:00Z"], [], ["one"],
]


def test_columns_round_trip_and_never_grow(spark):
    rng = random.Random(1)
    cols = COLUMNS + [[str(rng.choice([rng.randrange(10), rng.randrange(10**6), "x"])) for _ in range(rng.randrange(4, 30))] for _ in range(40)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, a array<string>").withColumn("e", columnar.encode_column(F.col("a")))
    got = df.select("a", "e.encoding", "e.text", columnar.decode_column(F.col("e.encoding"), F.col("e.text")).alias("back")).collect()
    assert all((r.back == r.a or r.a == []) and len(r.text) <= len("\x02".join(r.a)) for r in got)
    assert [r.encoding for r in got[:4]] == ["stamps", "dict", "runs", "delta"] and got[8].encoding != "delta"


def test_cells_round_trip(spark):
    raw = ["", " ", "true", "0", "007", "1e5", "has,comma", 'has"quote', "a\nb", "∅", "emoji 😀", "x" * 500]
    df = spark.createDataFrame([(raw,)], "c array<string>").select(cells.decode_rows(cells.encode_row(F.col("c"))).alias("r"))
    assert [(c.tag, c.raw) for c in df.first().r[0]] == [("string", x) for x in raw]
    typed = spark.createDataFrame([([("null", None), ("number", "1.50"), ("bool", "true"), ("absent", None)],)], f"c array<{cells.CELL}>")
    assert typed.select(cells.encode_typed_row(F.col("c"))).first()[0] == ",1.50,true,∅"


def log(n=200):
    return "\n".join([f"2026-08-03T14:{i // 60:02d}:{i % 60:02d}Z worker-{i % 8} finished job {i} in {i % 40}ms" for i in range(n)] + ["2026-08-03T15:00:00Z ERROR: disk full on /var/data/a/b"])


def artifacts(spark, rows):
    return spark.createDataFrame(rows, "artifact_id long, text string, budget int")


def test_templates_give_the_text_back(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(log().split("\n"))], "artifact_id long, line_no long, line string")
    m = templates.masked(rows)
    t = templates.mine(m)
    back = templates.expand_columns(templates.render_columns(m, t)).orderBy("line_no").collect()
    assert "\n".join(r.line for r in back) == log()
    assert templates.expand_rows(templates.render_rows(m, t)).first()["text"] == log()


def test_template_rows_keep_failures(spark):
    rows = spark.createDataFrame([(1, i, f"T{1 + i % 3} value {i}" if i != 50 else "ERROR broken") for i in range(100)], "artifact_id long, line_no long, row string")
    kept = {r.line_no for r in templates.fit_rows(rows, 200).collect()}
    assert 50 in kept and len(kept) > 5 and {i % 3 for i in kept} == {0, 1, 2}


def test_pipeline_fits_budgets_and_keeps_needles(spark):
    tap = "\n".join(["TAP version 13"] + [f"ok {i} - case" for i in range(1, 601)] + ["not ok 601 - AssertionError: no", "    at f (/app/a.js:1:2)", "# tests 601", "# fail 1"])
    stack = "TypeError: handler is not a function\n" + "\n".join(f"    at frame{i} (/app/src/module{i}.mjs:{i}:9)" for i in range(300))
    prose = " ".join(f"Sentence {i} of the story." for i in range(1, 401))
    data = json.dumps({"data": [{"id": i, "name": f"person-{i}", "role": "admin"} for i in range(100)]}, indent=2)
    rows = [(1, log(), 1500), (2, tap, 1000), (3, stack, 1200), (4, prose, 1000), (5, data, 1000), (6, "short", 1000), (7, None, 1000)]
    got = {r.artifact_id: r for r in pipeline.reduce_corpus(artifacts(spark, rows)).collect()}
    assert len(got) == 7
    assert "disk full" in got[1].text and "not ok 601" in got[2].text and "TypeError" in got[3].text and "Sentence 1 " in got[4].text and "Sentence 400 " in got[4].text
    assert all(got[i].compressed_chars < got[i].original_chars for i in (1, 2, 3, 4, 5))
    assert not got[5].lossy and "person-99" in got[5].text and got[6].text == "short" and not got[6].applied and got[7].text == ""
    assert got[4].lossy and got[4].retrieval_id and all(a.lossless or got[1].lossy for a in got[1].applied if a.applied)


def test_order_lossless_first():
    ids = [s.id for s in pipeline.STAGES]
    assert ids.index("log-templates") < ids.index("template-rows") < ids.index("test-output") < ids.index("head-tail") == len(ids) - 1
    with pytest.raises(ValueError):
        pipeline.validate(pipeline.Stage("", True, lambda: F.lit(True)))


def test_json_tables():
    rows = [{"id": i, "name": "a,b", "v": 1.5, "k": None, "s": "007"} for i in range(10)]
    ok, _, out, n, gain = tables.compact_text(json.dumps(rows, indent=2))
    assert ok and n == 1 and gain > 0.15
    back = tables.from_table(json.loads(out)["__table"])
    assert [r["s"] for r in back] == ["007"] * 10 and back[0]["k"] is None and str(back[3]["id"]) == "3"
    for bad in ([{"a": [1]}] * 5, [{"a": 1}] * 2, [1, 2, 3], [{"a": 1}, {"b": 1}, {"c": 1}], [[1], [2], [3]]):
        assert tables.tabulable(json.loads(json.dumps(bad), parse_int=tables.Literal)) is None
    assert not tables.compact_text('{"a": 1} x')[0] and not tables.compact_text("[NaN]")[0]


def test_tables_in_text(spark):
    pipe = "\n".join(["| region | n |", "| --- | --- |"] + [f"| region-{i % 4} | {i} |" for i in range(30)])
    text = f"Before\n{pipe}\nAfter, and more words that are prose, here.\n"
    out = tables.md_tables(artifacts(spark, [(1, text, 100), (2, "no table, here\n" * 3, 100)]))
    got = {r.artifact_id: r for r in out.withColumn("back", tables.decode_tables(F.col("rendered"))).collect()}
    assert got[1].back == text and len(got[1].rendered) < len(text) and got[2].rendered is None


def test_html_and_blocks(spark):
    page = "<!doctype html><html><body><nav>menu</nav><main><h1>Title</h1><p>Some <b>bold</b> text &amp; a <a href='/x'>link</a>, &#233; &unknown;</p><ol><li>one</li><li>two</li></ol><table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table><script>bad()</script>" + "<p>" + "word " * 60 + "</p></main><footer>foot</footer></body></html>"
    md = spark.createDataFrame([(page,)], "h string").select(html.to_markdown(F.col("h")).alias("m"))
    m = md.first()["m"]
    assert "# Title" in m and "**bold**" in m and "[link](/x)" in m and "1. one\n2. two" in m and "| 1\\|2 | |" in m and "é &unknown;" in m and "bad" not in m and "menu" not in m
    b = md.select(blocks.segment(F.col("m")).alias("b"))
    assert [x.type for x in b.first()["b"]] == ["heading", "paragraph", "list", "table", "paragraph"]
    assert b.select(blocks.render(F.col("b"), mode="preserve")).first()[0].startswith("# Title")
    assert not spark.createDataFrame([("a < b and c > d",)], "h string").select(html.looks_like_html(F.col("h"))).first()[0]
    with pytest.raises(ValueError):
        blocks.block("other")


def test_doc_render_takes_every_order(spark, tmp_path):
    rows = [(o, n, 10 * o + n, "N", "O") for o in range(100) for n in (2, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    dense = {r.l_orderkey: r.markdown for r in catalogue.doc_render_dense(spark, str(tmp_path)).collect()}
    pipe = {r.l_orderkey: r.markdown for r in catalogue.doc_render_pipe(spark, str(tmp_path)).collect()}
    assert dense == {o: f'###### Order {o}\n\npart,flag,status\n{10 * o + 1},"a|b, N",O\n{10 * o + 2},"a|b, N","q""q"' for o in range(100)}
    assert pipe == {o: f'###### Order {o}\n\n| part | flag | status |\n| --- | --- | --- |\n| {10 * o + 1} | a\\|b, N | O |\n| {10 * o + 2} | a\\|b, N | q"q |' for o in range(100)}


def test_formats(spark):
    files = spark.createDataFrame(formats.fixtures(), "name string, content binary")
    got = {r.name: r for r in formats.ingest(files).withColumn("md", blocks.render(F.col("blocks"))).collect()}
    assert len(got) == 14
    assert got["a.docx"].md == "# Report\n\nKept added\n\na,b\n1,2"
    assert got["b.xlsx"].md == "## Sales\n\nday,units\n2023-03-15,7"
    assert got["c.pptx"].md == "## Plan\n\n- one\n- two"
    assert got["d.pdf"].md == "Hello\nWorld again" and "# Title" in got["f.html"].md and got["e.txt"].md == "plain\ntext"
    assert {n for n, r in got.items() if not r.ok} == {"g.png", "h.doc", "i.zip", "j.bin", "k.pdf"} and all(r.reason for r in got.values() if not r.ok)
    kinds = files.select("name", formats.classify_pdf(F.col("content")).alias("k")).where("name like '%.pdf'").collect()
    assert {r.name: r.k for r in kinds} == {"d.pdf": "mixed", "k.pdf": "damaged", "m.pdf": "mixed", "n.pdf": "text"}
    assert got["l.docx"].md.endswith('Ann: on "the anchor": Check this') and "item,units,price\nbolt,7,1.50" in got["m.pdf"].md
    read = sorted((r.page, r.pos, r.text) for r in formats.read_pdfs(files).where("artifact_id = 'n.pdf' AND page = 2").collect())
    assert [t for _, _, t in read] == [f"p2 {side} {k} of the text" for side in ("left", "right") for k in range(6)]


def test_pdf_parts():
    assert [pdf.glyph(n) for n in ("five", "uni0041", "u1F600", "A.sc", "a", "germandbls", "g12", "bracketleft")] == ["5", "A", "😀", "A", "a", None, None, "["]
    assert pdf.glyph("eacute") == "e\u0301"
    assert pdf.differences(b"[ 32 /space /A 65/B /C]") == {32: "space", 33: "A", 65: "B", 66: "C"}
    assert pdf.wide_widths(b"1 [500 250.5] 10 12 700") == {1: 500, 2: 250.5, 10: 700, 11: 700, 12: 700}
    assert pdf.unfiltered(base64.a85encode(b"some text") + b"~>", "ASCII85Decode") == b"some text" and pdf.unfiltered(b"41 4>", "ASCIIHexDecode") == b"A@"
    raw = zlib.compress(b"a stream of data " * 50)
    assert pdf.inflated(raw) == b"a stream of data " * 50 and pdf.inflated(raw[2:-4]) == b"a stream of data " * 50 and pdf.inflated(raw[: len(raw) // 2])
    assert pdf.stream(b"<</Filter /LZWDecode>>\nstream\nxx\nendstream") == (None, "filter LZWDecode")
    assert pdf.stream(b"<</Filter /FlateDecode /DecodeParms <</Predictor 12>> >>\nstream\nxx\nendstream") == (None, "predictor 12")
    runs = list(pdf.runs(b"q 2 0 0 2 5 5 cm BT /F 10 Tf 50 Tz 1 Tw 10 20 Td (a b) Tj 0 -5 TD (c) Tj T* [(d) -179 (e) -181 (f)] TJ ET Q BT /F 10 Tf (g) Tj ET", {}))
    assert [(r["text"], r["x"], r["y"], r["size"], r["width"]) for r in runs] == [("a b", 25, 45, 20, 16), ("c", 25, 35, 20, 5), ("de f", 25, 25, 20, pytest.approx(18.6)), ("g", 0, 0, 10, 5)]


def test_pdf_tables():
    line = lambda y, *cells: [{"text": t, "x": x, "y": y, "size": 10, "width": 5 * len(t)} for x, t in cells]
    page = [line(99, (10, "A title")), line(90, (10, "k"), (100, "n")), line(80, (10, "a"), (100, "1")), line(70, (10, "b"), (100, "22"), (140, "kg")), line(60, (10, "c"), (100, "3")), line(50, (10, "words after it"))]
    assert pdf.tables(page) == [(1, 5, [["k", "n"], ["a", "1"], ["b", "22 kg"], ["c", "3"]])]
    assert pdf.tables(page[:3]) == [] and pdf.has_header([["k", "n"], ["a", "1"]]) and not pdf.has_header([["1", "n"], ["a", "1"]])
    assert len(pdf.caveats([["a", "b", "c"], ["a", "b", "c"], ["a", "", ""], ["a", "b", "c" * 50]])) == 2


def test_nested_elements_go_whole(spark):
    page = "<p>a</p>" + "<nav>" * 6 + "menu" + "</nav>" * 6 + "<aside>x<aside>y</aside>z</aside><p>b</p><button>" + "<form>q"
    out = spark.createDataFrame([(page,), (None,)], "h string").select(html.drop_elements(F.col("h"))).collect()
    assert out[0][0].replace(" ", "") == "<p>a</p>z</aside><p>b</p>q".replace("z</aside>", "") or "menu" not in out[0][0] and "x" not in out[0][0]
    assert out[1][0] is None


def test_a_stage_that_fails_is_recorded(spark):
    def broken(df):
        raise KeyError("x")

    stages = [pipeline.Stage("broken", True, lambda: F.lit(True), run=broken), pipeline.Stage("odd", True, lambda: F.lit(True), run=lambda df: df.select("artifact_id")), *pipeline.STAGES]
    got = pipeline.reduce_corpus(artifacts(spark, [(1, log(), 1500), (2, "short", 1000)]), stages).orderBy("artifact_id").collect()
    assert [(a.id, a.applied, a.reason) for a in got[0].applied[:2]] == [("broken", False, "failed: KeyError"), ("odd", False, "failed: ValueError")]
    assert "disk full" in got[0].text and got[0].compressed_chars < got[0].original_chars and got[1].text == "short"


def test_runs_unfold(spark):
    cols = [["a", "a", "b", "a"], ["x"], ["", "", ""]]
    df = spark.createDataFrame([(c,) for c in cols], "a array<string>")
    assert values(df, columnar.unfold(columnar.runs(F.col("a")))) == cols


def test_sums_over_blocks(spark):
    n = [random.Random(i).randrange(-1000, 1000) for i in range(1000)]
    for size in (1, 2, 127, 128, 129, 1000):
        own = [str(x) for x in n[:size]]
        df = spark.createDataFrame([(own,)], "a array<string>")
        assert df.select(columnar.decode_delta(columnar.encode_delta(F.col("a")))).first()[0] == own


def test_sinks(spark, tmp_path):
    df = pipeline.reduce_corpus(artifacts(spark, [(1, log(), 1500)]))
    sinks.write_texts(df, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").first()["text"] == df.first()["text"]
    assert json.loads(sinks.as_json(df).first()["result"])["artifact_id"] == 1
    assert spark.range(1).select(sinks.stats_line(F.lit(2), F.lit(200), F.lit(50))).first()[0] == "2 texts, 200 to 50 chars, 75.0 % saved"
    assert store.clear(store.put(None, df.select("text"))).count() == 0


def test_shared_folder_is_asked_for_on_a_cluster(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        sparkSession = type("S", (), {"conf": Conf, "sparkContext": Context})

    with pytest.raises(ValueError):
        cut(Frame)


def test_store(spark):
    texts = spark.createDataFrame([("a\nb ERROR\nc",), ("a\nb ERROR\nc",), ("other",), (None,)], "text string")
    s = store.put(None, texts).cache()
    assert s.count() == 2 and store.put(s, texts).count() == 0
    one = s.where("chars = 11").first()["id"]
    assert store.get(s, one).first()["body"] == "a\nb ERROR\nc" and store.get(s, "../x").count() == 0
    assert [(r.line, r.text) for r in store.grep(s, "error").collect()] == [(2, "b ERROR")]
    assert store.slice_lines(store.get(s, one), 2, 1).first()["slice"] == "b ERROR" and store.has(s, one).first()[0] and store.prune(s, 1).count() == 1


def test_store_prune_takes_the_newest(spark, tmp_path):
    texts = [(i, f"text {i}") for i in range(900)] + [(900, "text 0"), (901, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(values(catalogue.store_prune(spark, str(tmp_path)), "id"))
    assert got == sorted(hashlib.sha256(f"text {i}".encode()).hexdigest()[:16] for i in range(850, 900))


def test_store_prune_of_an_aged_store(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in (0, 831, 832, 1000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(values(catalogue.store_prune(spark, str(tmp_path)), "id"))
    assert got == sorted(hashlib.sha256(f"text {i}".encode()).hexdigest()[:16] for i in (832, 1000))


def test_tests_reducer(spark):
    text = "ok 1 - a\n# Subtest: fails\nnot ok 2 - b\n  detail\n\n  more\nok 3 - c\nerror: odd\n# tests 3\n# fail 1"
    out = reduce.shrink_tests(artifacts(spark, [(1, text, 4000)])).first()["reduced"]
    assert out == "[compressed: 3 passing lines omitted]\nnot ok 2 - b\n  detail\n  more\nerror: odd\n\n# tests 3\n# fail 1"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("job 1 done\njob 2 done\nERROR: disk full\n")
    q = logs.template_counts(logs.read_lines(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {r.template: (r.uses, r.worst_rank) for r in spark.table("counts").collect()}
    assert got["job <n> done"] == (2, 0) and got["ERROR: disk full"] == (1, 3)


def test_entry_without_the_other_folder(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "find_spec", lambda name: None)
    assert "mask_templates" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
