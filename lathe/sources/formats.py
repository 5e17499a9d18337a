"""Binary sources: formats by magic bytes, archives, office files and PDF, as rows of blocks.

files(name, content) come from spark.read.format("binaryFile"). Deciding on a format is native; decoding runs in Arrow
batches, since no built-in reads these formats. A file that can't be read is a row with a reason, not a failed job.
"""

from __future__ import annotations

import base64
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, html
from ..operators import layout
from . import pdf as pdfs

#: The first bytes of each format, in hexadecimal; `..` stands for any byte.
MAGIC = [("pdf", "255044462D"), ("png", "89504E470D0A1A0A"), ("jpg", "FFD8FF"), ("gif", "47494638"), ("webp", "52494646........57454250"), ("bmp", "424D"), ("tif", "49492A00"), ("tif", "4D4D002A"), ("office", "D0CF11E0A1B11AE1"), ("zip", "504B0304")]
MOST_BYTES = 64 << 20
SCHEMA = f"name string, kind string, ok boolean, reason string, notes array<string>, blocks {blocks.BLOCKS}"


def magic_format(content: Column) -> Column:
    """pdf, an image format, office (before 2007), zip, text, or binary where the first 4,096 bytes hold a zero."""
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for name, pattern in MAGIC:
        hit = head.rlike("^" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(F.hex(F.substring(content, 1, 4096)).rlike("^(?:..)*?00"), "binary").otherwise("text")


def serial_date(n: Column) -> Column:
    """The day, with its time if there is one, of a spreadsheet's serial number; null up to 60."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(n) - 25569).cast("int")), "yyyy-MM-dd")
    secs = F.round((n - F.floor(n)) * 86400).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(secs / 3600)), two(F.floor(secs / 60) % 60), two(secs % 60))
    return F.when(n > 60, F.when(secs > 0, F.concat(day, F.lit("T"), clock)).otherwise(day))


def column_index(ref: Column) -> Column:
    """A is 0, AA is 26; digits of the reference are left out."""
    letters = F.split(F.regexp_replace(F.upper(ref), "[^A-Z]", ""), "")
    return F.aggregate(letters, F.lit(0), lambda n, c: n * 26 + F.ascii(c) - 64) - 1


def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def all_of(node, *names: str):
    return [] if node is None else [x for x in node.iter() if bare(x.tag) in names]


def attr(node, name: str, default: str = "") -> str:
    return next((v for k, v in node.attrib.items() if bare(k) == name), default)


def make(type_: str, **parts) -> dict:
    return {"type": type_, "level": None, "ordered": None, "lang": None, "text": None, "items": None, "head": None, "rows": None} | parts


class Parts:
    """Members of an archive by name; sizes are bounded, and a broken member is an error of its own."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()

    def read(self, name: str) -> bytes:
        info = self.zip.getinfo(name)
        if info.flag_bits & 1:
            raise ValueError(f"{name} is encrypted")
        if info.file_size > MOST_BYTES:
            raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
        with self.zip.open(info) as f:
            data = f.read(MOST_BYTES + 1)
        if len(data) > MOST_BYTES:
            raise ValueError(f"{name} is larger than {MOST_BYTES} bytes")
        return data

    def xml(self, name: str):
        data = self.read(name) if name in self.names else None
        if data is not None and b"<!DOCTYPE" in data[:4096]:
            raise ValueError(f"{name} declares entities")
        return None if data is None else ElementTree.fromstring(data)

    def rels(self, of: str) -> dict[str, tuple[str, str]]:
        """Id to (type, target) of a part's relations."""
        folder, _, base = of.rpartition("/")
        node = self.xml(f"{folder}/_rels/{base}.rels")
        if node is None:
            return {}
        def full(t: str) -> str:
            if t.startswith("/"):
                return t[1:]
            steps = (folder + "/" + t).split("/")
            out: list[str] = []
            for s in steps:
                out = out[:-1] if s == ".." else [*out, s]
            return "/".join(out)
        return {attr(r, "Id"): (attr(r, "Type").rpartition("/")[2], attr(r, "Target") if attr(r, "TargetMode") == "External" else full(attr(r, "Target"))) for r in node}


def date_text(n: float) -> str | None:
    if n <= 60:
        return None
    t = pd.Timestamp("1970-01-01") + pd.Timedelta(seconds=round((n - 25569) * 86400))
    return t.strftime("%Y-%m-%d" if n == int(n) else "%Y-%m-%dT%H:%M:%S")


def xlsx(p: Parts) -> tuple[list[dict], list[str]]:
    book = p.xml("xl/workbook.xml")
    rels = p.rels("xl/workbook.xml")
    strings = ["".join(t.text or "" for t in all_of(si, "t")) for si in all_of(p.xml("xl/sharedStrings.xml"), "si")]
    dated: set[int] = set()
    if (st := p.xml("xl/styles.xml")) is not None:
        own = {int(attr(f, "numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]', "", attr(f, "formatCode")) for f in all_of(st, "numFmt")}
        is_date = lambda i: 14 <= i <= 22 or 45 <= i <= 47 or bool(re.search("[ymdhs]", own.get(i, ""), re.I))
        for group in all_of(st, "cellXfs"):
            dated = {i for i, xf in enumerate(group) if is_date(int(attr(xf, "numFmtId", "0")))}
    out, notes = [], []
    for sheet in all_of(book, "sheet"):
        kind, path = rels.get(attr(sheet, "id"), ("", ""))
        if (node := p.xml(path)) is None:
            notes.append(f"sheet {attr(sheet, 'name')} is missing")
            continue
        grid: dict[int, dict[int, str]] = {}
        for c in all_of(node, "c"):
            ref = attr(c, "r")
            m = re.match(r"([A-Z]+)(\d+)$", ref)
            if not m:
                continue
            col = 0
            for ch in m[1]:
                col = col * 26 + ord(ch) - 64
            raw, t = next((v.text or "" for v in all_of(c, "v")), ""), attr(c, "t", "n")
            v = raw
            if t == "s":
                v = strings[int(raw)] if raw.isdigit() and int(raw) < len(strings) else ""
            elif t == "inlineStr":
                v = "".join(x.text or "" for x in all_of(c, "t"))
            elif t == "b":
                v = "TRUE" if raw == "1" else "FALSE"
            elif t == "n" and raw and int(attr(c, "s", "0")) in dated:
                v = date_text(float(raw)) or raw
            if v != "":
                grid.setdefault(int(m[2]), {})[col - 1] = v
        out.append(make("heading", level=2, text=attr(sheet, "name")))
        if grid:
            lo = min(min(r) for r in grid.values())
            hi = max(max(r) for r in grid.values())
            rows = [[grid.get(i, {}).get(c, "") for c in range(lo, hi + 1)] for i in range(min(grid), max(grid) + 1)]
            named = all(not re.fullmatch(r"-?\d+(\.\d+)?", v) for v in rows[0] if v)
            out.append(make("table", head=rows[0] if named else [], rows=rows[1:] if named else rows))
        notes_of = {t: x for t, x in p.rels(path).values()}
        threaded = p.xml(notes_of["threadedComment"]) if "threadedComment" in notes_of else None
        seen: dict[str, list[str]] = {}
        people = {attr(x, "id"): attr(x, "displayName") for x in all_of(p.xml("xl/persons/person.xml"), "person")}
        for c in all_of(threaded, "threadedComment"):
            seen.setdefault(attr(c, "ref"), []).append(f"{people.get(attr(c, 'personId'), '')}: {''.join(x.text or '' for x in all_of(c, 'text'))}")
        if "comments" in notes_of and (cm := p.xml(notes_of["comments"])) is not None:
            authors = [a.text or "" for a in all_of(cm, "author")]
            for c in all_of(cm, "comment"):
                if attr(c, "ref") not in seen:
                    who = authors[int(attr(c, "authorId", "0"))] if authors else ""
                    said = "".join(x.text or "" for x in all_of(c, "t"))
                    seen[attr(c, "ref")] = [f"{who}: {said.removeprefix(who + ':').strip()}"]
        if seen:
            out.append(make("list", ordered=False, items=[f"{ref} {x}" for ref, own in sorted(seen.items()) for x in own]))
    return out, notes


def run_text(node, deleted: bool = False) -> str:
    """Text of runs in order: tabs as blanks, breaks as line ends, deletions left out."""
    out = []
    for x in node:
        name = bare(x.tag)
        if name in ("del", "delText", "moveFrom"):
            continue
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append(" ")
        elif name in ("br", "cr"):
            out.append("\n")
        else:
            out.append(run_text(x))
    return "".join(out)


def anchors(body) -> dict[str, str]:
    """The text that each comment is about, by the comment's id: what stands between its two marks."""
    open_, out = {}, {}
    for x in body.iter():
        name, own = bare(x.tag), attr(x, "id")
        if name == "commentRangeStart":
            open_[own] = []
        elif name == "commentRangeEnd" and own in open_:
            out[own] = "".join(open_.pop(own)).strip()
        elif name == "t":
            for said in open_.values():
                said.append(x.text or "")
    return out


def elided(text: str, most: int = 120) -> str:
    """A text's ends where it is longer than `most` characters."""
    half = (most - 1) // 2
    return text if len(text) <= most else f"{text[:half]}…{text[-half:]}"


def docx(p: Parts) -> tuple[list[dict], list[str]]:
    body = next(x for x in p.xml("word/document.xml") if bare(x.tag) == "body")
    rels = p.rels("word/document.xml")
    bullets: dict[str, bool] = {}
    if (num := p.xml("word/numbering.xml")) is not None:
        first = {attr(a, "abstractNumId"): next((attr(f, "val") for lvl in all_of(a, "lvl") if attr(lvl, "ilvl", "0") == "0" for f in all_of(lvl, "numFmt")), "bullet") for a in all_of(num, "abstractNum")}
        for n in all_of(num, "num"):
            bullets[attr(n, "numId")] = first.get(next((attr(a, "val") for a in all_of(n, "abstractNumId")), ""), "bullet") in ("bullet", "none")

    def said(par) -> str:
        out = []
        for x in par:
            if bare(x.tag) == "hyperlink":
                label, target = run_text(x), rels.get(attr(x, "id"), ("", ""))[1]
                out.append(label if not target or label == target else f"[{label}]({target})")
            elif bare(x.tag) not in ("del", "moveFrom"):
                out.append(run_text(x) if bare(x.tag) != "t" else x.text or "")
        return "".join(out).strip()

    out: list[dict] = []
    last = None
    for node in body:
        if bare(node.tag) == "tbl":
            rows = [["\n".join(said(q) for q in all_of(c, "p")) for c in r if bare(c.tag) == "tc"] for r in node if bare(r.tag) == "tr"]
            out.append(make("table", head=rows[0] if rows else [], rows=rows[1:]))
            last = None
        elif bare(node.tag) == "p":
            text = said(node)
            style = next((attr(s, "val") for s in all_of(node, "pStyle")), "")
            number = next((attr(s, "val") for s in all_of(node, "numId")), None)
            level = 1 if style == "Title" else 2 if style == "Subtitle" else min(6, int(m[1])) if (m := re.match(r"(?i)heading ?(\d+)$", style)) else None
            if not text:
                continue
            if number is not None and level is None:
                indent = int(next((attr(s, "val", "0") for s in all_of(node, "ilvl")), "0"))
                key = (number, not bullets.get(number, True))
                if last == key:
                    out[-1]["items"].append("  " * indent + text)
                else:
                    out.append(make("list", ordered=key[1], items=[text]))
                last = key
                continue
            last = None
            out.append(make("heading", level=level, text=text) if level else make("paragraph", text=text))
    about = anchors(body)
    for name, title in (("footnotes", "Footnotes"), ("comments", "Comments")):
        if (node := p.xml(f"word/{name}.xml")) is not None:
            on = lambda x: f'on "{elided(t)}": ' if name == "comments" and (t := about.get(attr(x, "id"), "")) else ""  # noqa: B023, E731
            items = [(f"{attr(x, 'author')}: " if name == "comments" else "") + on(x) + " ".join(said(q) for q in all_of(x, "p")) for x in node if name == "comments" or int(attr(x, "id", "0")) > 0]
            if items:
                out += [make("heading", level=2, text=title), make("list", ordered=False, items=items)]
    return out, []


def pptx(p: Parts) -> tuple[list[dict], list[str]]:
    rels = p.rels("ppt/presentation.xml")
    order = [rels.get(attr(s, "id"), ("", ""))[1] for s in all_of(p.xml("ppt/presentation.xml"), "sldId")]
    order = [x for x in order if x in p.names] or sorted((x for x in p.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=lambda x: int(re.search(r"\d+", x)[0]))
    par = lambda q: re.sub(r"[ \t]+", " ", run_text(q)).strip()
    out: list[dict] = []
    for i, path in enumerate(order):
        if i:
            out.append(make("rule"))
        slide = p.xml(path)
        title, rest = None, []
        for shape in all_of(slide, "sp", "graphicFrame"):
            for t in all_of(shape, "tbl"):
                rows = [["\n".join(par(q) for q in all_of(c, "p")) for c in all_of(r, "tc")] for r in all_of(t, "tr")]
                rest.append(make("table", head=rows[0] if rows else [], rows=rows[1:]))
            if bare(shape.tag) == "sp":
                said = [x for x in (par(q) for q in all_of(shape, "p")) if x]
                kind = next((attr(h, "type") for h in all_of(shape, "ph")), None)
                if kind in ("title", "ctrTitle") and title is None and said:
                    title = " ".join(said)
                elif said and kind not in ("sldNum", "dt", "ftr"):
                    rest.append(make("list", ordered=False, items=said) if len(said) > 1 else make("paragraph", text=said[0]))
        out += [make("heading", level=2, text=title or f"Slide {i + 1}"), *rest]
        for kind, target in p.rels(path).values():
            node = p.xml(target) if kind in ("notesSlide", "comments") else None
            if node is not None and kind == "notesSlide":
                said = [x for s in all_of(node, "sp") if not any(attr(h, "type") == "sldNum" for h in all_of(s, "ph")) for x in (par(q) for q in all_of(s, "p")) if x]
                if said:
                    out.append(make("raw", text="\n".join("> " + x for x in said)))
            elif node is not None:
                people = {attr(a, "id"): attr(a, "name") for a in all_of(p.xml("ppt/commentAuthors.xml"), "cmAuthor", "author")}
                items = [f"{people.get(attr(c, 'authorId'), '')}: {''.join(t.text or '' for t in all_of(c, 'text', 't'))}" for c in all_of(node, "cm")]
                if items:
                    out.append(make("list", ordered=False, items=items))
    return out, []


def pdf(data: bytes) -> tuple[list[dict], list[str]]:
    """Paragraphs and tables of a PDF, page by page; pages of whose codes more than half have no character are left out."""
    file = pdfs.File(data)
    out, notes, good = [], [], 0
    for no, n in enumerate(file.pages, 1):
        runs, lost, unread = file.page(n)
        notes += [f"page {no}: a stream could not be read ({why})" for why in unread]
        glyphs = sum(len(r["text"]) for r in runs)
        if not glyphs or lost > glyphs:
            notes.append(f"page {no} could not be read")
            continue
        good += 1
        notes += [f"page {no}: {lost} of {lost + glyphs} characters are unknown"] if lost else []
        page, at = pdfs.lines(runs), 0
        for first, stop, rows in [*pdfs.tables(page), (len(page), len(page), [])]:
            if at < first:
                out.append(make("paragraph", text="\n".join(map(pdfs.joined, page[at:first]))))
            if rows:
                out.append(make("table", head=rows[0], rows=rows[1:]))
                notes += [f"page {no}: {x}" for x in pdfs.caveats(rows)] + ([] if pdfs.has_header(rows) else [f"page {no}: a table without a header row"])
            at = stop
    if not good:
        raise ValueError("the PDF holds scans or nothing that can be read")
    return out, notes


def pdf_lines(files: DataFrame) -> DataFrame:
    """lines(artifact_id, page, line_no, text, x, y, size, width) of PDF files(name, content), for `operators.layout`.

    Files that can't be read have no lines; `ingest` says why.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, content in zip(b["name"], b["content"], strict=True):
                try:
                    file = pdfs.File(content)
                except ValueError:
                    continue
                for no, n in enumerate(file.pages, 1):
                    for i, line in enumerate(x for whole in pdfs.lines(file.page(n)[0]) for x in pdfs.pieces(whole)):
                        rows.append((name, no, i, pdfs.joined(line), line[0]["x"], line[0]["y"], max(r["size"] for r in line), line[-1]["x"] + line[-1]["width"] - line[0]["x"]))
            yield pd.DataFrame(rows, columns=["artifact_id", "page", "line_no", "text", "x", "y", "size", "width"])

    own = files.where(magic_format(F.col("content")) == "pdf").select("name", "content")
    return own.mapInPandas(read, "artifact_id string, page long, line_no long, text string, x double, y double, size double, width double")


def read_pdfs(files: DataFrame) -> DataFrame:
    """(artifact_id, page, pos, text): lines of PDF files in reading order, running heads and feet left out."""
    return layout.reading_order(layout.strip_running(pdf_lines(files))).select("artifact_id", "page", "pos", "text")


def pdf_signals(content: Column) -> Column:
    """struct of counts over the raw bytes: pages, what may bring text back from fonts, and where text and page may differ."""
    raw = F.decode(content, "ISO-8859-1")
    count = lambda p: F.regexp_count(raw, F.lit(p))
    return F.struct(
        count(r"/Type\s*/Page(?![sA-Za-z])").alias("pages"), count(r"/Type\s*/Font\b").alias("fonts"), count(r"/ToUnicode\b").alias("to_unicode"), raw.rlike(r"/(?:WinAnsi|MacRoman|Standard|MacExpert)Encoding\b").alias("standard_encoding"), raw.rlike(r"/Differences\s*\[").alias("differences"),
        raw.rlike(r"/Encoding\s*/Identity-[HV]\b").alias("identity_encoded"), count(r"/BaseFont\s*/[A-Z]{6}\+").alias("subset_fonts"), count(r"/ActualText\b").alias("actual_text"), raw.rlike(r"/StructTreeRoot\b").alias("tagged"),
    )


def classify_pdf(content: Column) -> Column:
    """not-pdf, encrypted, damaged, scanned, mixed or text, from counts over the raw bytes."""
    raw = F.decode(content, "ISO-8859-1")
    count = lambda p: F.regexp_count(raw, F.lit(p))
    return (
        F.when(~raw.startswith("%PDF-"), "not-pdf").when(count(r"/Encrypt\b") > 0, "encrypted").when(count(r"\bobj\b") == 0, "damaged").when((count(r"\b(Tj|TJ)\b") == 0) & (count("/FlateDecode") > 0) & (count(r"/Font\b") > 0), "mixed").when((count(r"\b(Tj|TJ)\b") == 0) & (count(r"/Font\b") == 0), "scanned").otherwise("text")
    )


def office(content: bytes) -> tuple[str, list[dict], list[str]]:
    p = Parts(content)
    for start, kind, read in (("word/", "docx", docx), ("xl/", "xlsx", xlsx), ("ppt/", "pptx", pptx)):
        if any(n.startswith(start) for n in p.names):
            return kind, *read(p)
    raise ValueError("an archive, but no office file")


def ingest(files: DataFrame) -> DataFrame:
    """name, kind, ok, reason, notes, blocks of files(name, content). Text and HTML are read natively, the rest in batches."""
    f = files.withColumn("kind", magic_format(F.col("content"))).withColumn("text", F.when(F.col("kind") == "text", F.decode("content", "UTF-8")))
    page = html.looks_like_html(F.col("text"))
    plain = f.where("kind = 'text'").select("name", F.when(page, "html").otherwise("text").alias("kind"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"), F.array_compact(F.array(F.when(page, html.region_note(F.col("text"))))).alias("notes"), F.when(page, blocks.segment(html.to_markdown(F.col("text")))).otherwise(F.array(blocks.block("raw", text=F.col("text")))).alias("blocks"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, kind, content in zip(b["name"], b["kind"], b["content"], strict=True):
                try:
                    if kind == "pdf":
                        found, notes = pdf(content)
                    elif kind == "zip":
                        kind, found, notes = office(content)
                    elif kind == "office":
                        raise ValueError("an office file of before 2007; save it in the newer format")
                    else:
                        raise ValueError(f"no text in a {kind} file")
                    rows.append((name, kind, True, None, notes, found))
                except Exception as e:  # a broken file is data, not a failure of the job
                    rows.append((name, kind, False, f"{type(e).__name__}: {e}", [], []))
            yield pd.DataFrame(rows, columns=["name", "kind", "ok", "reason", "notes", "blocks"])

    rest = f.where("kind <> 'text'").select("name", "kind", "content").mapInPandas(read, SCHEMA)
    return plain.union(rest)


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def pdf_of(pages: list[bytes], fonts: str, more: dict[int, bytes], head: bytes = b"") -> bytes:
    """A PDF of content streams; their objects are 10, 11, ..., those of the pages 100, 101, ..."""
    out = [b"%PDF-1.4", b"1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj", b"2 0 obj <</Type /Pages /Kids [%s]>> endobj" % b" ".join(b"%d 0 R" % (100 + i) for i in range(len(pages)))]
    for i, body in enumerate(pages):
        out.append(b"%d 0 obj <</Type /Page /Contents %d 0 R /Resources <</Font <<%s>> >> >> endobj" % (100 + i, 10 + i, fonts.encode()))
        out.append(b"%d 0 obj <<%s /Length %d>>\nstream\n%s\nendstream endobj" % (10 + i, head, len(body), body))
    out += [b"%d 0 obj %s endobj" % (n, body) for n, body in more.items()]
    return b"\n".join(out) + b"\n"


def pdf_fixture() -> bytes:
    """Glyph names, stated widths, a two-byte font, kerns, saved states, scaled text and a table, in ASCII85 over Flate."""
    text = rb"""q 1 0 0 1 10 0 cm BT /F1 10 Tf 62 760 Td (\001\002c \003) Tj ET Q
BT /F1 10 Tf 72 740 Td [(AB) -200 (A) -100 (B)] TJ 2 Tc (A) ' ET
BT /F2 12 Tf 1 0 0 1 72 700 Tm <00010002> Tj 14 TL T* <0003> Tj ET
"""
    cells_ = [("item", "units", "price"), ("bolt", "7", "1.50"), ("nut", "12", "0.25"), ("washer", "", "0.10")]
    for i, row in enumerate(cells_):
        for x, c in zip((72, 200, 300), row, strict=True):
            if c:
                text += b"BT /F3 10 Tf %d %d Td (%s) Tj ET\n" % (x, 600 - 14 * i, c.encode())
    body = base64.a85encode(zlib.compress(text)) + b"~>"
    cmap = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange"
    more = {
        50: b"<</Type /Font /Subtype /Type1 /FirstChar 65 /Widths [600 700] /Encoding <</BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni00DF /bullet]>> >>",
        51: b"<</Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [52 0 R] /ToUnicode 53 0 R>>",
        52: b"<</Type /Font /Subtype /CIDFontType2 /DW 1000 /W [1 [500 250]]>>",
        53: b"<</Length %d>>\nstream\n%s\nendstream" % (len(cmap), cmap),
        54: b"<</Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Body>>",
    }
    return pdf_of([body], "/F1 50 0 R /F2 51 0 R /F3 54 0 R", more, b"/Filter [/ASCII85Decode /FlateDecode]")


def pdf_pages() -> bytes:
    """Four pages with a running head and foot; the second and third are set in two columns."""
    pages = []
    for p in range(1, 5):
        rows = [(72, 760, f"Annual report {p}"), (72, 40, f"page {p} of 4")]
        rows += [(72, 700 - 14 * k, f"p{p} left {k} of the text") for k in range(6)]
        rows += [(340, 700 - 14 * k, f"p{p} right {k} of the text") for k in range(6)] if p in (2, 3) else []
        pages.append(b"\n".join(b"BT /F3 10 Tf %d %d Td (%s) Tj ET" % (x, y, t.encode()) for x, y, t in rows))
    return pdf_of(pages, "/F3 54 0 R", {54: b"<</Type /Font /Subtype /Type1>>"})


def fixtures() -> list[tuple[str, bytes]]:
    """One small file of every kind, made here."""
    w = 'xmlns:w="w" xmlns:r="r"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Report</w:t></w:r></w:p><w:p><w:r><w:t>Kept </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>added</w:t></w:r></w:ins></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    book = {
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="Sales" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Type="x/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>day</t></si><si><r><t>uni</t></r><r><t>ts</t></r></si></sst>",
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" s="1"><v>45000</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>',
    }
    show = {
        "ppt/presentation.xml": '<p xmlns:r="r"><sldIdLst><sldId r:id="a"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="a" Type="x/slide" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": '<sld xmlns:a="a"><sp><ph type="title"/><a:p><a:r><a:t>Plan</a:t></a:r></a:p></sp><sp><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:r><a:t>two</a:t></a:r></a:p></sp></sld>',
    }
    said = f'<w:document {w}><w:body><w:p><w:r><w:t>Before </w:t></w:r><w:commentRangeStart w:id="4"/><w:r><w:t>the anchor</w:t></w:r><w:commentRangeEnd w:id="4"/><w:r><w:t> after.</w:t></w:r></w:p></w:body></w:document>'
    comments = f'<w:comments {w}><w:comment w:id="4" w:author="Ann"><w:p><w:r><w:t>Check this</w:t></w:r></w:p></w:comment></w:comments>'
    stream = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Hello) Tj 0 -14 Td [(Wor) -20 (ld) -300 (again)] TJ ET")
    pdf_file = b"%%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R]>> endobj\n3 0 obj <</Type /Page /Contents 4 0 R /Resources <</Font <</F1 5 0 R>> >> >> endobj\n4 0 obj <</Filter /FlateDecode /Length %d>>\nstream\n%s\nendstream endobj\n5 0 obj <</Type /Font /Subtype /Type1>> endobj\n" % (len(stream), stream)
    return [
        ("a.docx", archive({"word/document.xml": doc})), ("b.xlsx", archive(book)), ("c.pptx", archive(show)), ("d.pdf", pdf_file), ("e.txt", b"plain\ntext"),
        ("f.html", b"<html><body><main><h1>Title</h1><p>" + b"Some text of the page. " * 12 + b"</p></main><footer>x</footer></body></html>"),
        ("l.docx", archive({"word/document.xml": said, "word/comments.xml": comments})), ("m.pdf", pdf_fixture()), ("n.pdf", pdf_pages()),
        ("g.png", bytes.fromhex("89504E470D0A1A0A00")), ("h.doc", bytes.fromhex("D0CF11E0A1B11AE1")), ("i.zip", archive({"x.txt": "x"})), ("j.bin", b"\x01\x00\x02"), ("k.pdf", b"%PDF-1.4 nothing"),
    ]
