"""HTML to Markdown in regular expressions and higher-order functions, row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that go with all they hold, and entities by name.
DROP = ["script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "nav", "header", "footer", "aside", "form", "button", "select", "dialog"]
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "deg": "°", "euro": "€", "pound": "£", "middot": "·",
}
TAGS = "div|p|span|a|table|ul|ol|li|h[1-6]|section|article|main|script|style"
HEAD = 4000
MAIN = 200


def element(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often it is named: plans don't grow with nesting."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def each(text: Column, pattern: str, make: Callable[[Column], Column]) -> Column:
    """The text with every match of `pattern` replaced by what `make` gives for it."""
    return let(text, lambda t: F.aggregate(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0))), t, lambda s, m: F.replace(s, m, make(m))))


def looks_like_html(text: Column) -> Column:
    """A document type or root at the start, or three different known tags in the first 4,000 characters."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, HEAD)
    tags = F.regexp_extract_all(F.lower(head), F.lit(rf"</?({TAGS})\b"), F.lit(1))
    return head.rlike(r"(?i)^\s*<(?:!doctype html|html|head|body)\b") | (F.size(F.array_distinct(tags)) >= 3)


def main_region(html: Column) -> Column:
    """What <main> or else <article> holds, if that is more than 200 characters; else the body; else all."""
    return let(html, _main_region)


def _main_region(html: Column) -> Column:
    out = None
    for tag in ("main", "article"):
        inner = F.regexp_extract(html, element(tag), 1)
        out = F.when(F.length(inner) > MAIN, inner) if out is None else out.when(F.length(inner) > MAIN, inner)
    return out.when(html.rlike(element("body")), F.regexp_extract(html, element("body"), 1)).otherwise(html)


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?i)<!doctype[^>]*>", " ")


def drop_elements(html: Column, tags: list[str] = DROP) -> Column:
    """Without these elements, tag by tag, however deep they are nested, and without stray opening tags of theirs.

    One pass takes all elements of a tag that are not nested; where one opens within another there are as many passes
    as there are closing tags. The passes are one fold over (tag, last pass), so the plan stays flat.
    """

    def pattern(before: str, tag: Column, *rest: Column | str) -> Column:
        return F.concat(F.lit(before), tag, *[F.lit(x) if isinstance(x, str) else x for x in rest])

    def folded(h: Column) -> Column:
        def passes(tag: Column) -> Column:
            nested = pattern("(?is)<", tag, r"\b[^>]*>(?:(?!</", tag, r"\b).)*?<", tag, r"\b")
            n = F.when(F.regexp_like(h, nested), F.greatest(F.lit(1), F.regexp_count(h, pattern("(?i)</", tag, r"\s*>")))).otherwise(1)
            return F.transform(F.array_repeat(tag, n), lambda t, i: F.struct(t.alias("tag"), (i + 1 == n).alias("last")))

        def step(s: Column, x: Column) -> Column:
            less = F.regexp_replace(s, pattern("(?is)<", x["tag"], r"\b[^>]*>.*?</", x["tag"], r"\s*>"), F.lit(" "))
            return F.when(x["last"], F.regexp_replace(less, pattern("(?i)<", x["tag"], r"\b[^>]*/?>"), F.lit(" "))).otherwise(less)

        return F.aggregate(F.flatten(F.transform(F.array(*map(F.lit, tags)), passes)), h, step)

    return let(html, folded)


def code_point(n: Column, other: Column) -> Column:
    fine = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(F.when(fine, n).otherwise(32)), 8, "0")), "UTF-32")).otherwise(other)


def decode_entities(text: Column) -> Column:
    """Hexadecimal, decimal and named entities, in this order; what is unknown or out of range stays."""
    text = each(text, r"&#x[0-9a-fA-F]+;", lambda m: code_point(F.conv(F.regexp_extract(m, "x([0-9a-fA-F]{1,8})", 1), 16, 10).cast("long"), m))
    text = each(text, r"&#[0-9]+;", lambda m: code_point(F.regexp_extract(m, "#([0-9]{1,9})", 1).cast("long"), m))
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    return each(text, r"&[a-zA-Z]+;", lambda m: F.coalesce(F.try_element_at(names, F.lower(F.regexp_replace(m, "[&;]", ""))), m))


def strip_tags(text: Column, by: str = "") -> Column:
    return F.regexp_replace(text, "<[^>]+>", by)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def rows_of(table: Column) -> Column:
    """array<array<string>> of the cells of a table, rows without cells left out."""
    rows = F.regexp_extract_all(table, F.lit(element("tr")), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<(t[hd])\b[^>]*>(.*?)</\1\s*>"), F.lit(2)), lambda c: decode_entities(collapse(strip_tags(c, " ")))))
    return F.filter(cells, lambda r: F.size(r) > 0)


def pad_rows(rows: Column) -> Column:
    widest = lambda rs: F.array_max(F.transform(rs, lambda r: F.size(r)))
    return let(rows, lambda rs: F.transform(rs, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest(rs) - F.size(r)))))


def table_markdown(table: Column) -> Column:
    return let(pad_rows(F.transform(rows_of(table), lambda r: F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))))), _drawn)


def _drawn(rows: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    head = F.get(rows, F.lit(0))
    ruled = F.concat(F.array(line(head), line(F.array_repeat(F.lit("---"), F.size(head)))), F.transform(F.slice(rows, F.lit(2), F.size(rows)), line))
    return F.when(F.size(rows) > 0, F.concat(F.lit("\n\n"), F.array_join(ruled, "\n"), F.lit("\n\n"))).otherwise("")


def list_markdown(block: Column, ordered: bool) -> Column:
    items = F.transform(F.regexp_extract_all(block, F.lit(element("li")), F.lit(1)), F.trim)
    mark = (lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)) if ordered else (lambda x, i: F.concat(F.lit("- "), x))
    return F.concat(F.lit("\n\n"), F.array_join(F.transform(items, mark), "\n"), F.lit("\n\n"))


def links(text: Column) -> Column:
    """<a> as [label](target); labels alone where there is no target or one on the page."""

    def one(m: Column) -> Column:
        href = F.coalesce(*[F.nullif(F.regexp_extract(m, rf"(?is)^<a\b[^>]*\bhref\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s>\"']+)")], F.lit(""))
        label = collapse(strip_tags(m))
        return let(F.struct(href.alias("href"), label.alias("label")), lambda x: shown(x["href"], x["label"]))

    def shown(href: Column, label: Column) -> Column:
        return F.when((href == "") | href.startswith("#"), label).when(label == "", href).otherwise(F.concat(F.lit("["), label, F.lit("]("), href, F.lit(")")))

    return each(text, r"(?is)<a\b[^>]*>.*?</a\s*>", one)


def inline(text: Column) -> Column:
    text = links(text)
    for tags, mark in (("strong|b", "**"), ("em|i", "*")):
        text = each(text, rf"(?is)<({tags})\b[^>]*>.*?</\1\s*>", lambda m, k=mark: F.concat(F.lit(k), F.trim(strip_tags(m)), F.lit(k)))
    text = F.regexp_replace(text, r'(?i)<img\b[^>]*\balt\s*=\s*"\s*([^"]*[^"\s])\s*"[^>]*/?>', "[image: $1]")
    return F.trim(F.regexp_replace(decode_entities(strip_tags(text)), "[ \t]+", " "))


def structure(html: Column) -> Column:
    """Blocks as Markdown, still with inline tags."""
    s = each(html, r"(?is)<table\b[^>]*>.*?</table\s*>", table_markdown)
    s = each(s, r"(?is)<pre\b[^>]*>.*?</pre\s*>", lambda m: F.concat(F.lit("\n\n```\n"), strip_tags(m), F.lit("\n```\n\n")))
    s = each(s, r"(?is)<code\b[^>]*>.*?</code\s*>", lambda m: F.concat(F.lit("`"), strip_tags(m), F.lit("`")))
    for n in range(6, 0, -1):
        s = F.regexp_replace(s, rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    s = each(s, r"(?is)<ol\b[^>]*>.*?</ol\s*>", lambda m: list_markdown(m, True))
    s = each(s, r"(?is)<ul\b[^>]*>.*?</ul\s*>", lambda m: list_markdown(m, False))
    s = F.regexp_replace(s, r"(?is)<blockquote\b[^>]*>\s*(.*?)\s*</blockquote\s*>", "\n\n> $1\n\n")
    s = F.regexp_replace(s, r"(?i)<hr\b[^>]*/?>", "\n\n---\n\n")
    s = F.regexp_replace(F.regexp_replace(s, r"(?i)</p\s*>", "\n\n"), r"(?i)<p\b[^>]*>", "")
    return F.regexp_replace(s, r"(?i)<br\b[^>]*/?>", "\n")


def to_markdown(html: Column) -> Column:
    """The main region of a page as Markdown, page furniture left out. Null counts as empty."""
    s = drop_elements(main_region(strip_comments(F.coalesce(html, F.lit("")))))
    md = F.replace(inline(structure(s)), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(md, r"[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def region_note(html: Column) -> Column:
    s = strip_comments(F.coalesce(html, F.lit("")))
    return F.when(let(s, lambda t: F.length(main_region(t)) < F.length(t) * 0.6), "Only the main content region was read; page furniture was skipped.")
