"""Masking the variable parts of a line: a template with typed slots, and the raw values that fill them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import B, duck_re

# What is masked and as what, in order of precedence; `{b}` is a word border.
SLOTS = [
    ("ts", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("ts", r"{b}\d{2}:\d{2}:\d{2}(?:\.\d{1,9})?{b}"),
    ("id", r"{b}[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}{b}"),
    ("path", r"(?:[A-Za-z]:)?[\\/](?:[\w.-]+[\\/])+[\w.-]+"),
    ("ip", r"{b}\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?{b}"),
    ("id", r"{b}(?:0x)?[0-9a-fA-F]{8,}{b}"),
    ("str", r'"[^"\n]*"'),
    ("n", r"{b}\d+(?:\.\d+)?(?:ms|s|m|h|kb|mb|gb|KB|MB|GB|%)?{b}"),
]
SLOT = r"<(?:ts|id|ip|path|str|n)>"
ANY = "|".join(f"(?:{p})" for _, p in SLOTS)
KEY_SEP = "\x00"


def slot_type(value: Column) -> Column:
    out = None
    for kind, pattern in SLOTS[:-1]:
        hit = value.rlike(f"^(?:{pattern.replace('{b}', B)})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("n")


def mask(line: Column) -> Column:
    """template and values of a line, found in one pass over it; the values are the text as it stood."""
    pattern = ANY.replace("{b}", B)
    values = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    between = F.split(line, pattern, -1)
    filled = F.zip_with(between, values, lambda p, v: F.concat(p, F.when(v.isNull(), "").otherwise(F.concat(F.lit("<"), slot_type(v), F.lit(">")))))
    return F.struct(F.array_join(filled, "").alias("template"), values.alias("values"))


def unmask(template: Column, values: Column) -> Column:
    """The line again; slots without a value become empty, values without a slot are left out."""
    between = F.split(template, SLOT, -1)
    own = F.slice(values, F.lit(1), F.greatest(F.size(between) - 1, F.lit(0)))
    return F.array_join(F.zip_with(between, own, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")


def slot_count(template: Column) -> Column:
    return F.regexp_count(template, F.lit(SLOT))


def anchor_tokens(template: Column, n: int = 3) -> Column:
    """The first tokens that are more than a slot."""
    return F.slice(F.filter(F.split(template, r"\s+", -1), lambda t: (t != "") & ~t.rlike(f"^{SLOT}$")), 1, n)


def template_key(template: Column, key: str = "anchors3") -> Column:
    """What lines of one format share: token count and first three anchors, or (`key="template"`) the whole template."""
    if key == "template":
        return template
    return F.concat_ws(KEY_SEP, F.size(F.split(template, r"\s+", -1)).cast("string"), anchor_tokens(template))


# The same in DuckDB's SQL.
DUCK_ANY = duck_re(ANY)


def duck_mask(line: str) -> tuple[str, str]:
    """(template, values) as SQL."""
    values = f"regexp_extract_all({line}, '{DUCK_ANY}')"
    case = " ".join(f"WHEN regexp_full_match(v, '{duck_re(p)}') THEN '<{k}>'" for k, p in SLOTS[:-1])
    slots = f"list_transform({values}, lambda v: CASE {case} ELSE '<n>' END)"
    between = f"regexp_split_to_array({line}, '{DUCK_ANY}')"
    return f"array_to_string(list_transform(list_zip({between}, {slots}), lambda z: z[1] || coalesce(z[2], '')), '')", values
