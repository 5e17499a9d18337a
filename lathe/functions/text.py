"""Lines, kinds, salience, ranks, token estimates and ends of a text, as Columns. Lengths are code points."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: A word border in ASCII terms, whatever the regular-expression engine takes for a word.
B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
# The phrases that make a line salient, noise, or ranked. `{b}` is a word border.
SALIENT = r"(?i){b}(error|err|fail(ed|ure)?|fatal|exception|panic|traceback|refus|denied|timeout|timed out|cannot|unable|missing|not found|undefined|null pointer|warn(ing)?|deprecat){b}"
NOISE = r"(?i)^\s*(at\s+node:internal|npm (WARN|notice)|added \d+ packages|Downloading|Fetching|Progress:|\d+% ?\|)"
RANKS = [
    (3, r"(?i){b}not ok{b}"),
    (3, r"(?i){b}(?:error|fail(?:ed|ure)?|exception|panic|fatal|assert(?:ion)?|refused|denied|timeout|traceback){b}"),
    (2, r"(?i){b}(?:warn(?:ing)?|deprecat|skipped|todo|retry|retrying){b}"),
    (2, r"(?i)^\s*#?\s*(?:tests?|pass|fail|suites?|duration_ms|cancelled|skipped){b}"),
    (1, r"^\s*(?:[-=*]{3,}|#{1,6}\s|\d+\)\s|at\s)"),
]
# The signs of each kind of text, tried in this order after valid JSON; True: only in the first 2,000 characters.
KINDS = [
    ("diff", [(r"(?m)^(diff --git|index [0-9a-f]{7,}|@@ -\d+)", True)]),
    ("test", [(r"(?m)^(ok|not ok)\s+\d+", True), (r"# (pass|fail|tests)\s+\d+", False), (r"(?i){b}\d+ (passing|failing|passed|failed){b}", False)]),
    ("stacktrace", [(r"(?m)^\s+at .+\(.+:\d+:\d+\)$", False), (r"(?m)^[A-Za-z.]*Error:", True)]),
    ("listing", [(r"(?m)^[-d rwx@]{10}\s", True), (r"(?m)^(total \d+|Directory of )", True)]),
]
HEAD = 2000


def spark_re(pattern: str) -> str:
    return pattern.replace("{b}", B)


def duck_re(pattern: str) -> str:
    return pattern.replace("{b}", r"\b")


def unify(text: Column) -> Column:
    """LF line ends; null counts as empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def lines(text: Column) -> Column:
    """Lines of a text without its final line end; an empty text has none."""
    t = unify(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.when(t.endswith("\n"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t), "\n", -1))


def line_set(text: Column) -> Column:
    """lines, trailing (ends with a line end), crlf (has CRLF): what `join_lines` needs to give the text back."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(lines(text).alias("lines"), unify(text).endswith("\n").alias("trailing"), t.contains("\r\n").alias("crlf"))


def join_lines(s: Column) -> Column:
    body = F.when(F.size(s["lines"]) == 0, F.lit("")).otherwise(F.concat(F.array_join(s["lines"], "\n"), F.when(s["trailing"], "\n").otherwise("")))
    return F.when(s["crlf"], F.replace(body, F.lit("\n"), F.lit("\r\n"))).otherwise(body)


def is_salient(line: Column) -> Column:
    return line.rlike(spark_re(SALIENT))


def is_noise(line: Column) -> Column:
    return line.rlike(spark_re(NOISE))


def rank(line: Column) -> Column:
    """0 ordinary, 1 structure, 2 warning or summary, 3 failure; words are parted at lower-to-upper borders first."""
    apart = F.regexp_replace(line, "([a-z])([A-Z])", "$1 $2")
    out = None
    for r, pattern in RANKS:
        hit = apart.rlike(spark_re(pattern))
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return out.otherwise(0)


def is_interesting(line: Column) -> Column:
    return rank(line) > 0


def parses(text: str | None) -> bool:
    def refuse(x: str) -> float:
        raise ValueError(x)

    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, TypeError, RecursionError):
        return False
    return True


def _valid(texts: pd.Series) -> pd.Series:
    return texts.map(parses)


def valid_json(text: Column) -> Column:
    """Strict JSON: no NaN, nothing after the value. There is no built-in for it; null is passed for texts that can't be."""
    return F.pandas_udf(_valid, BooleanType())(text)


def may_be_json(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^\s*[\[{]")


def detect_kind(text: Column) -> Column:
    """json, diff, test, stacktrace, listing or log: the first whose signs are there."""
    t = F.coalesce(text, F.lit(""))
    head = F.substring(t, 1, HEAD)
    out = F.when(valid_json(F.when(may_be_json(t), t)), "json")
    for kind, signs in KINDS:
        hit = None
        for pattern, in_head in signs:
            own = (head if in_head else t).rlike(spark_re(pattern))
            hit = own if hit is None else hit | own
        out = out.when(hit, kind)
    return out.otherwise("log")


def estimate_tokens(text: Column) -> Column:
    """A word a token for each four characters, at least one; a symbol one; a line end one. 0 for null."""
    t = F.coalesce(text, F.lit(""))
    words = F.aggregate(F.regexp_extract_all(t, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lit(0).cast("long"), lambda n, w: n + F.greatest(F.lit(1), F.ceil(F.length(w) / 4)))
    return words + F.regexp_count(t, F.lit(r"[^A-Za-z0-9_\s]")) + F.regexp_count(t, F.lit("\n"))


def chars_for_tokens(tokens: Column) -> Column:
    return F.greatest(F.lit(200).cast("long"), F.floor(tokens * F.lit(3.6).cast("double") + F.lit(0.5).cast("double")))


def head_tail(text: Column, budget: Column | int) -> Column:
    """Both ends of a text that is longer than its budget, and how much is missing between them."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    half = F.greatest(F.lit(200), F.floor((budget - 60) / 2)).cast("int")
    n = F.length(text)
    gone = (n - half * 2).cast("string")
    cut = F.concat(F.left(text, half), F.lit("\n\n…[compressed: "), gone, F.lit(" chars omitted from the middle]…\n\n"), F.right(text, half))
    return F.when(n <= budget, text).otherwise(cut)


def ratio(before: Column, after: Column) -> Column:
    """after / before to three places; 1 for an empty text."""
    return F.when(before > 0, F.round(after / before, 3)).otherwise(F.lit(1.0))


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before > 0, F.round((before - after) * 100 / before, 1)).otherwise(F.lit(0.0))
