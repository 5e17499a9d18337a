"""Personal data by weak supervision: labelers vote on candidate spans, EM learns how far to trust each, a classifier decides.

Base spans follow fixed patterns and checks and always stay. Further candidates (long mixed tokens, long numbers, any
token or number that an announcing word leads to) get votes from a pattern, a gazetteer, a context, a variety and a
checksum labeler. The corpus is counted by vote pattern, so that expectation-maximisation sees every candidate of every
document through a table of bounded size. The classifier is taught EM's verdicts, but looks at what no labeler asks
about: how a span begins, ends and is made up, and what follows it. So it finds the unannounced fellows of announced
spans, and settles where the labelers abstain or disagree.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

#: Base kinds in their order, then the kinds that the method adds.
KINDS = ("email", "ip", "card", "phone", "secret", "account")
BASE = 4
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MIXED = re.compile(r"[A-Za-z0-9_/+-]{16,}")
HEX = re.compile(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})\Z")
#: Gazetteer: words that announce a credential or an account.
ANNOUNCE = {
    "secret": {"token", "secret", "password", "passwd", "pwd", "key", "apikey", "api", "bearer", "auth", "credential", "credentials", "contraseña", "passwort", "schlüssel", "clé"},
    "account": {"account", "acct", "iban", "card", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn", "customer", "kunde", "client", "cliente"},
}
#: The end of what stands before a value: a word, = or : (for numbers a blank may do), an opening quote.
LEAD = re.compile(r"([^\W\d_]+)[\"'`]?[ \t]*([=:]?)[ \t]*[\"'`]?\Z")
VALUE = re.compile(r"[=:][ \t]*[\"'`]?([^\s\"'`,;]+)")
VOTES = 5
NEAR = 32
WORD = re.compile(r"[^\W\d_]+")
#: What the classifier looks at: so many features a span, hashed into so many weights a kind.
FEATURES = 10
WEIGHTS = 1 << 13


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards, so that long runs without one cost nothing."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = at = m.end()
        else:
            at += 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans (start, kind, end) in order, and the number matches that are no card."""
    out = [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        for m in IP.finditer(text):
            if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
    numbers = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
        elif len(digits) >= 9:
            numbers.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdecimal() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out, numbers


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def votes(kind: str, text: str, start: int, end: int) -> list[int]:
    """Votes (1 for, -1 against, 0 none) of: pattern, gazetteer, context, variety, checksum."""
    s, before = text[start:end], text[max(0, start - NEAR) : start]
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    near = before.rstrip(" \t\"'`")
    mark = near[-1:]
    if kind == "secret":
        digit, letter = any(c.isdigit() for c in s), any(c.isalpha() for c in s)
        pattern = 1 if HEX.match(s) or digit and letter and any(c.isupper() for c in s) and any(c.islower() for c in s) else 0 if digit and letter else -1
        check = 1 if len(s) in (32, 40, 64) else 0
    else:
        digits = s.replace(" ", "").replace("-", "")
        pattern = 1 if len(digits) >= 15 else 0 if len(digits) >= 11 else -1
        check = 1 if luhn(digits) and len(digits) > 19 else -1
    context = 1 if mark in ("=", ":") else -1 if mark in ("/", "#", "$", "€", "%") else 0
    h = entropy(s)
    variety = 1 if h >= 3 else -1 if h < 2 else 0
    return [pattern, 1 if ANNOUNCE[kind] & set(words) else 0, context, variety, check]


def cell(kind: int, vote: list[int]) -> int:
    """Kind and votes in one number."""
    c = kind
    for v in vote:
        c = c * 3 + v + 1
    return c


def parts(c: int) -> tuple[int, list[int]]:
    vote = []
    for _ in range(VOTES):
        c, v = divmod(c, 3)
        vote.append(v - 1)
    return c, vote[::-1]


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Hashed features of a span and of what follows it, none of which is a labeler's question."""
    s = text[start:end]
    after = text[end : end + NEAR]
    classes = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in s]
    runs = [c for c, d in zip(classes, [None, *classes], strict=False) if c != d]
    follow = WORD.findall(after.lower())
    share = lambda n: round(4 * n / len(s))
    own = (
        "start " + s[:2],
        "head " + s[:4],
        "tail " + s[-2:],
        "runs " + "".join(runs[:6]),
        f"changes {share(len(runs))}",
        f"digits {share(classes.count('0'))} capitals {share(classes.count('A'))}",
        f"vowels {share(sum(c in 'aeiou' for c in s.lower()))}",
        f"length {len(s).bit_length()}",
        "next " + (follow[0] if follow else ""),
        "after " + after[:1],
    )
    return [zlib.crc32(f"{kind} {x}".encode("utf-8", "surrogatepass")) % WEIGHTS for x in own]


def announced(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of tokens after a word for a credential and = or :, and of numbers after a word for an account."""
    for kind, found in ((4, VALUE.finditer(text)), (5, CARD.finditer(text))):
        for m in found:
            a, b = m.span(1) if kind == 4 else m.span()
            lead = LEAD.search(text, max(0, a - NEAR), a)
            if lead and (kind == 5 or lead[2]) and lead[1].lower() in ANNOUNCE[KINDS[kind]] and (value := text[a:b].rstrip(".:!?)]}>")):
                yield a, kind, a + len(value)


def candidates(text: str, base: list[tuple[int, int, int]], numbers: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """(start, kind, end, cell, *features) of what the labelers are asked about: outside base spans, outside each other."""
    found = [(m.start(), 4, m.end()) for m in MIXED.finditer(text) if any(c.isdigit() for c in m[0])]
    found += [(a, 5, b) for a, b in numbers]
    known = {a for a, _, _ in found}
    found += [x for x in announced(text) if x[0] not in known]
    out: list[tuple[int, ...]] = []
    taken = sorted((a, b) for a, _, b in base)
    done, i, reach = 0, 0, 0
    for a, k, b in sorted(found, key=lambda x: (x[0], -x[2], x[1])):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if a >= done and a >= reach:
            out.append((a, k, b, cell(k, votes(KINDS[k], text, a, b)), *features(KINDS[k], text, a, b)))
            done = b
    return out


def fit_labelers(cells: dict[int, int], rounds: int = 60) -> dict[int, float]:
    """Expectation-maximisation over vote patterns, one kind at a time: the probability that a cell's spans are personal data.

    Given the truth, labelers vote independently; the prior and each labeler's table of votes are re-estimated
    from all counts with add-one smoothing, from a start at the majority vote.
    """
    out: dict[int, float] = {}
    for kind in range(BASE, len(KINDS)):
        own = [c for c in cells if parts(c)[0] == kind]
        if not own:
            continue
        n = np.array([cells[c] for c in own], float)
        v = np.array([parts(c)[1] for c in own]) + 1
        p = 1 / (1 + np.exp(-1.5 * (v - 1).sum(1)))
        for _ in range(rounds):
            prior = ((n * p).sum() + 1) / (n.sum() + 2)
            like = np.stack([np.full(len(own), np.log(1 - prior)), np.full(len(own), np.log(prior))])
            for j in range(VOTES):
                for y, q in enumerate((1 - p, p)):
                    t = np.array([(n * q)[v[:, j] == k].sum() + 1 for k in range(3)])
                    like[y] += np.log(t / t.sum())[v[:, j]]
            p = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        out |= dict(zip(own, p.tolist(), strict=True))
    return out


def train_classifier(x: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 2.0) -> np.ndarray:
    """Weights (the last is the bias) of a logistic regression from hashed features (a row a span) to EM's verdicts."""
    n = len(x)
    w, m, r = (np.zeros(WEIGHTS + 1) for _ in range(3))
    if not n:
        return w
    at = x.ravel()
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(1) + w[-1], -30, 30)))
        g = np.bincount(at, np.repeat(p - y, x.shape[1]), WEIGHTS + 1)
        g[-1] = (p - y).sum()
        g = (g + l2 * w) / n
        m += 0.1 * (g - m)
        r += 0.01 * (g * g - r)
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(r / (1 - 0.99**step)) + 1e-9)
    return w


def decided(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The classifier's probability for each row of features."""
    return 1 / (1 + np.exp(-np.clip(w[x].sum(1) + w[-1], -30, 30)))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(spark: SparkSession, docs: DataFrame, scratch: Scratch, *, least: float = 0.5, taught: int = 20_000) -> DataFrame:
    """One row per row of `docs`: doc_id, counts by kind (n_email to n_account), base (string), spans (string), n_spans.

    Offsets are code points, ends exclusive; spans are ordered by start, then kind. Null and empty texts have no
    spans. Null and repeated ids are carried as they are, a row for a row; other columns are not looked at. Without
    candidates nothing is learned and only base spans remain. Texts are read once and never shuffled. EM counts the
    candidates of all documents; the classifier is taught on at most `taught` of them, the first by a hash.
    """
    width = 4 + FEATURES
    counts = [f"n_{k}" for k in KINDS]

    # Ids stay in Arrow, so that long ones beside null ones keep their digits.
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_base, all_more = [], []
            for text in b.column("text").to_pylist():
                base, numbers = base_spans(text or "")
                all_base.append([x for s in base for x in s])
                all_more.append([x for s in candidates(text or "", base, numbers) for x in s])
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "base": pa.array(all_base, pa.list_(pa.int32())), "more": pa.array(all_more, pa.list_(pa.int32()))})

    found = scratch.put(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(look, "doc_id long, base array<int>, more array<int>"))
    at = F.explode(F.sequence(F.lit(1), F.size("more"), F.lit(width)))
    asked = found.where(F.size("more") > 0).select("doc_id", "more", at.alias("at")).select("doc_id", F.slice("more", F.col("at"), width).alias("c"))
    # Cells are a fixed set: kinds x 3^votes.
    cells = {r["cell"]: r["n"] for r in asked.groupBy(F.col("c")[3].alias("cell")).agg(F.count("*").alias("n")).collect()}
    truth = fit_labelers(cells)
    some = [r["c"] for r in asked.orderBy(F.xxhash64("doc_id", F.col("c")[0]), "c").limit(taught).select("c").collect()]
    x = np.array([c[4:] for c in some], np.int64).reshape(-1, FEATURES)
    weights = spark.sparkContext.broadcast(train_classifier(x, np.array([truth[c[3]] for c in some])))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for b in batches:
            rows = []
            for base, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist(), strict=True):
                own = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                more = np.array(more, np.int64).reshape(-1, width)
                spans = sorted([*own, *map(tuple, more[decided(w, more[:, 4:]) >= least, :3].tolist())]) if len(more) else own
                n = Counter(k for _, k, _ in spans)
                rows.append((*(n[k] for k in range(len(KINDS))), joined(own), joined(spans), len(spans)))
            made = dict(zip([*counts, "base", "spans", "n_spans"], zip(*rows, strict=True), strict=True)) if rows else {}
            kinds = dict.fromkeys(counts, pa.int64()) | {"base": pa.string(), "spans": pa.string(), "n_spans": pa.int64()}
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id")} | {name: pa.array(made.get(name, []), kind) for name, kind in kinds.items()})

    return found.mapInArrow(decide, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base string, spans string, n_spans long")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
