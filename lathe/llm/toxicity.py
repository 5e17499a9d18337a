"""Toxicity by a factorization machine over hashed terms.

Terms are words and beginnings of words; a document's value of a term is log(1 + occurrences). Besides a weight each
term has a short vector, and the products of two terms' vectors weigh their meeting in one document: an insult with
the mention of a group, or two weak signs that are harmless alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch

WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """`positives` and `negatives` bound the labelled rows that are fitted, taken in the order of a hash of their id."""

    positives: int = 2500
    negatives: int = 5000
    buckets: int = 1 << 20
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 7, 8)
    terms: int = 1500
    least_z: float = 3.0
    factors: int = 4
    epochs: int = 300
    l2: float = 3e-4
    rate: float = 0.03
    threshold: float = 0.7
    seed: int = 7


@dataclass
class Model:
    bias: float
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))
    v: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.v
        return self.bias + x @ self.w + 0.5 * (z * z - (x * x) @ (self.v * self.v)).sum(1)


class Terms:
    """Buckets of a word, looked up once a worker. With `keep`, only the positions of those buckets."""

    def __init__(self, s: Settings, keep: np.ndarray | None = None) -> None:
        self.s, self.known = s, {}
        self.at = None if keep is None else {int(b): i for i, b in enumerate(keep)}

    def of(self, word: str) -> tuple[int, ...]:
        if (hit := self.known.get(word)) is not None:
            return hit
        import xxhash

        own = ["=" + word] + [f"{n}^{word[:n]}" for n in self.s.prefixes if len(word) > n]
        got = tuple(xxhash.xxh64_intdigest(t.encode()) % self.s.buckets for t in own)
        if self.at is not None:
            got = tuple(i for b in got if (i := self.at.get(b)) is not None)
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = got
        return got

    def count(self, text: str | None) -> Counter:
        total: Counter = Counter()
        of = self.of
        for word in WORDS.findall((text or "").lower()):
            for b in of(word):
                total[b] += 1
        return total


def trainable(labels: DataFrame, label: str = "toxic") -> DataFrame:
    """(doc_id, y) of the labelled rows that may be learned from; an id that is marked both ways counts as marked 1."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (rest != 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, s: Settings | None = None) -> Model:
    """Learn from a bounded number of labelled documents, their whole texts; the rest of the corpus doesn't matter.

    Without rows of both classes the model is a constant: the share of marked rows, at one half to begin with.
    """
    s = s or Settings()
    own = trainable(labels)
    by_hash = F.xxhash64("doc_id")
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    base = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(float(np.log(base / (1 - base))))
    pick = own.where("y = 1").orderBy(by_hash, "doc_id").limit(s.positives).union(own.where("y = 0").orderBy(by_hash, "doc_id").limit(s.negatives))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = Terms(s)
        for b in batches:
            got = [t.count(x) for x in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "b": [list(g.keys()) for g in got], "n": [list(g.values()) for g in got]})

    # At most positives + negatives ids: a bound that doesn't grow with the corpus.
    chosen = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    counted = scratch.put(chosen.mapInPandas(terms, "doc_id long, y int, b array<int>, n array<int>").groupBy("doc_id").agg(F.min(F.struct("y", "b", "n")).alias("r")).select("doc_id", "r.*"))
    m1, m0 = (counted.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()[i] or 0 for i in (0, 1))
    if not m0 or not m1:
        return Model(float(np.log(base / (1 - base))))
    keep = screened(counted, m0, m1, s)

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {int(b): i for i, b in enumerate(keep)}
        for b in batches:
            got = [[(at[x], k) for x, k in zip(own, n, strict=True) if x in at] for own, n in zip(b["b"], b["n"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"], "x": [np.array([v for p in g for v in p], np.int32).tobytes() for g in got]})

    rows = counted.mapInPandas(kept, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), len(keep)), np.float32)
    for i, r in enumerate(rows):
        own = np.frombuffer(r["x"], np.int32).reshape(-1, 2)
        x[i, own[:, 0]] = np.log1p(own[:, 1])
    y = np.array([r["y"] for r in rows], float)
    del rows
    return learn(x, y, keep, n0 / m0, n1 / m1, s)


def screened(counted: DataFrame, m0: int, m1: int, s: Settings) -> np.ndarray:
    """The buckets that the classes have most unevenly, by a two-proportion z-test; counted where the rows are."""
    d = counted.select("y", F.explode("b").alias("b")).groupBy("b").agg(F.sum("y").alias("d1"), F.sum(1 - F.col("y")).alias("d0")).where("d1 + d0 >= 3")
    p = (F.col("d1") + F.col("d0")) / (m1 + m0)
    z = F.abs(F.col("d1") / m1 - F.col("d0") / m0) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / m1 + 1 / m0))
    best = d.withColumn("z", z).where(F.col("z") >= s.least_z).orderBy(F.col("z").desc(), "b").limit(s.terms)
    return np.array(sorted(r["b"] for r in best.select("b").collect()), np.int64)


def learn(x: np.ndarray, y: np.ndarray, keep: np.ndarray, w0: float, w1: float, s: Settings) -> Model:
    """Fit the machine by Adam on all rows at once; w0 and w1 weigh the classes back to their shares."""
    weight = np.where(y == 1, w1, w0)
    prior = np.log((w1 * (y == 1).sum()) / (w0 * (y == 0).sum()))
    weight = (weight / weight.mean()).astype(np.float32)
    rng = np.random.default_rng(s.seed)
    theta = [np.array([prior], np.float32), np.zeros(len(keep), np.float32), rng.normal(0, 0.01, (len(keep), s.factors)).astype(np.float32)]
    m, r = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    xx = x * x
    for step in range(1, s.epochs + 1):
        b, w, v = theta
        xv = x @ v
        f = b + x @ w + 0.5 * (xv * xv - xx @ (v * v)).sum(1)
        g = (weight * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - y) / len(y)).astype(np.float32)
        grads = [np.array([g.sum()], np.float32), x.T @ g + s.l2 * w, x.T @ (g[:, None] * xv) - (xx.T @ g)[:, None] * v + s.l2 * v]
        for t, d, a, c in zip(theta, grads, m, r, strict=True):
            a += 0.1 * (d - a)
            c += 0.01 * (d * d - c)
            t -= s.rate * (a / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.99**step)) + 1e-8)
    return Model(float(theta[0][0]), keep.astype(np.int64), theta[1].astype(float), theta[2].astype(float))


def score_documents(spark: SparkSession, docs: DataFrame, model: Model, s: Settings | None = None) -> DataFrame:
    """doc_id, score (0 to 1), predicted, a row for a row of `docs`; no shuffle. The model has a fixed size.

    Null and empty texts score as the model's constant. Null and repeated ids are carried as they are; other columns
    are not looked at.
    """
    s = s or Settings()
    shared = spark.sparkContext.broadcast((model, s))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*shared.value)
        for b in batches:
            p = score(b.column("text").to_pylist())
            # Ids stay in Arrow, so that long ones beside null ones keep their digits.
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "score": pa.array(p), "predicted": pa.array((p >= s.threshold).astype(np.int32))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def scorer(model: Model, s: Settings):
    """Scores of a batch of texts."""
    terms = Terms(s, model.bucket)

    def score(texts: Sequence[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(model.w)))
        for i, text in enumerate(texts):
            if c := terms.count(text):
                x[i, list(c.keys())] = np.log1p(list(c.values()))
        return 1 / (1 + np.exp(-np.clip(model.scores(x), -30, 30)))

    return lambda texts: np.concatenate([score(texts[i : i + 512]) for i in range(0, len(texts), 512)]) if len(texts) else np.zeros(0)


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, scratch: Scratch, s: Settings | None = None) -> DataFrame:
    """The documents that are not predicted toxic, all their columns and rows.

    Null and empty texts score as the model's constant and stay unless that rejects them. Null and repeated ids and
    repeated rows are each judged by their text. An empty table gives no rows. No column name clashes.
    """
    s = s or Settings()
    shared = spark.sparkContext.broadcast((fit(spark, docs, labels, scratch, s), s))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = scorer(*shared.value)
        for t in texts:
            yield pd.Series(run(t))

    return docs.where(score(F.col("text")) < s.threshold)
