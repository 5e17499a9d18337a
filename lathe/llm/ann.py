"""Approximate nearest neighbours: inverted lists, and an adaptive scan over the dimensions of rotated vectors.

Vectors are turned by a fixed random rotation, so the first columns hold a fair sample of a distance. A scan takes the
columns in blocks and drops a candidate as soon as a hypothesis test on its partial distance says that it is farther
than the k-th best so far. The lists come from k-means on a bounded sample, in two levels: where there are too many rows
for as many lists as the sample can fit, every list is split by one more set of centres, of what the first leaves over.
So lists keep their length as rows grow. Every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, rows_of, segments, whole_units
from .embedding_dedup import as_stored, usable

#: Squared distances that differ by less count as equal: copies are not to be lost by rounding.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Settings:
    """`sample_values` bounds what the lists are fitted on: that many numbers in all. `cover` is the share of true
    neighbours, measured on the sample, that the probed lists must hold. Up to `max_lists` lists of the first level
    are about as many as they are long; beyond, the second level aims at `list_rows` rows a list."""

    k: int = 5
    sample_values: int = 1_500_000
    sample_rows: int = 20_000
    max_lists: int = 1024
    max_second: int = 256
    list_rows: int = 2048
    trials: int = 256
    cover: float = 0.975
    columns: int = 16
    epsilon: float = 2.4
    block: int = 4096
    seed: int = 5


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


@lru_cache(maxsize=16)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


@dataclass
class Index:
    """Two levels of centres by dimension, and how many lists a query probes. A dimension that the sample lacks has one list."""

    centres: dict[int, tuple[np.ndarray, np.ndarray]]
    probes: dict[int, int]

    def lists(self, dim: int) -> int:
        c = self.centres.get(dim)
        return 1 if c is None else len(c[0]) * len(c[1])

    def own(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest first centre, then the nearest second one to what that leaves over."""
        c = self.centres.get(x.shape[1])
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x) if c else 0, 4096):
            part = x[i : i + 4096]
            first = (part @ c[0].T).argmax(1)
            rest = part - c[0][first]
            out[i : i + 4096] = first * len(c[1]) + ((c[1] * c[1]).sum(1) - 2 * rest @ c[1].T).argmin(1)
        return out

    def nearness(self, x: np.ndarray) -> np.ndarray:
        """How near each row is to the middle of each list."""
        c = self.centres.get(x.shape[1])
        return np.zeros((len(x), 1)) if c is None else ((x @ c[0].T)[:, :, None] + (x @ c[1].T)[:, None, :]).reshape(len(x), -1)

    def order(self, x: np.ndarray, sizes: np.ndarray, k: int) -> Iterator[np.ndarray]:
        """For each row the lists to probe, nearest first: as many as the index says, and more until they hold more than k rows."""
        most = self.probes.get(x.shape[1], 1)
        for row in x:
            near = self.nearness(row[None])[0]
            some = np.arange(len(near)) if most >= len(near) else np.argpartition(-near, most - 1)[:most]
            if sizes[some].sum() <= k:
                every = np.argsort(-near, kind="stable")
                some = every[: max(most, int(np.searchsorted(np.cumsum(sizes[every]), k, "right")) + 1)]
            yield some[sizes[some] > 0]


def k_means(x: np.ndarray, m: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    c = x[rng.choice(len(x), m, replace=False)]
    for _ in range(8):
        half = 0 if spherical else (c * c).sum(1) / 2
        own = np.concatenate([(x[i : i + 4096] @ c.T - half).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.sqrt((total * total).sum(1, keepdims=True)) if spherical else np.bincount(own, minlength=m)[:, None]
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def fit_index(sample: list[np.ndarray], n: int, s: Settings) -> Index:
    """Spherical k-means on the sample, k-means on what it leaves over; the probes are as many as cover the sample's own neighbours, found by brute force."""
    index = Index({}, {})
    rng = np.random.default_rng(s.seed)
    for dim in sorted({len(v) for v in sample}):
        x = unit(np.stack([v for v in sample if len(v) == dim]).astype(float))
        most = max(1, len(x) // 8)
        first = k_means(x, int(np.clip(np.sqrt(n), 1, min(s.max_lists, most))), rng, True)
        m = 1 if len(first) ** 2 >= n // 4 else int(np.clip(n // (len(first) * s.list_rows), 1, min(s.max_second, most)))
        second = np.zeros((1, dim))
        if m > 1:
            index.centres[dim] = (first, second)
            second = k_means(x - first[index.own(x)], m, rng, False)
        index.centres[dim] = (first, second)
        k = min(s.k, len(x) - 1)
        if k < 1:
            index.probes[dim] = index.lists(dim)
            continue
        own, depth = index.own(x), []
        for i in rng.choice(len(x), min(s.trials, len(x)), replace=False):
            near = x @ x[i]
            near[i] = -2
            lists = index.nearness(x[i : i + 1])[0]
            mine = lists[own[np.argpartition(-near, k - 1)[:k]]]
            depth += [int((lists >= v).sum()) for v in mine]
        index.probes[dim] = sorted(depth)[int(np.ceil(s.cover * len(depth))) - 1]
    return index


def scan(q: np.ndarray, base: np.ndarray, limit: float, k: int, s: Settings) -> np.ndarray:
    """Positions in `base` that may be among the k nearest of q."""
    return scan_many(q[None], base, np.array([limit]), k, s)[1]


def scan_many(q: np.ndarray, base: np.ndarray, limit: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, position in `base`) of what may be among the k nearest of each row of q, all rotated unit vectors;
    `limit`: for each a squared distance known to suffice."""
    d = base.shape[1]
    c = min(d, s.columns)
    head, start = base[:, :c], q[:, :c]
    part = np.maximum((start * start).sum(1)[:, None] + (head * head).sum(1) - 2 * start @ head.T, 0)
    if len(base) > k:
        first = np.argpartition(part, k - 1, axis=1)[:, :k]
        full = base[first] - q[:, None]
        limit = np.minimum(limit, (full * full).sum(2).max(1))
    at, to = np.nonzero(part * (d / c) <= (limit * (1 + s.epsilon / np.sqrt(c)) ** 2)[:, None] + ROUNDING)
    part = part[at, to]
    while c < d:
        z = min(d, c + s.columns)
        diff = base[to, c:z] - q[at, c:z]
        part = part + np.einsum("ij,ij->i", diff, diff)
        c = z
        alive = part * (d / c) <= limit[at] * (1 + (s.epsilon / np.sqrt(c) if c < d else 0)) ** 2 + ROUNDING
        at, to, part = at[alive], to[alive], part[alive]
    return at, to


def search(spark: SparkSession, vectors: DataFrame, queries: F.Column, scratch: Scratch, s: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest rows by cosine of every row that `queries` picks, itself excepted.

    Vectors that are null, zero or hold null or non-finite components, and rows without id, take no part. Rows that
    repeat a vec_id count as one vector, the smallest. Vectors of other lengths are no candidates. A query probes
    further lists until they hold k others, so fewer than k rows come back only if there are no more. Ties go to
    the smaller vec_id. Other columns are ignored; an empty table gives no rows. Only the result stays in the scratch.
    """
    s = s or Settings()
    result, scratch = scratch, scratch.within("nearest")
    stored, kind = as_stored(vectors)
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(stored).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = scratch.put(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")))
    n, dim = rows.agg(F.count("*"), F.max("dim")).first()
    by_hash = F.xxhash64("vec_id")
    bound = max(64, min(s.sample_rows, s.sample_values // max(1, dim or 1)))
    sample = [np.asarray(r) for r in rows.orderBy(by_hash, "vec_id").limit(bound).select("v").toPandas()["v"]]
    index = spark.sparkContext.broadcast(fit_index(sample, n, s))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, raw = np.zeros(len(b), np.int64), [np.asarray(v, kind) for v in b["v"]]
            for d in b["dim"].unique():
                at = np.flatnonzero(b["dim"] == d)
                own[at] = index.value.own(unit(np.stack([raw[i] for i in at]).astype(float)))
            yield pd.DataFrame({"vec_id": b["vec_id"], "v": [x.tobytes() for x in raw], "dim": b["dim"], "list": own})

    listed = scratch.put(rows.mapInPandas(assign, "vec_id long, v binary, dim int, list long"))
    # One row a list; lists are bounded by max_lists and max_second for every dimension of the sample.
    sizes = {int(d): np.zeros(index.value.lists(int(d)), np.int64) for d in {len(v) for v in sample}}
    for r in listed.groupBy("dim", "list").agg(F.count("*").alias("n")).collect():
        sizes.setdefault(r["dim"], np.zeros(1, np.int64))[r["list"]] = r["n"]
    shared = spark.sparkContext.broadcast(sizes)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d in b["dim"].unique():
                own = b[b["dim"] == d]
                x = unit(np.frombuffer(b"".join(own["v"]), kind).reshape(len(own), -1).astype(float))
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy(), "lists": list(index.value.order(x, shared.value[int(d)], s.k))})

    asked = scratch.put(listed.where(queries).mapInPandas(probe, "vec_id long, lists array<long>"))
    asked = asked.join(listed.where(queries).select("vec_id", "v", "dim"), "vec_id").select("vec_id", "v", "dim", F.explode("lists").alias("list"))
    load = asked.groupBy("dim", "list").agg(F.count("*").alias("q"))
    plan = listed.groupBy("dim", "list").agg(F.count("*").alias("n")).join(load, ["dim", "list"])
    plan = scratch.put(plan.select("dim", "list", F.ceil(F.col("n") / s.block).cast("int").alias("nb"), F.ceil(F.col("q") / s.block).cast("int").alias("qb")))
    # Every block of a list meets every block of its queries in a unit of its own.
    mine = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    base = listed.join(plan, ["dim", "list"]).withColumn("i", mine("nb")).withColumn("j", upto("qb"))
    ask = asked.join(plan, ["dim", "list"]).withColumn("j", mine("qb")).withColumn("i", upto("nb"))
    key = ["dim", "list", "i", "j"]
    units = base.withColumn("q", F.lit(0)).select(*key, "q", "vec_id", "v").union(ask.withColumn("q", F.lit(1)).select(*key, "q", "vec_id", "v"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}

        def told() -> pa.RecordBatch:
            rows = [(q, y, -x) for q, known in best.items() for x, y in known]
            best.clear()
            return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

        for part in whole_units(batches, key):
            ids, is_query = part["vec_id"].to_numpy(), part["q"].to_numpy()
            for a, z in segments(*(part[c].to_numpy() for c in key)):
                mid = int((is_query[a:z] == 0).sum())
                if not mid or mid == z - a:
                    continue
                v = rows_of(part.slice(a, z - a), "v", kind).astype(float)
                u = unit(v)
                turned = u @ rotation(v.shape[1], s.seed)
                norm = np.sqrt((v * v).sum(1))
                names = ids[a:z]
                step = max(1, 500_000 // mid)
                for first in range(mid, z - a, step):
                    some = np.arange(first, min(z - a, first + step))
                    known = [best.get(int(q), ()) for q in names[some]]
                    limit = np.array([max(0.0, 2 + 2 * own[-1][0]) if len(own) >= s.k else 5.0 for own in known])
                    at, to = scan_many(turned[some], turned[:mid], limit, s.k + 1, s)
                    other = names[some[at]] != names[to]
                    at, to = some[at[other]], to[other]
                    with np.errstate(all="ignore"):
                        cos = np.einsum("ij,ij->i", v[at], v[to]) / (norm[at] * norm[to])
                    bad = ~np.isfinite(cos)
                    cos[bad] = (u[at[bad]] * u[to[bad]]).sum(1)
                    for x, y in segments(at) if len(at) else ():
                        own = best.setdefault(int(names[at[x]]), [])
                        own += zip((-cos[x:y]).tolist(), names[to[x:y]].tolist(), strict=True)
                        own.sort()
                        del own[s.k :]
            if len(best) > 50_000:
                yield told()
        yield told()

    units = units.repartition(n_parts, *key).sortWithinPartitions(*key, "q", "vec_id")
    found = units.mapInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = result.put(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score"))
    scratch.clear()
    return out
