"""Near-duplicate vectors: signs against random hyperplanes in several tables, exact cosines, connected components.

Bits and tables follow from the number of rows and the recall that is asked for at the threshold. Equal vectors are one
from the start, with a count. Rows of a full bucket are split into blocks, and every pair of blocks is a unit of work of
bounded size. Pairs are counted where they are found, in the first table in which they meet, and are never written out:
a unit gives each vector's number of links and a forest of what hangs together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, rows_of, segments, whole_units
from .components import connected_components


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits a table, tables): about a bucket a row, and tables enough that a pair at the threshold meets with probability `recall`."""
    bits = min(30, max(8, math.ceil(math.log2(max(2, n)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def hyperplanes(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def usable(v) -> F.Column:
    """Neither null nor zero, and all components finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def as_stored(vectors: DataFrame) -> tuple[str, str]:
    """(Spark's, NumPy's) type of the components: single where they come as such, so that half as much is moved."""
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    return ("array<float>", "<f4") if single else ("array<double>", "<f8")


def near_duplicates(vectors: DataFrame, scratch: Scratch, *, threshold: float = 0.93, recall: float = 0.985, block: int = 512, seed: int = 11) -> DataFrame:
    """One row per vector (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Only vectors with equal labels, not null, and equal lengths are compared, by cosine in double precision.
    Vectors that are null, zero or hold null or non-finite components link with nothing, as do rows without id,
    which come back as they are with null as component, kept. Rows that repeat a vec_id count as one vector,
    the smallest (label, embedding). Other columns are ignored; an empty table gives no rows. Only the result stays
    in the scratch.
    """
    result, scratch = scratch, scratch.within("vectors")
    stored, kind = as_stored(vectors)
    label = dict(vectors.dtypes)["label"]
    rows = scratch.put(vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast(stored).alias("v")).where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v"))
    good = rows.where(F.col("label").isNotNull() & usable(F.col("v")))
    bits, tables = plan_tables(good.count(), threshold, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(bits)
        for b in batches:
            sigs = np.zeros((len(b), tables), np.int64)
            dims = np.array([len(v) for v in b["v"]])
            raw = [np.asarray(v, kind).tobytes() for v in b["v"]]
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), -1).astype(float)
                x = x / np.abs(x).max(1, keepdims=True)
                sigs[at] = ((x @ hyperplanes(int(d), bits * tables, seed)) > 0).reshape(len(at), tables, bits) @ weights
            sigs = sigs.astype("<i4")
            names = np.array([np.frombuffer(hashlib.blake2b(v, digest_size=16).digest(), np.int64) for v in raw]).reshape(-1, 2)
            yield pd.DataFrame({"vec_id": b["vec_id"], "label": b["label"], "dim": dims, "d1": names[:, 0], "d2": names[:, 1], "sigs": list(sigs), "own": [x.tobytes() + v for x, v in zip(sigs, raw, strict=True)]})

    signed = scratch.put(good.mapInPandas(sign, f"vec_id long, label {label}, dim int, d1 long, d2 long, sigs array<int>, own binary"))
    # Equal vectors, by their 128-bit names, are one, with the smallest id.
    same = ["label", "d1", "d2"]
    heads = scratch.put(signed.groupBy(*same).agg(F.min("vec_id").alias("head"), F.count("*").alias("k")))
    payload = scratch.put(signed.join(heads.select(F.col("head").alias("vec_id"), "k"), "vec_id").select("vec_id", "label", "dim", "k", "sigs", "own"))
    key = ["label", "dim", "t", "sig"]
    spread = payload.select("vec_id", "label", "dim", F.posexplode("sigs").alias("t", "sig"))
    full = scratch.put(spread.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    nb = F.ceil(F.col("n") / block).cast("int")
    members = spread.join(full, key).withColumn("nb", nb).withColumn("own_block", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
    # Ids are dealt out first; a unit's vectors are joined to them once.
    dealt = scratch.put(members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("vec_id", *key, "own_block", F.least("own_block", "other").alias("i"), F.greatest("own_block", "other").alias("j")))
    unit = [*key, "i", "j"]
    n_parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = dealt.join(payload.select("vec_id", "k", "own"), "vec_id").repartition(n_parts, *unit).sortWithinPartitions(*unit, "vec_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_units(batches, unit):
            ids, owns, ts, bi, bj, k = (part[c].to_numpy() for c in ("vec_id", "own_block", "t", "i", "j", "k"))
            out = [np.zeros((0, 3), np.int64)]
            for a, z in segments(*(part[c].to_numpy() for c in unit)):
                if z - a < 2:
                    continue
                raw = rows_of(part.slice(a, z - a), "own", np.uint8)
                v = np.ascontiguousarray(raw[:, 4 * tables :]).view(kind).astype(float)
                v = v / np.abs(v).max(1, keepdims=True)
                v /= np.sqrt((v * v).sum(1, keepdims=True))
                if bi[a] == bj[a]:
                    x, y = np.nonzero(np.triu(v @ v.T >= threshold, 1))
                else:
                    left, right = np.flatnonzero(owns[a:z] == bi[a]), np.flatnonzero(owns[a:z] == bj[a])
                    p, q = np.nonzero(v[left] @ v[right].T >= threshold)
                    x, y = left[p], right[q]
                if ts[a] and len(x):
                    s = np.ascontiguousarray(raw[:, : 4 * ts[a]]).view("<i4")
                    new = (s[x] != s[y]).all(1)
                    x, y = x[new], y[new]
                if len(x):
                    n = np.bincount(x, k[a:z][y], z - a) + np.bincount(y, k[a:z][x], z - a)
                    root = forest(z - a, x, y)
                    at = np.flatnonzero(n)
                    out.append(np.stack([ids[a:z][at], ids[a:z][root[at]], n[at].astype(np.int64)], 1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_pydict({"vec_id": found[:, 0], "root": found[:, 1], "n": found[:, 2]})

    found = scratch.put(units.mapInArrow(compare, "vec_id long, root long, n long"))
    counts = found.groupBy(F.col("vec_id").alias("head")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), scratch)
    heads = scratch.put(heads.join(counts, "head", "left").join(comps, F.col("head") == F.col("id"), "left").select(*same, (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id")))
    linked = signed.select("vec_id", *same).join(heads, same).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    alone = vectors.where(F.col("vec_id").isNull()).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = result.put(out.union(alone))
    scratch.clear()
    return out


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest position that links reach, for positions 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
