"""Similarity join on word shingles by adaptive multi-match prefixes.

Shingles have one global order: rarely met ones first, by a count sketch of the whole corpus, then by hash. Two sets
that are similar enough share at least l of the first n - ceil(t n) + l shingles, for every l. Each document takes the
l that makes its expected work least: a longer prefix costs entries in the index, and spares pairs that share less.
Pairs inside a component that stands already are not looked at again: stars of like documents are verified first, then
only pairs across components. Every link that is reported or used was verified on the whole sets.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, perhaps_among, rows_of, slices, unused, whole_units
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    """The threshold is `part` / `of`. The sketch has a fixed number of counters. A list of more than `block` sets
    that share a shingle is split into blocks, and every pair of blocks is a unit of work of its own."""

    words: int = 5
    part: int = 80
    of: int = 100
    counters: int = 1 << 21
    chunks: int = 256
    verify_cost: float = 10.0
    unseen: float = 0.2
    bands: int = 8
    block: int = 1000


PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Base of the word hash and its inverse modulo 2^64.
BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of texts as sorted 64-bit hashes. Words are runs of anything but ASCII white space, A-Z lower-cased.

    Words are hashed from running sums over the bytes of many texts at once, shingles from their words' hashes.
    """

    def __init__(self, words: int, chunk: int = 1 << 20) -> None:
        self.words, self.chunk = words, chunk
        self.up, self.down = powers(BASE, chunk), powers(INVERSE, chunk)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets([text])[0]

    def sets(self, texts) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        some: list[bytes] = []
        size = 0
        for t in texts:
            b = (t or "").encode("utf-8", "surrogatepass").lower()
            if some and size + len(b) > self.chunk:
                out += self._sets(some)
                some, size = [], 0
            some.append(b)
            size += len(b) + 1
        return out + (self._sets(some) if some else [])

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = powers(BASE, len(raw)), powers(INVERSE, len(raw))
        gap = SPACE[raw]
        edge = np.flatnonzero(np.diff(np.r_[True, gap].view(np.int8)))
        start, stop = edge[::2], edge[1::2]  # the last byte is a gap, so that every word ends
        total = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)])]
        w = mixed((total[stop] - total[start]) * self.down[start] + (stop - start).astype(np.uint64) * PRIME)
        bound = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        k = self.words
        h = w[: max(0, len(w) - k + 1)].copy()
        for i in range(1, k):
            h = h * PRIME + w[i : len(w) - k + 1 + i]
        h = mixed(h + np.uint64(k))
        return [np.unique(h[a : z - k + 1]) if z - a >= k else self._short(w[a:z]) for a, z in zip(bound[:-1], bound[1:], strict=True)]

    def _short(self, w: np.ndarray) -> np.ndarray:
        if not len(w):
            return np.zeros(0, np.uint64)
        h = w[:1].copy()
        for x in w[1:]:
            h = h * PRIME + x
        return mixed(h + np.uint64(len(w)))


def named(h: np.ndarray) -> np.ndarray:
    """A set's name, two numbers."""
    return np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)


def bands(h: np.ndarray, n: int) -> list[int] | None:
    """For each band the two least hashes under two orders, as one number; alike in two sets with the square of their similarity."""
    if not len(h):
        return None
    least = [int(mixed(h, 1000 + i).min()) for i in range(2 * n)]
    return [hash((least[2 * i], least[2 * i + 1])) for i in range(n)]


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the number of shingles in 512 buckets."""
    return np.packbits(np.bincount((h & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).tobytes()


def least_shared(n: np.ndarray | int, s: Settings):
    """Shingles that a set of size n shares with any set it links with."""
    return -(-s.part * n // s.of)


def required(n: np.ndarray, m: np.ndarray, s: Settings) -> np.ndarray:
    return -(-s.part * (n + m) // (s.part + s.of))


def counter_of(h: np.ndarray, s: Settings) -> np.ndarray:
    return (h >> np.uint64(64 - int(s.counters).bit_length() + 1)).astype(np.int64)


def ordered_prefix(h: np.ndarray, excess: np.ndarray, level: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """(prefix, l) of a set: shingles in the global order as far as the cheapest l asks for."""
    n = len(h)
    at = counter_of(h, s)
    order = np.argsort(level[at], kind="stable")  # hashes are in order
    need = int(least_shared(n, s))
    first = n - need
    ells = np.unique(np.clip((n * np.array([0, 0.01, 0.02, 0.04, 0.06, 0.09, 0.12, 0.16])).astype(int), 1, need))
    load = np.cumsum(excess[at][order] + s.unseen)
    spare = (first + 1) / (first + ells)
    cost = first + ells + s.verify_cost * load[first + ells - 1] * spare * spare
    ell = int(ells[np.argmin(cost)])
    return h[order[: first + ell]], ell


def list_pairs(starts: np.ndarray, sizes: np.ndarray, most: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within each list, lists of one size at a time; a long list goes row by row."""
    for m in np.unique(sizes[sizes > 1]):
        own = starts[sizes == m]
        if m > 600:
            for a in own:
                for i in range(m - 1):
                    yield np.full(m - 1 - i, a + i), np.arange(a + i + 1, a + m)
            continue
        x, y = np.triu_indices(m, 1)
        step = max(1, most // len(x))
        for c in range(0, len(own), step):
            part = own[c : c + step, None]
            yield (part + x).ravel(), (part + y).ravel()


def summed(found: list[np.ndarray]) -> np.ndarray:
    """Rows (x, y, need, k), one a pair: the least need, the sum of k."""
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)])
    return np.column_stack([rows[starts, :2], np.minimum.reduceat(rows[:, 2], starts), np.add.reduceat(rows[:, 3], starts)])


def told(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(("x", "y", "need", "k"), np.ascontiguousarray(rows.T), strict=True)))


def jaccard_components(spark: SparkSession, docs: DataFrame, scratch: Scratch, s: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs` (doc_id, text); links need a Jaccard similarity of part/of.

    A text with fewer words than a shingle has its whole sequence as one; null texts and texts without words have an
    empty set and link with nothing. Rows without id come back with their size and no component. Equal texts
    collapse before the join. Rows that repeat an id share its component. Ties at the threshold link, by integer
    arithmetic. An empty table gives no rows; other columns are not looked at. Only the result stays in the scratch.
    """
    s = s or Settings()
    result, scratch = scratch, scratch.within("join")
    text = docs.select(F.col("doc_id").cast("long"), "text")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, counts = Shingler(s.words), np.zeros(s.counters, np.int32)
        kinds = {"doc_id": pa.int64(), "n": pa.int64(), "s1": pa.int64(), "s2": pa.int64(), "bands": pa.list_(pa.int64()), "bits": pa.binary(), "chunk": pa.int32(), "counts": pa.binary()}

        def made(rows: int, **own) -> pa.RecordBatch:
            """A batch of these columns; the others are null."""
            return pa.RecordBatch.from_pydict({c: own[c] if isinstance(own.get(c), pa.Array) else pa.array(own.get(c, [None] * rows), kind) for c, kind in kinds.items()})

        for b in slices(batches):
            some = shingle.sets(b.column("text").to_pylist())
            names = np.stack([named(h) for h in some]) if some else np.zeros((0, 2), np.int64)
            at, k = np.unique(counter_of(np.concatenate([*some, np.zeros(0, np.uint64)]), s), return_counts=True)
            counts[at] += k.astype(np.int32)
            # Ids stay in Arrow, so that long ones beside null ones keep their digits.
            yield made(len(some), doc_id=b.column("doc_id"), n=[len(h) for h in some], s1=names[:, 0], s2=names[:, 1], bands=[bands(h, s.bands) for h in some], bits=[bitmap(h) for h in some])
        size = s.counters // s.chunks
        own = [(c, zlib.compress(counts[c * size : (c + 1) * size].tobytes(), 1)) for c in range(s.chunks) if counts[c * size : (c + 1) * size].any()]
        yield made(len(own), chunk=[c for c, _ in own], counts=[z for _, z in own])

    measured = scratch.put(text.mapInArrow(measure, "doc_id long, n long, s1 long, s2 long, bands array<long>, bits binary, chunk int, counts binary"))
    sizes = measured.where(F.col("chunk").isNull()).select("doc_id", "n", "s1", "s2", "bands", "bits")

    def add_up(key, parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(s.counters // s.chunks, np.float32)
        for z in parts["counts"]:
            total += np.frombuffer(zlib.decompress(z), np.int32)
        return pd.DataFrame({"chunk": [key[0]], "total": [zlib.compress(total.tobytes(), 1)]})

    sketch = np.zeros(s.counters, np.float32)
    for r in measured.where(F.col("chunk").isNotNull()).groupBy("chunk").applyInPandas(add_up, "chunk int, total binary").collect():
        own = np.frombuffer(zlib.decompress(r["total"]), np.float32)
        sketch[r["chunk"] * len(own) : (r["chunk"] + 1) * len(own)] = own
    mean = float(sketch.mean())
    noise = 4 * np.sqrt(mean) + 16
    excess = np.where(sketch - mean > noise, sketch - mean, 0).astype(np.float32)
    level = np.where(excess > 0, np.floor(np.log2(np.maximum(excess, 1) / noise)) + 1, 0).astype(np.int8)
    # The sketch has a fixed size, whatever the corpus.
    shared = spark.sparkContext.broadcast((excess, level))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (excess, level), seen = Shingler(s.words), shared.value, set()
        for b in slices(batches):
            out = []
            for h in shingle.sets(b.column("text").to_pylist()):
                own = tuple(named(h).tolist())
                if not len(h) or own in seen:
                    continue
                seen.add(own)
                p, ell = ordered_prefix(h, excess, level, s)
                out.append((p.view(np.int64), own[0], len(h), ell, excess[counter_of(p, s)] > s.block))
            if out:
                k = [len(o[0]) for o in out]
                each = lambda i, kind: np.repeat(np.array([o[i] for o in out], kind), k)  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"tok": np.concatenate([o[0] for o in out]), "s1": each(1, np.int64), "n": each(2, np.int32), "pos": np.concatenate([np.arange(j, dtype=np.int32) for j in k]), "ell": each(3, np.int32), "hot": np.concatenate([o[4] for o in out])})

    postings = text.where(F.col("doc_id").isNotNull()).mapInArrow(index, "tok long, s1 long, n int, pos int, ell int, hot boolean")
    # A shingle that one set alone has in its prefix joins nothing. What the sketch knows as frequent is certain to join,
    # and is dealt out by set, so that no task gets all of it. One entry a set, whichever tasks met copies of it.
    postings = postings.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("s1"), F.lit(1 << 20))).otherwise(0))
    one_list = Window.partitionBy("tok", "salt")
    postings = postings.repartition(n_parts, "tok", "salt").withColumn("alone", ~F.col("hot") & (F.min("s1").over(one_list) == F.max("s1").over(one_list)))
    live = scratch.put(postings.where(~F.col("alone")).select("tok", "salt", "s1", "n", "pos", "ell").distinct().drop("salt"))

    # Documents with one set are one node, named by its smallest id.
    alone = sizes.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    sets = scratch.put(alone.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("k"), F.max("n").cast("int").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")))
    # Stars of nodes that look alike: each to the smallest id with the same least hashes in a band.
    alike = sets.select("node", F.posexplode("bands").alias("band", "key"))
    head = scratch.put(alike.groupBy("band", "key").agg(F.min("node").alias("x"), F.count("*").alias("k")).where("k > 1").drop("k"))
    first = scratch.put(alike.join(head, ["band", "key"]).select("x", F.col("node").alias("y")).where("x <> y").distinct())
    links = verified(text, first, scratch, s)
    near = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch)
    known = scratch.put(sets.join(near, sets["node"] == near["id"], "left").select("s1", "n", F.col("node").alias("doc"), F.coalesce("component", "node").alias("comp"), "bits"))
    # Two sets with one s1 and size, if they ever meet, label each other's entries too: more to verify, nothing lost.
    # Only lists that reach over components are looked at, in blocks; how long each is was summed before it is dealt out.
    lists = live.join(known.select("s1", "n", "comp"), ["s1", "n"]).groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    nb = F.ceil(F.col("m") / s.block).cast("int")
    entries = live.join(lists.select("tok", nb.alias("nb")), "tok").join(known, ["s1", "n"])
    entries = entries.withColumn("own", F.pmod(F.xxhash64("s1"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = entries.select("tok", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "n", "doc", "comp", "pos", "ell", "bits")

    def pairs(part: pa.Table) -> Iterator[np.ndarray]:
        """Pairs of a unit in different components that size and position allow, within the shorter of both prefixes."""
        t, i, j, own, d, comp, n, pos, ell = (part[c].to_numpy().astype(np.int64) for c in ("tok", "i", "j", "own", "doc", "comp", "n", "pos", "ell"))
        starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        size = np.diff(np.r_[starts, len(t)])
        left = n - pos
        bits = rows_of(part, "bits", "<u8")
        for x, y in list_pairs(starts, size):
            need = np.minimum(ell[x], ell[y])
            ok = (comp[x] != comp[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (n[x] * s.of >= n[y] * s.part)
            ok &= np.minimum(left[x], left[y]) + need - 1 >= required(n[x], n[y], s)
            ok &= (pos[x] < n[x] - least_shared(n[x], s) + need) & (pos[y] < n[y] - least_shared(n[y], s) + need)
            x, y, need = x[ok], y[ok], need[ok]
            # Elements of just one set flip the parity of their bit: a bound on what both can share.
            apart = np.bitwise_count(bits[x] ^ bits[y]).sum(1).astype(np.int64)
            ok = n[x] + n[y] - apart >= 2 * required(n[x], n[y], s)
            x, y, need = x[ok], y[ok], need[ok]
            if len(x):
                yield np.stack([np.minimum(d[x], d[y]), np.maximum(d[x], d[y]), need, np.ones(len(x), np.int64)], 1)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """`pairs` of all units, each with how often it was met; what a task holds is bounded, and told in parts if need be."""
        held, size = [], 0
        for part in whole_units(batches, ("tok", "i", "j")):
            for found in pairs(part):
                held.append(found)
                size += len(found)
                if size > 400_000:
                    held = [summed(held)]
                    if (size := len(held[0])) > 200_000:
                        yield told(held[0])
                        held, size = [], 0
        if held:
            yield told(summed(held))

    units = units.repartition(n_parts, "tok", "i", "j").sortWithinPartitions("tok", "i", "j", "n", "doc")
    second = units.mapInArrow(across, "x long, y long, need long, k long")
    second = scratch.put(second.groupBy("x", "y").agg(F.min("need").alias("need"), F.sum("k").alias("k")).where("k >= need").select("x", "y"))
    scratch.drop(live)
    links = links.union(verified(text, second, scratch, s))
    twins = scratch.put(alone.select("doc_id", "s1", "s2").join(sets.where("k > 1").select("s1", "s2", "node"), ["s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a <> b"))
    comps = connected_components(links.select(F.col("x").alias("a"), F.col("y").alias("b")).union(twins), scratch)
    out = sizes.where(F.col("doc_id").isNotNull()).join(comps, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    out = result.put(out.union(sizes.where(F.col("doc_id").isNull()).select("doc_id", "n", F.lit(None).cast("long"))))
    scratch.clear()
    return out


def verified(text: DataFrame, pairs: DataFrame, scratch: Scratch, s: Settings) -> DataFrame:
    """The pairs (x, y) whose whole sets are similar enough. A filter of a fixed size leaves out most sets that no
    pair names before they are made; the joins do the rest."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("doc_id"))
    own, named_by_a_pair = perhaps_among(text, F.col("doc_id"), ids, F.col("doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(s.words)
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc_id"), "own": pa.array([packed(h) for h in shingle.sets(b.column("text").to_pylist())], pa.binary())})

    made = scratch.put(own.where(named_by_a_pair).select("doc_id", "text").mapInArrow(sets, "doc long, own binary"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = []
            for p, q in zip(b["p"], b["q"], strict=True):
                p, q = unpacked(p), unpacked(q)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(s.of * both >= s.part * (len(p) + len(q) - both))
            yield b.loc[np.array(ok, bool), ["x", "y"]]

    p = made.select(F.col("doc").alias("x"), F.col("own").alias("p"))
    q = made.select(F.col("doc").alias("y"), F.col("own").alias("q"))
    out = scratch.put(pairs.join(p, "x").join(q, "y").select("x", "y", "p", "q").mapInPandas(compare, "x long, y long"))
    scratch.drop(made)
    return out


def packed(h: np.ndarray) -> bytes:
    """Six bytes a shingle: within two sets, another shingle has the same ones about once in 10^9 pairs of sets."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    a = np.zeros((len(b) // 6, 8), np.uint8)
    a[:, 2:] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return a.view("<u8").ravel()


def keep_one(spark: SparkSession, docs: DataFrame, scratch: Scratch, s: Settings | None = None) -> DataFrame:
    """One document of each group of near-copies, that with the smallest id, with all its columns.

    Rows without id or words all stay, as do all rows that repeat the id of a kept one. No links: every row. An empty
    table gives no rows. No column name clashes.
    """
    comps = jaccard_components(spark, docs, scratch, s)
    name = unused("lathe_", docs) + "gone"
    gone = scratch.put(comps.where("component_id < doc_id").select(F.col("doc_id").alias(name)).distinct())
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
