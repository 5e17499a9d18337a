"""Shared plumbing: the shared scratch folder, units of work that are read as a stream, and text rules."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where it is unset, a local one, but on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lathe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None) -> None:
        self.spark = spark
        self.root = f"{root or shared_dir(spark) + '/lathe'}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._lathe_path = path
        return out

    def within(self, name: str) -> Scratch:
        """A part of this scratch that can be cleared by itself."""
        return Scratch(self.spark, name, self.root)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            self._delete(df._lathe_path)

    def clear(self) -> None:
        """Delete all of its tables."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(own, True)


#: Bits of the filter below; a broadcast of so many at most, whatever the tables' sizes.
FILTER_BITS = 1 << 24


def perhaps_among(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> tuple[DataFrame, Column]:
    """`rows` with a column for whether `key` may be among the keys of `wanted`, and that column's condition.

    False is certain; true may be wrong, the more often the more of the filter's fixed number of bits are set, so
    an exact join has to follow. Null keys are not among any. The added column is the caller's to leave out.
    """
    hashed = lambda k: F.pmod(F.xxhash64(k), F.lit(FILTER_BITS))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hashed(k), F.lit(64)).cast("int"))
    place = lambda k: F.shiftright(hashed(k), 6)
    name = unused("lathe_bits", rows)
    at = f"{name}_at"
    words = wanted.where(wanted_key.isNotNull()).groupBy(place(wanted_key).alias(at)).agg(F.bit_or(bit(wanted_key)).alias(name))
    # At most FILTER_BITS / 64 rows of two numbers.
    out = rows.join(F.broadcast(words), place(key) == F.col(at), "left").drop(at)
    return out, F.coalesce(F.col(name).bitwiseAND(bit(key)) != 0, F.lit(False)) & key.isNotNull()


def column(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, made longer until no column of the tables starts with it, whatever their case."""
    taken = [c.lower() for df in frames for c in df.columns]
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of a few rows, so that what is made of long texts stays small."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def give_back() -> None:
    """Memory that was freed in this process goes back to the system; a worker is used again by stages that need other tables.

    Where the C library has no such call, what it keeps stays with it.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def whole_units(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of whole units from a partition that is sorted by `keys`; no more than a batch and a unit are held."""
    rest = None
    for b in batches:
        part = pa.Table.from_batches([b])
        part = part if rest is None else pa.concat_tables([rest, part])
        if not len(part):
            continue
        last = np.logical_and.reduce([k == k[-1] for k in (part[c].to_numpy() for c in keys)])
        cut = 0 if last.all() else len(last) - int(last[::-1].argmin())
        if cut:
            yield part.slice(0, cut)
        rest = part.slice(cut)
    if rest is not None and len(rest):
        yield rest


def segments(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys in sorted columns."""
    n = len(keys[0])
    cut = np.zeros(n, bool)
    for k in keys:
        cut[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(np.r_[True, cut[1:]]) if n else np.array([], int)
    yield from zip(starts, [*starts[1:], n], strict=True)


def rows_of(part: pa.Table, name: str, kind: str) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    return np.frombuffer(b"".join(part[name].to_pylist()), kind).reshape(len(part), -1)
