"""Helpers shared by the training-data operators: scratch tables, batches, bit tables, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a test-data folder (any path that Spark's readers open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder; on a cluster
    nothing may be written where only one machine can read it, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = "file://" + tempfile.mkdtemp(prefix="alphaloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scope(set):
    """Paths of the scratch tables made within a scope."""

    def keep(self, df: DataFrame) -> None:
        """Let a table live on after the scope."""
        self.discard(df.scratch_path)


#: Paths of scratch tables that still exist, with a session to delete them by; and those of open scopes.
_made: dict[str, SparkSession] = {}
_scopes: list[Scope] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared scratch folder and read it back."""
    spark = df.sparkSession
    at = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[at] = spark
    if _scopes:
        _scopes[-1].add(at)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.scratch_path = at
    return out


def _delete(at: str) -> None:
    spark = _made.pop(at, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


@contextmanager
def scratch_scope():
    """Delete at its end the scratch tables made within, for work whose result has been written by then."""
    _scopes.append(Scope())
    try:
        yield _scopes[-1]
    finally:
        for at in _scopes.pop():
            _delete(at)


@atexit.register
def _delete_all() -> None:
    """Scratch tables that a lazy result still reads live as long as the driver."""
    for at in list(_made):
        try:
            _delete(at)
        except Exception:  # noqa: BLE001  the session may be gone before
            return


def drop_scratch(df: DataFrame) -> None:
    """Delete a table made by materialise() once nothing reads it any more."""
    _delete(df.scratch_path)


_FAST, _TIGHT = pa.Codec("zstd", compression_level=1), pa.Codec("zstd", compression_level=6)


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function on batches that, when it is done, gives the memory it no longer uses back to the system: a Python worker lives on, idle, beside the next stages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def squeezed(data: bytes, tight: bool = False) -> bytes:
    """Compressed bytes that know their size."""
    return len(data).to_bytes(8, "little") + (_TIGHT if tight else _FAST).compress(data, asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    n = int.from_bytes(data[:8], "little")
    return _FAST.decompress(memoryview(data)[8:], n, asbytes=True) if n else b""


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def pieces(batch: pa.RecordBatch, max_bytes: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part holds about max_bytes of one column (a row is never cut)."""
    col = batch.column(batch.schema.get_field_index(column))
    n = batch.num_rows
    if not n:
        return
    sizes = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i in range(n):
        if total and total + sizes[i] > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)


def bit_slots(values: np.ndarray, bits: int) -> np.ndarray:
    """Where in a table of so many bits (a power of two) each 64-bit value has its bit."""
    h = (values.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def bit_table(values: DataFrame, bits: int) -> np.ndarray:
    """A packed bit table, set for every value of a one-column table (and, while these are few, for few others); its size is that of the parameter, not of the input."""
    kind = "salt int, bits binary"

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table_, any_ = np.zeros(bits // 8, np.uint8), False
        for batch in batches:
            slot = bit_slots(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(table_, slot >> 3, (np.uint8(128) >> (slot & 7).astype(np.uint8)))
            any_ = any_ or batch.num_rows > 0
        ctx = TaskContext.get()
        part = ctx.partitionId() if ctx else 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([part % 64], pa.int32()), pa.array([squeezed(table_.tobytes())], pa.binary())], ["salt", "bits"])

    def either(key, tbl):
        total = np.zeros(bits // 8, np.uint8)
        for b in tbl.column("bits").to_pylist():
            total |= np.frombuffer(unsqueezed(b), np.uint8)
        return pa.table({"salt": pa.array([0], pa.int32()), "bits": pa.array([squeezed(total.tobytes())], pa.binary())})

    rows = values.mapInArrow(mark, kind).groupBy("salt").applyInArrow(either, kind).groupBy("salt").applyInArrow(either, kind).collect()
    return np.frombuffer(unsqueezed(bytes(rows[0]["bits"])), np.uint8) if rows else np.zeros(bits // 8, np.uint8)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list: (node, component), component = smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until the
    edge set no longer changes. Nodes and edges stay distributed; a node's
    neighbours are never gathered in one row (only minima are), so a node with very
    many links costs what its rows cost. Only the count and a hash sum of the edges
    reach the driver, to test for the fixpoint. Null or equal ends are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "cc")
    state = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: link every larger neighbour of u to the smallest of u and its neighbours
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link u and its smaller neighbours to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(
            least.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(small, "cc")
        drop_scratch(e)
        e = new
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(row):
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v"), F.col("v")).distinct())
