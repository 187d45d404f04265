"""Shared pieces of the training-data operators: scratch tables, Arrow helpers, words and hashes.

Words are the maximal runs of bytes other than space and 0x09-0x0D of the UTF-8 text with A-Z
lower-cased; `bytes.lower` and `bytes.split` do exactly that, and touch no other byte.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash over words, and its inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 4 << 20
#: Entries after which a worker's word memo is emptied; a memo only saves time.
MEMO_ENTRIES = 200_000

#: Whether Spark removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[tuple[SparkSession, str]] = []
#: How many writes hold CLEANUP on, and what it was before the first.
_writing, _lock, _before = 0, threading.Lock(), None


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where unset (tests), one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors share no folder")
        folder = getattr(spark, "_arborlake_scratch", None)
        if folder is None:
            folder = spark._arborlake_scratch = "file://" + tempfile.mkdtemp(prefix="arborlake-")
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_scratch() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


atexit.register(_drop_scratch)


def _cleanup(spark: SparkSession, on: bool) -> None:
    """Turns CLEANUP on for the first of several writes, and back after the last; they may come from several threads."""
    global _writing, _before
    with _lock:
        if on and not _writing:
            _before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writing += 1 if on else -1
        if not _writing:
            spark.conf.unset(CLEANUP) if _before is None else spark.conf.set(CLEANUP, _before)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a lost executor then costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/arborlake-{uuid.uuid4().hex}"
    _cleanup(spark, True)  # once the table is written, nothing reads the shuffle files behind it
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        _cleanup(spark, False)
    _scratch.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._arborlake_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes a table of stored() that no later step reads."""
    _delete(table.sparkSession, table._arborlake_path)
    _scratch.remove((table.sparkSession, table._arborlake_path))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a text column, not decoded."""
    return column.cast(pa.large_binary()).to_pylist()


def per_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], *, size_of: str | None = None):
    """A mapInArrow function that gives `step` slices of the batches, of SLICE_BYTES of column `size_of` or one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, size_of) if size_of else (batch,):
                out = step(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return run


def sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // SLICE_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


class WordHashes(dict):
    """Word to 64-bit hash, filled as words come."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def grouped_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches in which equal keys follow each other: tables that hold each key's rows whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
        if cut == 0 and held and held[-1].column(key)[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)
