"""What the operators share: word and shingle hashing, Arrow batches, sorted groups, hidden columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 4 << 20  # text that one vectorised step inside a task holds at a time
WORKER_STATE = "barloom_worker_state"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` bears, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def arrow_map(df: DataFrame, step: Callable[..., Iterator[pa.RecordBatch]], schema: str | T.StructType, *, keeps: bool = False, **parameters) -> DataFrame:
    """``step`` on the batches of each partition. Only steps that ``keeps`` names find what ``once_per_worker`` holds in a Python worker."""
    step = functools.partial(step, **parameters) if parameters else step
    return df.mapInArrow(step if keeps else functools.partial(_unburdened, step=step), schema)


def _unburdened(batches: Iterator[pa.RecordBatch], step: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    # a worker outlives the query that filled its tables, and an executor has several workers
    if held := sys.modules.pop(WORKER_STATE, None):
        held.__dict__.clear()
        gc.collect()
        _give_back()
    yield from step(batches)
    _give_back()


def _give_back() -> None:
    """Freed memory goes back to the system; a worker would keep it while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def discard(*tables: DataFrame) -> None:
    """Delete written tables whose readers are done."""
    for table in tables:
        if files := table.inputFiles():
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    It does so when the driver collects its garbage, which on a driver with
    room to spare may come long after the files were last read.
    """
    gc.collect()
    spark._jvm.System.gc()


def pack(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Replace a text column by compressed bytes, for texts that a shuffle carries."""
    press = zstandard.ZstdCompressor(level=3)
    for batch, texts in text_slices(batches, column):
        at = batch.schema.get_field_index(column)
        yield batch.set_column(at, pa.field(column, pa.binary()), pa.array([press.compress(t) for t in texts], pa.binary()))


def unpacked(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The reverse of ``pack``, some rows at a time."""
    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            at = part.schema.get_field_index(column)
            texts = pa.array([press.decompress(x.as_py()) for x in part.column(column)], pa.binary())
            yield part.set_column(at, pa.field(column, pa.binary()), texts)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in row ranges of about ``limit`` bytes of text; null text is empty."""
    for batch in batches:
        values = batch.column(column).cast(pa.binary())
        start, held = 0, 0
        rows: list[bytes] = []
        for i in range(len(values)):
            value = values[i].as_py() or b""
            rows.append(value)
            held += len(value)
            if held >= limit:
                yield batch.slice(start, i + 1 - start), rows
                start, held, rows = i + 1, 0, []
        if rows:
            yield batch.slice(start, len(rows)), rows


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each window of ``width`` words."""
    n = len(hashes) - width + 1
    folded = np.full(n, width, np.uint64)
    for offset in range(width):
        folded = mixed(folded * MULTIPLIER + hashes[offset : offset + n])
    return folded


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of the whole sequence if it is shorter."""
    return np.unique(shingle_windows(hashes, min(k, len(hashes)))) if len(hashes) else hashes


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Shingles of lower-cased (A-Z) words; bytes.lower and bytes.split know ASCII letters and white space only."""
    words = [text.lower().split() for text in texts]
    hashes = word_hashes([w for ws in words for w in ws])
    ends = np.cumsum([len(ws) for ws in words])
    return [shingle_set(hashes[e - len(ws) : e], k) for ws, e in zip(words, ends)]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that come sorted by an integer key: a table and the bounds of its groups.

    The group that reaches a batch's end waits for the next batch, so memory is a batch and one group.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if waiting and waiting[-1].column(key)[-1].as_py() == keys[-1]:
            waiting.append(batch)
            continue
        cut = int(np.searchsorted(keys, keys[-1], side="left"))
        table = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
        if table.num_rows:
            yield table, group_bounds(table.column(key).to_numpy())
        waiting = [batch.slice(cut)]
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, group_bounds(table.column(key).to_numpy())


def group_bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key together and in order, for sorted_groups; the caller bounds the group size."""
    return df.repartition(F.col(key)).sortWithinPartitions(key, *order)


def once_per_worker(key: tuple, make: Callable[[], object]) -> object:
    """``make()`` of the first task with this key in a Python worker; later tasks of the worker share it, until one of another kind comes.

    Functions travel by value, so a module's own variables do not outlive a task.
    """
    held = sys.modules.setdefault(WORKER_STATE, types.ModuleType(WORKER_STATE)).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Forest:
    """Disjoint sets over 0..n-1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
