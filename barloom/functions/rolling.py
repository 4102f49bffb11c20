"""Rolling aggregates over sorted series in Arrow batches of whole series.

A frame's values are taken oldest first, all rows of a batch at once, and
summed in the order in which Spark's own frames sum them; so the results agree
to the last bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KERNELS = {F.avg: "mean", F.sum: "sum", F.max: "max", F.min: "min", F.stddev_pop: "std0", F.stddev_samp: "std1"}
BATCH_ROWS = 50_000  # rows that a task gathers before it works on them
OUT_ROWS = 10_000


@dataclass(frozen=True)
class Roll:
    """An aggregate of the ``n`` rows ending ``shift`` rows back: null until there are n, unless ``dense`` of n known ones."""

    kind: str
    n: int
    shift: int
    dense: bool


def whole_series(batches: Iterator[pa.RecordBatch], bar: str, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table of whole series, bar number of each row from 0) from sorted batches; at least ``rows`` rows but for the last table.

    What waits for more batches is one series, as long as the calendar.
    """
    waiting: list[pa.RecordBatch] = []
    have = 0
    for batch in batches:
        starts = np.flatnonzero(batch.column(bar).to_numpy() == 1) if have + batch.num_rows >= rows else ()
        if len(starts) and (have or starts[-1]):
            last = int(starts[-1])
            yield _gathered([*waiting, batch.slice(0, last)], bar)
            waiting, have, batch = [], 0, batch.slice(last)
        waiting.append(batch)
        have += batch.num_rows
    if have:
        yield _gathered(waiting, bar)


def _gathered(batches: list[pa.RecordBatch], bar: str) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table, table[bar].to_numpy() - 1


def rolled(x: np.ndarray, known: np.ndarray | None, bar: np.ndarray, r: Roll) -> tuple[np.ndarray, np.ndarray]:
    """(value, whether there is one) of every row; ``known`` is None where all values are."""
    size, reach = len(x), r.n - 1 + r.shift
    out, valid = np.zeros(size), bar >= reach
    if size <= reach:
        return out, np.zeros(size, bool)
    # places of the frames' values, oldest first; frames that reach over a start are not valid
    at = [slice(reach - k, size - k) for k in range(reach, r.shift - 1, -1)]
    if known is not None and not r.dense:
        unknown = np.append(0, np.cumsum(~known))
        valid[reach:] &= unknown[r.n : r.n + size - reach] == unknown[: size - reach]
        known = None
    with np.errstate(all="ignore"):
        if known is None:
            out[reach:] = _full([x[s] for s in at], r)
            if r.kind == "std1" and r.n == 1:
                valid[:] = False
        else:
            out[reach:], some = _gapped([x[s] for s in at], [known[s] for s in at], r)
            valid[reach:] &= some
    return out, valid


def _full(values: list[np.ndarray], r: Roll) -> np.ndarray:
    if r.kind in ("max", "min"):
        pick = {"max": np.maximum, "min": np.fmin}[r.kind]
        out = values[0].copy()
        for v in values[1:]:
            pick(out, v, out=out)
        return out
    if r.kind in ("std0", "std1"):
        mean, square = np.zeros(len(values[0])), np.zeros(len(values[0]))
        for i, v in enumerate(values):
            off = v - mean
            part = off / (i + 1.0)
            mean += part
            square += off * (off - part)
        return np.sqrt(square / (r.n - (r.kind == "std1")))
    total = np.zeros(len(values[0]))
    for v in values:
        total += v
    if r.kind == "deviation":
        mean, total = total / r.n, np.zeros(len(total))
        for v in values:
            total += np.abs(v - mean)
    return total if r.kind == "sum" else total / r.n


def _gapped(values: list[np.ndarray], known: list[np.ndarray], r: Roll) -> tuple[np.ndarray, np.ndarray]:
    """The same without the unknown values; and whether there is a result."""
    n = sum(k.astype(np.int64) for k in known).astype(float)
    if r.kind in ("max", "min"):
        pick, least = {"max": (np.maximum, -np.inf), "min": (np.fmin, np.inf)}[r.kind]
        out = np.full(len(n), least)
        for v, k in zip(values, known):
            out = np.where(k, pick(out, v), out)
        return out, n > 0
    if r.kind in ("std0", "std1"):
        seen, mean, square = (np.zeros(len(n)) for _ in range(3))
        for v, k in zip(values, known):
            off = v - mean
            part = off / (seen + 1.0)
            seen, mean, square = seen + k, np.where(k, mean + part, mean), np.where(k, square + off * (off - part), square)
        less = float(r.kind == "std1")
        return np.sqrt(square / (n - less)), n > less
    total = np.zeros(len(n))
    for v, k in zip(values, known):
        total = np.where(k, total + v, total)
    if r.kind == "deviation":
        mean, total = total / n, np.zeros(len(n))
        for v, k in zip(values, known):
            total = np.where(k, total + np.abs(v - mean), total)
        return total / r.n, n >= 0
    return (total if r.kind == "sum" else total / n), n > 0


def add_rolled(df: DataFrame, bar: str, rolls: dict[str, tuple[Column, Roll]]) -> DataFrame:
    """``df`` with rolled columns; its partitions hold whole series in order, their rows numbered from 1 by ``bar``."""
    texts = {str(x): x for x, _ in rolls.values()}
    inputs = {text: f"_in{i}_" for i, text in enumerate(texts)}
    plan = {name: (inputs[str(x)], r) for name, (x, r) in rolls.items()}
    given = df.columns
    out_type = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in plan]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_series(batches, bar, BATCH_ROWS):
            columns = {}
            for name in inputs.values():
                x = table[name].combine_chunks()
                known = None if x.null_count == 0 else x.is_valid().to_numpy(zero_copy_only=False)
                columns[name] = (x.fill_null(0.0).to_numpy(zero_copy_only=False), known)
            out = table.select(given)
            for name, (x, r) in plan.items():
                value, valid = rolled(*columns[x], at, r)
                out = out.append_column(name, pa.array(value, pa.float64(), mask=~valid))
            yield from out.to_batches(max_chunksize=OUT_ROWS)

    with_inputs = df.select("*", *[x.cast("double").alias(inputs[text]) for text, x in texts.items()])
    return with_inputs.mapInArrow(run, out_type)
