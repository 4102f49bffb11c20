"""Many candidate models against many rows, as blocks of a matrix product.

Rows that fall into the same bins score alike under every candidate, so they
are first counted into cells. Cells and candidates are both packed into blocks,
one table row each, and every cell block meets every candidate block once; the
scores of a pair live in one numpy array and leave it as a histogram. No
(row, candidate) pair is ever a row, and candidates are never on the driver.

The share of top rows needs the exact k-th largest score. A first pass counts
scores into bins between the least and the greatest score a candidate can
reach; the bin that holds the k-th is known then, and a second pass brings out
only the scores that fall into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import staged

CELL_BLOCK = 1 << 16
CANDIDATE_BLOCK = 256
STEP = 4096  # cells whose scores under a block are held at a time
SCORE_BINS = 512
HELD = 16  # histograms of candidate blocks that a task holds before it passes them on

# probability of each bin, by fold and feature; the last entry is that of unknown values
Tables = list[list[np.ndarray]]


def packed_cells(cells: DataFrame, n_features: int) -> DataFrame:
    """Blocks of cells (fold int, bins array<int>, n long, up double); a bin of -1 is an unknown value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, CELL_BLOCK):
            bins = np.asarray(table.column("bins").combine_chunks().flatten(), np.int16).reshape(-1, n_features)
            columns = [np.asarray(table.column(c), t) for c, t in (("fold", np.int32), ("n", np.int64), ("up", np.float64))]
            yield pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in zip(("fold", "n", "up", "bins"), [*columns, bins])})

    return cells.select("fold", "bins", "n", "up").mapInArrow(pack, "fold binary, n binary, up binary, bins binary")


def packed_candidates(candidates: DataFrame, features: list[str], n_folds: int, block: int) -> DataFrame:
    """Blocks of candidates (candidate_id long, features, weights, wanted map<int, int>): ids, dense weights, wanted bin by fold.

    A feature that the rows do not have, or as many weights as features are not, is an error.
    """
    place = {f: i for i, f in enumerate(features)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _gathered(batches, block):
            weights = np.zeros((table.num_rows, len(features)))
            wanted = np.full((table.num_rows, n_folds), -1, np.int32)
            rows = zip(*(table.column(c).to_pylist() for c in ("candidate_id", "features", "weights", "wanted")))
            for i, (name, chosen, own, bins) in enumerate(rows):
                if len(chosen) != len(own) or not set(chosen) <= set(place):
                    raise ValueError(f"candidate {name}: {chosen} with {len(own)} weights; known features are {features}")
                for feature, weight in zip(chosen, own):
                    weights[i, place[feature]] += weight
                for fold, b in bins or ():
                    wanted[i, fold] = b
            ids = np.asarray(table.column("candidate_id"), np.int64)
            yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "weights": [weights.tobytes()], "wanted": [wanted.tobytes()]})

    chosen = candidates.select(F.col("candidate_id").cast("long"), "features", F.col("weights").cast("array<double>"), "wanted")
    return chosen.mapInArrow(pack, "ids binary, weights binary, wanted binary")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last of a partition shorter."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        while rows >= size:
            table = pa.Table.from_batches(held)
            yield table.slice(0, size)
            held = table.slice(size).to_batches()
            rows -= size
    if rows:
        yield pa.Table.from_batches(held)


class Pair:
    """A block of cells and a block of candidates."""

    def __init__(self, row: dict[str, bytes], tables: Tables, limits: tuple[float, float]):
        self.tables, self.limits = tables, limits
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.weights = np.frombuffer(row["weights"], np.float64).reshape(len(self.ids), -1)
        self.wanted = np.frombuffer(row["wanted"], np.int32).reshape(len(self.ids), -1)
        self.fold = np.frombuffer(row["fold"], np.int32)
        self.n, self.up = np.frombuffer(row["n"], np.int64), np.frombuffer(row["up"], np.float64)
        self.bins = np.frombuffer(row["bins"], np.int16).reshape(len(self.fold), -1)

    def scores(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(fold, places of its cells, their scores under each candidate, the score bins), some cells at a time.

        Products are added feature by feature, so equal cells score alike to the last bit in every pass.
        """
        for fold in np.unique(self.fold).tolist():
            own = np.flatnonzero(self.fold == fold)
            reach = [w[:, None] * t[None] for w, t in zip(self.weights.T, self.tables[fold])]
            low, high = (np.clip(sum(end(r, axis=1) for r in reach), *self.limits) for end in (np.min, np.max))
            scale = np.divide(SCORE_BINS, high - low, out=np.zeros_like(low), where=high > low)
            for start in range(0, len(own), STEP):
                cells = own[start : start + STEP]
                p = np.zeros((len(cells), len(self.ids)))
                for f, table in enumerate(self.tables[fold]):
                    p += table[self.bins[cells, f]][:, None] * self.weights[None, :, f]
                p = np.clip(p, *self.limits)
                yield fold, cells, p, np.clip((p - low) * scale, 0, SCORE_BINS - 1).astype(np.int32)


TALLIES = "fold int, candidate_id long, bin int, n long, up double, error double, loss double"
INSIDE = "fold int, candidate_id long, p double, n long, up double"


def _emitted(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def score_histograms(pairs: DataFrame, tables: Tables, limits: tuple[float, float]) -> DataFrame:
    """(fold, candidate_id, bin) with rows, rising rows, squared error and log loss; partial, to be summed."""

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (fold, ids), sums in held.items():
            who, where = np.nonzero(sums[0])
            names = np.frombuffer(ids, np.int64)[who]
            yield _emitted(TALLIES, np.full(len(who), fold), names, where, *(s[who, where] for s in sums))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list[np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                pair = Pair({c: batch.column(c)[i].as_py() for c in batch.schema.names}, tables, limits)
                shape = (len(pair.ids), SCORE_BINS)
                for fold, cells, p, bins in pair.scores():
                    key = (fold, pair.ids.tobytes())
                    if key not in held:
                        if len(held) >= HELD:
                            yield from flush(held)
                            held.clear()
                        held[key] = [np.zeros(shape, np.int64), *(np.zeros(shape) for _ in range(3))]
                    n, up = pair.n[cells][:, None], pair.up[cells][:, None]
                    safe = np.clip(p, 1e-5, 1 - 1e-5)
                    flat = (bins + np.arange(shape[0])[None] * SCORE_BINS).ravel()
                    measures = (n, up, up * (1 - p) ** 2 + (n - up) * p**2, -(up * np.log(safe) + (n - up) * np.log(1 - safe)))
                    for total, x in zip(held[key], measures):
                        spread = np.broadcast_to(x, p.shape).ravel()
                        counted = np.bincount(flat, spread, shape[0] * SCORE_BINS).reshape(shape)
                        total += np.rint(counted).astype(np.int64) if total.dtype == np.int64 else counted
        yield from flush(held)

    return pairs.mapInArrow(tally, TALLIES)


def scores_in_wanted_bins(pairs: DataFrame, tables: Tables, limits: tuple[float, float]) -> DataFrame:
    """(fold, candidate_id, p, n, up) of the cells whose score lies in the candidate's wanted bin of the fold."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = Pair({c: batch.column(c)[i].as_py() for c in batch.schema.names}, tables, limits)
                for fold, cells, p, bins in pair.scores():
                    at, who = np.nonzero(bins == pair.wanted[None, :, fold])
                    yield _emitted(INSIDE, np.full(len(at), fold), pair.ids[who], p[at, who], pair.n[cells[at]], pair.up[cells[at]])

    return pairs.mapInArrow(pick, INSIDE)


def candidate_metrics(
    cells: DataFrame, candidates: DataFrame, features: list[str], tables: Tables, limits: tuple[float, float], share: float, block: int = CANDIDATE_BLOCK
) -> DataFrame:
    """Per fold number and candidate: n, up, error and loss sums over all rows, and n and up of the top ``share`` of them.

    The top are the k = share * n (one at least) rows of the highest score, and all rows that tie with the k-th.
    Candidate ids must differ.
    """
    chosen = staged(candidates.select("candidate_id", "features", "weights"))
    cell_blocks = staged(packed_cells(cells, len(features)))

    def pairs(wanted: DataFrame) -> DataFrame:
        # Spark weighs the two tables of blocks itself
        return cell_blocks.crossJoin(staged(packed_candidates(wanted, features, len(tables), block)))

    keys = ["fold", "candidate_id"]
    first = pairs(chosen.withColumn("wanted", F.lit(None).cast("map<int,int>")))
    counted = score_histograms(first, tables, limits).groupBy(*keys, "bin")
    bins = staged(counted.agg(*[F.sum(c).alias(c) for c in ("n", "up", "error", "loss")]))
    # a candidate has at most SCORE_BINS rows a fold
    down = Window.partitionBy(*keys).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.floor(F.sum("n").over(whole) * F.lit(share)))
    ranked = bins.select(
        "*", k.alias("k"), *[F.coalesce(F.sum(c).over(down), F.lit(0)).alias(f"{c}_above") for c in ("n", "up")]
    )
    cut = staged(ranked.where("n_above < k AND k <= n_above + n").select(*keys, "bin", (F.col("k") - F.col("n_above")).alias("rest"), "n_above", "up_above"))
    wanted = cut.groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("fold", "bin"))).alias("wanted"))
    inside = scores_in_wanted_bins(pairs(chosen.join(wanted, "candidate_id")), tables, limits)
    by_score = inside.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("up").alias("up"))
    higher = Window.partitionBy(*keys).orderBy(F.col("p").desc()).rowsBetween(Window.unboundedPreceding, -1)
    passed = by_score.withColumn("passed", F.coalesce(F.sum("n").over(higher), F.lit(0)))
    top = passed.join(cut, keys).where("passed < rest").groupBy(*keys).agg(
        (F.sum("n") + F.first("n_above")).alias("top_n"), (F.sum("up") + F.first("up_above")).alias("top_up")
    )
    totals = bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "up", "error", "loss")])
    return totals.join(top, keys)
