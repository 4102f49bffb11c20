"""Exact quantiles of many columns and overlapping row sets from two scans.

Rows are told apart by the sets they belong to; nested sets of n rows lead to
n + 1 kinds. The first scan folds every column into one mergeable summary per
kind, a grid of approximate quantiles. What a set's kinds know of a value adds
up, which gives a narrow bracket around every wanted rank. The second scan
counts the rows between the brackets and gathers, aggregated by value, only
what lies inside them. The counts prove that a bracket holds its rank; should
a summary ever have been off by more than it promises, the interval that does
hold the rank is scanned for.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Hashable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite
from barloom.session import staged

# Rank error of a summary is rows / ACCURACY; its grid has GRID steps.
ACCURACY = 10_000
GRID = 2_000

Key = tuple[Hashable, str]


def edges_passed(x: Column, edges: Column, most: int) -> Column:
    """Number of the sorted ``edges`` (an array of at most ``most``) that are <= x, by halving steps; 0 for null edges.

    For a number that a filter or a join reads: Spark would push that below the steps of ``add_edges_passed``, and double them there.
    """
    steps = F.expr(f"array({','.join(str(1 << bit) for bit in reversed(range(most.bit_length())))})")
    return F.aggregate(steps, F.lit(0), lambda a, step: F.when(F.get(edges, a + step - 1) <= x, a + step).otherwise(a))


def add_edges_passed(df: DataFrame, places: dict[str, tuple[Column, Column]], most: int, *, below: bool = False) -> DataFrame:
    """``df`` with, under each name of ``places`` (x, edges), the number of its sorted edges that are <= x, or < x; 0 for null edges.

    For edges (an array of at most ``most``) that differ from row to row, or sets of them too many for a tree each. Each halving
    step is a projection of the one before, so that all steps stay in generated code; a function folded over an array would not.
    Nothing may filter by the numbers, nor join by them, before they are aggregated or written.
    """
    df = df.withColumns({name: F.lit(0) for name in places})
    for step in (1 << bit for bit in reversed(range(most.bit_length()))):
        passed = {}
        for name, (x, edges) in places.items():
            edge = F.get(edges, F.col(name) + (step - 1))
            passed[name] = F.when(edge < x if below else edge <= x, F.col(name) + step).otherwise(F.col(name))
        df = df.withColumns(passed)
    return df


def even_steps(n: int) -> Column:
    """The literal array 0, 1/n, ..., 1."""
    return F.expr(f"array({','.join(f'{i / n!r}D' for i in range(n + 1))})")


def edge_table(edges: Sequence[Sequence[float]]) -> Column:
    """A literal array of arrays."""
    rows = [f"CAST(array({','.join(f'{float(e)!r}D' for e in own)}) AS array<double>)" for own in edges]
    return F.expr(f"array({','.join(rows)})")


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    groups: dict[Hashable, Column] | None = None,
    accuracy: int = ACCURACY,
) -> dict[Key, list[float]]:
    """Linear-interpolated quantiles of the finite values: {(group, column): [value, ...]}.

    ``groups`` are row sets by condition, at most 62, which may overlap;
    without them there is one, 0. A set without values gives no entry. What
    reaches the driver are grids per kind of row and column, whatever the row
    count.
    """
    groups = {0: F.lit(True)} if groups is None else groups
    masks = [F.when(mask, F.lit(1 << i)).otherwise(0).cast("long") for i, mask in enumerate(groups.values())]
    kind = sum(masks[1:], masks[0]).alias("kind")
    kinds = df.select(kind, *[finite(F.col(c)).alias(f"x{i}") for i, c in enumerate(columns)]).where("kind <> 0")
    grid = even_steps(GRID)
    rows = (
        kinds.groupBy("kind")
        .agg(
            *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(columns))],
            *[F.percentile_approx(f"x{i}", grid, accuracy).alias(f"q{i}") for i in range(len(columns))],
        )
        .collect()
    )
    sizes, brackets, wanted = {}, {}, {}
    for (b, g), (i, c) in itertools.product(enumerate(groups), enumerate(columns)):
        own = [(r[f"n{i}"], np.array(r[f"q{i}"])) for r in rows if r.kind >> b & 1 and r[f"n{i}"]]
        if own:
            sizes[g, c] = sum(n for n, _ in own)
            wanted[g, c] = sorted({r for p in probabilities for r in _neighbours(p, sizes[g, c])})
            brackets[g, c] = _brackets(own, wanted[g, c], accuracy)
    found: dict[Key, dict[int, float]] = {k: {} for k in brackets}
    while brackets:
        brackets = _refine(kinds, list(groups), columns, brackets, wanted, found)
    return {k: [_between(found[k], p, sizes[k]) for p in probabilities] for k in found}


def _neighbours(p: float, n: int) -> tuple[int, int]:
    return math.floor(p * (n - 1)), math.ceil(p * (n - 1))


def _between(at: dict[int, float], p: float, n: int) -> float:
    position = p * (n - 1)
    low, high = _neighbours(p, n)
    if low == high or at[low] == at[high]:
        return at[low]
    return (high - position) * at[low] + (position - low) * at[high]


def _brackets(summaries: list[tuple[int, np.ndarray]], ranks: list[int], accuracy: int) -> list[tuple[float, float]]:
    """Half-open intervals around the values at ``ranks`` of all summarised rows together, overlapping ones joined.

    Of n rows with grid values up to number j not above v, at least
    n * (j / GRID - 1 / accuracy) and at most n * ((j + 1) / GRID + 1 / accuracy) are not above v.
    """
    values = np.unique(np.concatenate([grid for _, grid in summaries]))
    least, most = np.zeros(len(values)), np.zeros(len(values))
    for n, grid in summaries:
        j = np.searchsorted(grid, values, side="right") - 1
        least += n * np.clip(j / GRID - 1 / accuracy, 0, 1) * (j >= 0)
        most += n * np.clip((j + 1) / GRID + 1 / accuracy, 0, 1)
    out: list[tuple[float, float]] = []
    for r in ranks:
        low = values[max(0, int(np.searchsorted(most, r, side="right")) - 1)]
        high = values[min(len(values) - 1, int(np.searchsorted(least, r + 1)))]
        bound = math.nextafter(float(high), math.inf)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], bound))
        else:
            out.append((float(low), bound))
    return out


def _refine(
    kinds: DataFrame,
    groups: list[Hashable],
    columns: list[str],
    brackets: dict[Key, list[tuple[float, float]]],
    wanted: dict[Key, list[int]],
    found: dict[Key, dict[int, float]],
) -> dict[Key, list[tuple[float, float]]]:
    """Fill ``found`` from one scan; what is left to look for comes back as brackets that surely hold it."""
    used = [(i, c) for i, c in enumerate(columns) if any(k[1] == c for k in brackets)]
    # a column's slots lie between the ends of all its sets' brackets
    ends = {c: sorted({e for (_, own), pairs in brackets.items() if own == c for pair in pairs for e in pair}) for _, c in used}
    pairs = F.array(*[F.struct(F.lit(at).alias("c"), F.col(f"x{i}").alias("x")) for at, (i, _) in enumerate(used)])
    long = kinds.select("kind", F.explode(pairs).alias("s")).select("kind", "s.c", "s.x").where("x IS NOT NULL")
    table = edge_table([[e for e in ends[c] if math.isfinite(e)] for _, c in used])
    slots = add_edges_passed(long, {"slot": (F.col("x"), F.get(table, F.col("c")))}, max(map(len, ends.values())))
    # slot s lies before finite end number s; only values inside a bracket are told apart
    told = [_told(ends[c], [pair for k, pairs in brackets.items() if k[1] == c for pair in pairs]) for _, c in used]
    is_told = F.get(F.get(F.expr(f"array({','.join('array(' + ','.join(str(t).lower() for t in own) + ')' for own in told)})"), F.col("c")), F.col("slot"))
    counted = staged(
        slots.select("kind", "c", "slot", F.when(is_told, F.col("x")).alias("x")).groupBy("kind", "c", "slot", "x").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counted.groupBy("kind", "c", "slot").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(groups), len(used), max(map(len, told))), np.int64)
    for t in totals:
        for b in range(len(groups)):
            counts[b, t.c, t.slot] += t.n * (t.kind >> b & 1)
    before: dict[tuple[int, int, int], int] = {}
    again: dict[Key, list[tuple[float, float]]] = {}
    places = []
    for (b, g), (at, (_, c)) in itertools.product(enumerate(groups), enumerate(used)):
        if (g, c) not in brackets:
            continue
        finite_ends = [e for e in ends[c] if math.isfinite(e)]
        passed = 0
        for slot in range(len(finite_ends) + 1):
            n = int(counts[b, at, slot])
            before[b, at, slot] = passed
            missing = [r for r in wanted[g, c] if passed <= r < passed + n and r not in found[g, c]]
            if told[at][slot]:
                places += [(b, at, slot, r - passed) for r in missing]
            elif missing:
                bounds = [-math.inf, *finite_ends, math.inf]
                again.setdefault((g, c), []).append((bounds[slot], bounds[slot + 1]))
            passed += n
    if places:
        # a slot inside a bracket holds a small fixed share of the rows, collapsed to distinct values
        sets = F.array(*[F.struct(F.lit(b).alias("g"), (F.shiftright("kind", b).bitwiseAND(1) == 1).alias("own")) for b in range(len(groups))])
        by_set = counted.where("x IS NOT NULL").select("c", "slot", "x", "n", F.explode(sets).alias("s")).where("s.own")
        summed = by_set.groupBy("s.g", "c", "slot", "x").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("g", "c", "slot").orderBy("x")
        asked = kinds.sparkSession.createDataFrame(places, "g int, c int, slot int, rank long")
        upto = summed.withColumn("upto", F.sum("n").over(order)).join(asked, ["g", "c", "slot"])
        for hit in upto.where("rank < upto AND rank >= upto - n").select("g", "c", "slot", "rank", "x").collect():
            found[groups[hit.g], used[hit.c][1]][before[hit.g, hit.c, hit.slot] + hit.rank] = hit.x
    return again


def _told(ends: list[float], brackets: list[tuple[float, float]]) -> list[bool]:
    """For every slot between the finite ends, and beyond them, whether a bracket covers it."""
    bounds = [-math.inf, *[e for e in ends if math.isfinite(e)], math.inf]
    return [any(a <= low and high <= b for a, b in brackets) for low, high in itertools.pairwise(bounds)]
