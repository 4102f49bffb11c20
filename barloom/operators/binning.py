"""Quantile-bin probability mappers.

Fitting aggregates on Spark (exact quantiles, counts per bin); what comes back
is a few numbers per feature and bin, whatever the row count. Applying turns
them into a literal decision tree, so scoring is a projection: no join, no
shuffle, and it stays in generated code.
"""

from __future__ import annotations

from collections.abc import Hashable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.numeric import clamp, finite
from barloom.operators.quantiles import add_edges_passed, edge_table, exact_quantiles

# Limits of a bin probability, fewest rows and edges for a fit.
PROB_FLOOR, PROB_CEIL = 1e-4, 1 - 1e-4
MIN_ROWS, MIN_EDGES = 600, 4


@dataclass(frozen=True)
class Mapper:
    """inner edges (left-closed bins), one probability per bin, and the value for unknown input."""

    inner: tuple[float, ...]
    probs: tuple[float, ...]
    base: float


@dataclass(frozen=True)
class Model:
    """Feature names with one weight each."""

    features: tuple[str, ...]
    weights: tuple[float, ...]

    def __post_init__(self):
        if len(self.features) != len(self.weights):
            raise ValueError(f"{len(self.features)} features but {len(self.weights)} weights")


def interval_tree(x: str, edges: tuple[float, ...], leaves: list[str]) -> str:
    """SQL CASE tree: leaves[number of edges <= x], found in log2(edges) comparisons."""
    if not edges:
        return leaves[0]
    middle = len(edges) // 2
    below = interval_tree(x, edges[:middle], leaves[: middle + 1])
    above = interval_tree(x, edges[middle + 1 :], leaves[middle + 1 :])
    return f"CASE WHEN {x} < {edges[middle]!r}D THEN {below} ELSE {above} END"


def mapped_probability(column: str, mapper: Mapper) -> Column:
    """Bin probability of the column's value; unknown or infinite input gets the base."""
    tree = interval_tree(f"`{column}`", mapper.inner, [f"{p!r}D" for p in mapper.probs])
    return F.when(finite(F.col(column)).isNull(), F.lit(mapper.base)).otherwise(F.expr(tree))


def model_score(model: Model, mappers: dict[str, Mapper]) -> Column:
    """Weighted sum of the feature probabilities, limited to the open unit interval."""
    total = F.lit(0.0)
    for feature, weight in zip(model.features, model.weights):
        total = total + F.lit(float(weight)) * mapped_probability(feature, mappers[feature])
    return clamp(total, PROB_FLOOR, PROB_CEIL)


def quantile_edges(df: DataFrame, features: list[str], n_bins: int = 20) -> DataFrame:
    """(feature, sorted distinct exact quantiles) over finite values."""
    edges = exact_quantiles(df, features, [i / n_bins for i in range(n_bins + 1)])
    rows = [(feature, sorted(set(values))) for (_, feature), values in edges.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, edges array<double>")


@dataclass(frozen=True)
class Totals:
    """Of a group's rows with a finite value of a feature: their number and the sum of their labels; and the mean label of all."""

    n: int
    up: float
    mean: float | None


def count_totals(df: DataFrame, features: list[str], label: str, groups: dict[Hashable, Column]) -> dict[Hashable, dict[str, Totals]]:
    y = F.col(label).cast("double")
    row = df.agg(
        *[F.avg(F.when(mask, y)).alias(f"mean{i}") for i, mask in enumerate(groups.values())],
        *[F.count_if(mask & known(c)).alias(f"n{i}_{j}") for i, mask in enumerate(groups.values()) for j, c in enumerate(features)],
        *[F.sum(F.when(mask & known(c), y)).alias(f"up{i}_{j}") for i, mask in enumerate(groups.values()) for j, c in enumerate(features)],
    ).first()
    return {
        g: {c: Totals(row[f"n{i}_{j}"], row[f"up{i}_{j}"] or 0.0, row[f"mean{i}"]) for j, c in enumerate(features)}
        for i, g in enumerate(groups)
    }


def known(column: str) -> Column:
    return finite(F.col(column)).isNotNull()


def fit_mappers(
    df: DataFrame,
    features: list[str],
    label: str,
    *,
    n_bins: int = 20,
    alpha: float = 120.0,
    groups: dict[Hashable, Column] | None = None,
    totals: dict[Hashable, dict[str, Totals]] | None = None,
    min_rows: int = MIN_ROWS,
) -> dict[Hashable, dict[str, Mapper]]:
    """Mapper per feature, for each group a row belongs to.

    ``groups`` are row sets by condition (one row may train several folds);
    without it there is one group, 0. ``totals`` of the groups are counted if
    the caller does not have them. Fewer than ``min_rows`` finite values, or
    fewer than four distinct edges, give a constant mapper.
    """
    groups = {0: F.lit(True)} if groups is None else groups
    totals = count_totals(df, features, label, groups) if totals is None else totals
    base, out = {}, {}
    for g in groups:
        out[g] = {}
        for c in features:
            t = totals[g][c]
            base[g, c] = t.up / t.n if t.n >= min_rows else 0.5 if t.mean is None else t.mean
            out[g][c] = Mapper((), (base[g, c],), base[g, c])

    inner = {}
    for (g, c), values in exact_quantiles(df, features, [i / n_bins for i in range(n_bins + 1)], groups).items():
        edges = sorted(set(values))
        if totals[g][c].n >= min_rows and len(edges) >= MIN_EDGES:
            inner[g, c] = tuple(edges[1:-1])
    if not inner:
        return out

    # a row's pairs are exploded and counted inside the task
    y = F.col(label).cast("double").alias("y")
    pairs = [F.when(groups[g] & known(c), F.struct(F.lit(i).alias("i"), finite(F.col(c)).alias("x"), y)) for i, (g, c) in enumerate(inner)]
    long = df.select(F.explode(F.array(*pairs)).alias("s")).where("s IS NOT NULL").select("s.*")
    edges = F.get(edge_table(list(inner.values())), F.col("i"))
    binned = add_edges_passed(long, {"bin": (F.col("x"), edges)}, max(map(len, inner.values())))
    counts = binned.groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("up")).collect()
    seen = {(r.i, r.bin): (r.n, r.up) for r in counts}
    for i, ((g, c), edges) in enumerate(inner.items()):
        probs = []
        for k in range(len(edges) + 1):
            n, up = seen.get((i, k), (0, 0.0))
            probs.append(min(max((up + alpha * base[g, c]) / (n + alpha), PROB_FLOOR), PROB_CEIL))
        out[g][c] = Mapper(edges, tuple(probs), base[g, c])
    return out


def mappers_frame(spark: SparkSession, mappers: dict[str, Mapper]) -> DataFrame:
    """The fitted numbers as a small table, for storing or inspection."""
    rows = [(name, list(m.inner), list(m.probs), m.base) for name, m in sorted(mappers.items())]
    schema = "feature string, inner array<double>, probs array<double>, base double"
    return spark.createDataFrame(rows, schema)
