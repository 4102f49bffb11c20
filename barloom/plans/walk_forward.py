"""Walk-forward evaluation of candidate feature/weight combinations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.binning import PROB_CEIL, PROB_FLOOR, Totals, fit_mappers, known
from barloom.operators.quantiles import add_edges_passed, edge_table
from barloom.operators.scoring import CANDIDATE_BLOCK, candidate_metrics
from barloom.operators.series import next_day_labels
from barloom.session import staged

# Fixed values: (train share, validation share) of each fold, and the gates.
FOLD_PLAN = [(0.55, 0.10), (0.65, 0.10), (0.75, 0.10), (0.85, 0.10)]
MIN_DATES, MIN_TRAIN_DATES = 400, 120
MIN_TRAIN_ROWS, MIN_VAL_ROWS = 200_000, 20_000
TOP_SHARE = 0.10


FEW_DATES, FEW_TRAIN_DATES, NO_VALIDATION = "few_dates", "few_train_dates", "no_validation_dates"
FEW_TRAIN_ROWS, FEW_VALIDATION_ROWS = "few_train_rows", "few_validation_rows"


def day_counts(df: DataFrame, label: str, features: list[str] = ()) -> DataFrame:
    """One row per date: rows, rising rows, and both again for the rows with a finite value of each feature."""
    y = F.col(label).cast("double")
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(y).alias("up"),
        *[F.count_if(known(c)).alias(f"rows_{i}") for i, c in enumerate(features)],
        *[F.sum(F.when(known(c), y)).alias(f"up_{i}") for i, c in enumerate(features)],
    )


def fold_report(
    days: DataFrame,
    plan: list[tuple[float, float]] = FOLD_PLAN,
    min_train_rows: int = MIN_TRAIN_ROWS,
    min_val_rows: int = MIN_VAL_ROWS,
) -> DataFrame:
    """Every planned fold, also those that are not used: ends, rows and base rates of both parts, and why it was dropped.

    Train is date <= train_end, validation is train_end < date <= val_end.
    ``days`` holds the rows and rising rows of each date. Folds are nested, so
    theirs are sums over stretches of the one sorted calendar.
    """
    calendar = days.agg(F.array_sort(F.collect_list(F.struct("date", "rows", "up"))).alias("days")).select("days", F.size("days").alias("n"))
    shares = F.array(
        *[F.struct(F.lit(i).alias("fold"), F.lit(t).alias("t"), F.lit(t + v).alias("v")) for i, (t, v) in enumerate(plan, start=1)]
    )
    ends = calendar.select("days", "n", F.explode(shares).alias("s")).select(
        "s.fold",
        "days",
        "n",
        F.floor(F.col("n") * F.col("s.t")).cast("int").alias("train_i"),
        F.least(F.col("n") - 1, F.floor(F.col("n") * F.col("s.v")).cast("int")).alias("val_i"),
    )

    def total(field: str, start: Column, length: Column) -> Column:
        stretch = F.slice("days", start, F.greatest(length, F.lit(0)))
        return F.aggregate(stretch, F.lit(0).cast("double"), lambda a, day: a + day[field])

    train, val = (F.lit(1), F.col("train_i")), (F.col("train_i") + 1, F.col("val_i") - F.col("train_i"))
    counted = ends.select(
        "fold",
        "n",
        "train_i",
        "val_i",
        F.get("days", F.col("train_i") - 1)["date"].alias("train_end"),
        F.get("days", F.col("val_i") - 1)["date"].alias("val_end"),
        total("rows", *train).cast("long").alias("train_rows"),
        total("rows", *val).cast("long").alias("val_rows"),
        total("up", *train).alias("train_up"),
        total("up", *val).alias("val_up"),
    )
    reason = (
        F.when(F.col("n") < MIN_DATES, FEW_DATES)
        .when(F.col("train_i") < MIN_TRAIN_DATES, FEW_TRAIN_DATES)
        .when(F.col("val_i") <= F.col("train_i"), NO_VALIDATION)
        .when(F.col("train_rows") < min_train_rows, FEW_TRAIN_ROWS)
        .when(F.col("val_rows") < min_val_rows, FEW_VALIDATION_ROWS)
    )
    return counted.select(
        "fold",
        "train_end",
        "val_end",
        "train_rows",
        "val_rows",
        F.try_divide("train_up", "train_rows").alias("train_base_rate"),
        F.try_divide("val_up", "val_rows").alias("val_base_rate"),
        reason.alias("dropped"),
    )


def fold_plan(df: DataFrame, plan: list[tuple[float, float]] = FOLD_PLAN) -> DataFrame:
    """(fold, train_end, val_end) of the folds that the distinct dates allow; none when there are fewer than 400."""
    days = df.groupBy("date").agg(F.count(F.lit(1)).alias("rows"), F.lit(0.0).alias("up"))
    return fold_report(days, plan, 0, 0).where("dropped IS NULL").select("fold", "train_end", "val_end")


def unseen(candidates: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Candidates whose feature set has not been evaluated yet."""
    key = F.array_sort("features")
    return candidates.withColumn("_key", key).join(
        evaluated.select(key.alias("_key")).distinct(), "_key", "left_anti"
    ).drop("_key")


class WalkForward:
    """Fitted folds over a labelled frame; ``evaluate`` scores candidates against them.

    Labels are written out once, and counted by date once: fold borders, sizes
    and base rates are sums over that calendar. Mappers are fitted per fold on
    its own train rows only. ``report`` holds every planned fold, with the
    reason where it was dropped.
    """

    def __init__(
        self,
        frame: DataFrame,
        features: list[str],
        *,
        n_bins: int = 20,
        alpha: float = 120.0,
        min_train_rows: int = MIN_TRAIN_ROWS,
        min_val_rows: int = MIN_VAL_ROWS,
    ):
        self.features = features
        labelled = next_day_labels(frame.select("ticker", "date", "close", *features))
        self.rows = staged(labelled.select("date", "target_up", *features))
        days = staged(day_counts(self.rows, "target_up", features))
        self.report = staged(fold_report(days, min_train_rows=min_train_rows, min_val_rows=min_val_rows))
        self.folds = self.report.where("dropped IS NULL").orderBy("fold").collect()
        if not self.folds:
            reasons = {r.dropped for r in self.report.select("dropped").distinct().collect()}
            raise ValueError(f"no fold can be validated: {', '.join(sorted(reasons))}")
        trains = {f.fold: F.col("date") <= F.lit(f.train_end) for f in self.folds}
        totals = self._totals(days, trains)
        self.mappers = fit_mappers(self.rows, features, "target_up", n_bins=n_bins, alpha=alpha, groups=trains, totals=totals)

    def _totals(self, days: DataFrame, trains: dict[int, Column]) -> dict[int, dict[str, Totals]]:
        """What the calendar's counts say about each fold's train rows."""
        row = days.agg(
            *[F.sum(F.when(mask, F.col(f"{c}_{i}"))).alias(f"{c}_{fold}_{i}") for fold, mask in trains.items() for c in ("rows", "up") for i in range(len(self.features))]
        ).first()
        rates = {f.fold: f.train_base_rate for f in self.folds}
        return {
            fold: {c: Totals(row[f"rows_{fold}_{i}"] or 0, row[f"up_{fold}_{i}"] or 0.0, rates[fold]) for i, c in enumerate(self.features)}
            for fold in trains
        }

    def cells(self) -> DataFrame:
        """Validation rows counted by fold and bins: (fold place, bins, n, up). A bin of -1 is an unknown value."""
        parts = [
            F.when((F.col("date") > F.lit(f.train_end)) & (F.col("date") <= F.lit(f.val_end)), F.lit(i)) for i, f in enumerate(self.folds)
        ]
        placed = self.rows.select(
            F.explode(F.array(*parts)).alias("fold"), F.col("target_up").cast("double").alias("y"), *self.features
        ).where("fold IS NOT NULL")
        inner = {c: [self.mappers[f.fold][c].inner for f in self.folds] for c in self.features}
        places = {f"_bin{i}": (F.col(c), F.get(edge_table(own), F.col("fold"))) for i, (c, own) in enumerate(inner.items())}
        placed = add_edges_passed(placed, places, max(len(edges) for own in inner.values() for edges in own))
        bins = [F.when(known(c), F.col(f"_bin{i}")).otherwise(-1) for i, c in enumerate(self.features)]
        return placed.groupBy("fold", F.array(*bins).alias("bins")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("up"))

    def fold_metrics(self, candidates: DataFrame, block: int = CANDIDATE_BLOCK) -> DataFrame:
        """Per candidate and fold: Brier, log-loss, top-decile hit rate, lift and fold score.

        The decile threshold is the k-th largest probability; every row tied
        with it counts as top.
        """
        tables = [[np.array([*m.probs, m.base]) for m in (self.mappers[f.fold][c] for c in self.features)] for f in self.folds]
        sums = candidate_metrics(self.cells(), candidates, self.features, tables, (PROB_FLOOR, PROB_CEIL), TOP_SHARE, block)
        numbers = F.array(*[F.lit(f.fold) for f in self.folds])
        rates = sums.select(
            F.get(numbers, F.col("fold")).alias("fold"),
            "candidate_id",
            (F.col("error") / F.col("n")).alias("brier"),
            (F.col("loss") / F.col("n")).alias("logloss"),
            (F.col("up") / F.col("n")).alias("base_rate"),
            (F.col("top_up") / F.col("top_n")).alias("top_hit"),
        )
        lift = F.when(F.col("base_rate") > 0, F.col("top_hit") / F.col("base_rate")).otherwise(F.lit(1.0))
        return rates.withColumn("lift", lift).withColumn(
            "fold_score",
            F.col("top_hit") + 0.40 * F.col("lift") - 0.80 * F.col("brier") - 0.20 * F.col("logloss"),
        )

    def evaluate(self, candidates: DataFrame, block: int = CANDIDATE_BLOCK) -> DataFrame:
        """One row per candidate (candidate_id, features, weights): mean metrics and the stability-penalised score."""
        return summarize_folds(self.fold_metrics(candidates, block))


def summarize_folds(metrics: DataFrame) -> DataFrame:
    """Across folds: mean score minus a quarter of its population std, and the metric means."""
    grouped = metrics.groupBy("candidate_id").agg(
        F.avg("fold_score").alias("score_mean"),
        F.stddev_pop("fold_score").alias("score_std"),
        F.avg("top_hit").alias("top_hit_mean"),
        F.avg("lift").alias("lift_mean"),
        F.avg("brier").alias("brier_mean"),
        F.avg("logloss").alias("logloss_mean"),
    )
    return grouped.withColumn("score", F.col("score_mean") - 0.25 * F.col("score_std"))


def best_candidates(scores: DataFrame, keep: int = 120) -> DataFrame:
    """The ``keep`` best, highest score first."""
    return scores.orderBy(F.col("score").desc(), "candidate_id").limit(keep)
