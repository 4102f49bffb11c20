"""Robustness report over buy candidates: rank scores, buckets, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import row_std, to_number
from barloom.operators.quantiles import exact_quantiles
from barloom.operators.ranking import SLOT_ROWS, percent_ranks
from barloom.session import staged

# Factor weights, blend, bucket bounds (right-closed) and labels.
QUALITY_WEIGHTS = {
    "composite_pct": 0.40,
    "momentum_pct": 0.22,
    "breakout_pct": 0.16,
    "volume_pct": 0.14,
    "volatility_pct": 0.08,
}
QUALITY_SHARE, STABILITY_SHARE = 0.72, 0.28
BUCKETS = {
    "momentum_bucket": ("ret_5d", [0.03, 0.10, 0.20], ["weak", "building", "strong", "extreme"]),
    "volume_bucket": ("rvol20", [1.2, 2.0, 5.0], ["normal", "active", "high", "surge"]),
    "risk_bucket": ("natr14", [0.03, 0.05, 0.08], ["low", "moderate", "elevated", "high"]),
}
NUMBERS = ["tier1_composite_score", "ret_1d", "ret_5d", "rvol20", "breakout_dist_20", "natr14"]
NEEDED = ["ticker", "tier1_composite_score", "ret_5d", "rvol20", "breakout_dist_20", "natr14"]


def one_decimal(x: Column) -> Column:
    """Round to one decimal place, halves to even."""
    return F.rint(x * F.lit(10.0)) / F.lit(10.0)


def final_score(quality: Column, stability: Column) -> Column:
    return one_decimal(quality * F.lit(QUALITY_SHARE) + stability * F.lit(STABILITY_SHARE))


def bucket(x: Column, bounds: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval that holds x; null stays null."""
    out = F.when(x <= bounds[0], labels[0])
    for bound, label in zip(bounds[1:], labels[1:]):
        out = out.when(x <= bound, label)
    return out.when(x > bounds[-1], labels[-1])


def variance_scores(candidates: DataFrame, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Quality, stability and final score of every usable candidate, with buckets."""
    missing = [c for c in ["ticker", "date", *NUMBERS] if c not in candidates.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    typed = candidates.select(
        *[to_number(F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in candidates.columns]
    )
    factors = typed.dropna(subset=NEEDED).select(
        "*",
        # ranked on the clipped ratio itself: its log has the same order
        F.greatest(F.col("rvol20"), F.lit(0.0)).alias("_volume"),
        (-F.col("natr14")).alias("_calm"),
        F.lit(0).alias("_all"),
    )
    ranked = percent_ranks(
        factors,
        ["_all"],
        {
            "momentum_pct": "ret_5d",
            "breakout_pct": "breakout_dist_20",
            "volume_pct": "_volume",
            "volatility_pct": "_calm",
            "composite_pct": "tier1_composite_score",
        },
        nulls="keep",
        slot_rows=slot_rows,
    )
    quality = sum((F.col(c) * F.lit(w) for c, w in QUALITY_WEIGHTS.items()), F.lit(0.0))
    spread = row_std([F.col(c) for c in ("momentum_pct", "breakout_pct", "volume_pct", "volatility_pct")])
    # equal spreads must tie: drop the last bits the summation order decides
    ranked = ranked.withColumn("quality_raw", quality).withColumn("factor_dispersion", F.rint(spread * 1e12) / 1e12)
    ranked = percent_ranks(
        ranked, ["_all"], {"_dispersion_pct": "factor_dispersion"}, nulls="keep", slot_rows=slot_rows
    )
    scored = (
        ranked.withColumn("stability_raw", F.lit(1.0) - F.col("_dispersion_pct"))
        .withColumn("quality_score", one_decimal(F.col("quality_raw") * 100.0))
        .withColumn("stability_score", one_decimal(F.col("stability_raw") * 100.0))
        .withColumn("final_score", final_score(F.col("quality_score"), F.col("stability_score")))
    )
    for name, (column, bounds, labels) in BUCKETS.items():
        scored = scored.withColumn(name, bucket(F.col(column), bounds, labels))
    return scored.drop("_volume", "_calm", "_all", "_dispersion_pct")


def shortlist(scores: DataFrame, n: int = 30) -> DataFrame:
    return scores.orderBy(F.col("final_score").desc(), F.col("tier1_composite_score").desc(), "ticker").limit(n)


def variance_buckets(scores: DataFrame) -> DataFrame:
    """Count, mean score and mean return per momentum and volume bucket present."""
    return (
        scores.groupBy("momentum_bucket", "volume_bucket")
        .agg(
            F.count("ticker").alias("count"),
            F.avg("final_score").alias("avg_final"),
            F.avg("ret_5d").alias("avg_ret5d"),
        )
        .orderBy(F.col("avg_final").desc(), F.col("count").desc())
    )


def variance_summary(scores: DataFrame) -> DataFrame:
    """One row: score distribution (exact median) and factor means."""
    scores = staged(scores)
    median = exact_quantiles(scores, ["final_score"], [0.5]).get((0, "final_score"), [None])[0]
    return scores.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("final_score").alias("score_min"),
        F.max("final_score").alias("score_max"),
        F.avg("final_score").alias("score_mean"),
        *[F.avg(c).alias(f"mean_{c}") for c in ("ret_1d", "ret_5d", "rvol20", "breakout_dist_20", "natr14")],
    ).select("*", F.lit(median).cast("double").alias("score_median"))
