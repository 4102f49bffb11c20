"""Upserts: key merge, range replacement, dimension merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.series import keep_last

STAMPS = ("created_at", "updated_at")


def upsert(
    existing: DataFrame, incoming: DataFrame, keys: list[str], now: Column, order: list[str] | None = None
) -> DataFrame:
    """Incoming rows win on the key; created_at of a known key is kept, updated_at becomes ``now``.

    Repeated keys inside ``incoming`` are reduced first (last in ``order``),
    so both sides of the join are unique on the key and no key is hot.
    Columns ``incoming`` lacks keep their stored value.
    """
    if order:
        incoming = keep_last(incoming, keys, order)
    columns = [c for c in existing.columns if c not in keys and c not in STAMPS]
    new = incoming.withColumn("_new", F.lit(True)).alias("n")
    old = existing.withColumn("_old", F.lit(True)).alias("o")
    joined = old.join(new, keys, "full")
    is_new = F.col("_new").isNotNull()
    picked = []
    for c in columns:
        stored = F.col(f"o.{c}")
        picked.append((F.when(is_new, F.col(f"n.{c}")).otherwise(stored) if c in incoming.columns else stored).alias(c))
    stamps = []
    if "created_at" in existing.columns:
        stamps.append(F.when(F.col("_old").isNull(), now).otherwise(F.col("o.created_at")).alias("created_at"))
    if "updated_at" in existing.columns:
        stamps.append(F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"))
    return joined.select(*keys, *picked, *stamps).select(*existing.columns)


def upsert_master(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Dimension merge on symbol."""
    return upsert(existing, incoming, ["symbol"], now)


def range_replace(existing: DataFrame, incoming: DataFrame, key: str = "symbol", day: str = "trade_date") -> DataFrame:
    """Per key, drop stored rows between the first and last incoming day, then add the incoming rows.

    The ranges are one row per incoming key; the join is an equi-join on the
    key with the day bounds as a residual condition.
    """
    ranges = incoming.groupBy(F.col(key).alias("_key")).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    inside = (F.col(key) == F.col("_key")) & F.col(day).between(F.col("_lo"), F.col("_hi"))
    return existing.join(ranges, inside, "left_anti").unionByName(incoming.select(*existing.columns))
