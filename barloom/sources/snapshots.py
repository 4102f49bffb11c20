"""Snapshot files whose name carries a timestamp: find the newest, read it typed."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File families of the snapshots.
FEATURES = r"^tier1_features_latest_(\d{8}_\d{6})\.csv$"
CANDIDATES = r"^tier1_buy_candidates_(\d{8}_\d{6})\.csv$"
DAILY_PICKS = r"^daily_top5_recommendations_(\d{8})(?:_to_(\d{8}))?\.csv$"
BEST_MODEL_FILE = "best_logic.json"


def snapshot_key(name, family: str):
    """Sort key captured from a file name; empty when the name is not of the family.

    Daily picks sort by end then start date, the end defaulting to the start.
    """
    first = F.regexp_extract(name, family, 1)
    if family != DAILY_PICKS:
        return first
    end = F.coalesce(F.nullif(F.regexp_extract(name, family, 2), F.lit("")), first)
    return F.when(first == "", "").otherwise(F.concat_ws("_", end, first))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name) of the files in a folder; contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def latest_snapshot(spark: SparkSession, folder: str, family: str, explicit: str | None = None) -> str | None:
    """Path of the newest file of the family, or of an explicitly named one; None when there is none."""
    files = list_files(spark, folder)
    if explicit is not None:
        if not re.fullmatch(family.strip("^$"), explicit):
            return None
        found = files.where(F.col("name") == explicit).select("path").first()
        return found["path"] if found else None
    keyed = files.withColumn("key", snapshot_key(F.col("name"), family)).where(F.col("key") != "")
    newest = keyed.agg(F.max_by("path", "key").alias("path")).first()
    return newest["path"]


def read_snapshot(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A snapshot as text columns: quotes, doubled quotes, trimmed cells, a leading byte-order mark removed."""
    df = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def latest_nonempty_snapshot(spark: SparkSession, folder: str, family: str) -> DataFrame:
    """Rows of the newest file of the family that has any, under that file's own header.

    Names alone give the order; files are opened from the newest on until one has a row.
    """
    keyed = list_files(spark, folder).withColumn("key", snapshot_key(F.col("name"), family)).where(F.col("key") != "")
    paths = [r["path"] for r in keyed.orderBy(F.col("key").desc(), "path").collect()]
    if not paths:
        raise FileNotFoundError(f"no snapshot of {family} in {folder}")
    for path in paths:
        rows = read_snapshot(spark, path)
        if not rows.isEmpty():
            return rows
    raise ValueError(f"all snapshots of {family} in {folder} are empty")


def latest_model_path(spark: SparkSession, root: str) -> str | None:
    """Newest run folder (by name) that holds a best-model file."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", BEST_MODEL_FILE)
        .load(root)
        .select("path")
    )
    run = F.element_at(F.split("path", "/"), -2)
    return files.agg(F.max_by("path", run).alias("path")).first()["path"]
