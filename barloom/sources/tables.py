"""Relational source and the parameter/model files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.binning import Model
from barloom.schema import MODEL_SCHEMA


def read_relational(
    spark: SparkSession,
    url: str,
    table: str,
    *,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[str, str] | None = None,
    partitions: int = 64,
) -> DataFrame:
    """A relational table over JDBC, read in parallel ranges of ``partition_column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def write_relational(df: DataFrame, url: str, table: str, batch: int = 20_000, **properties: str) -> None:
    """Append to a relational table; ``batch`` rows per round trip."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch)
    for key, value in properties.items():
        writer = writer.option(key, value)
    writer.mode("append").save()


def export_rows(source: DataFrame, also: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Source rows typed for the lake: upper-case trimmed ticker, adj_close default, year, no null keys or prices.

    Columns named in ``also`` pass through.
    """
    needed = ["ticker", "date", "open", "high", "low", "close"]
    return source.dropna(subset=needed).select(
        F.upper(F.trim("ticker")).alias("ticker"),
        F.col("date").cast("timestamp").alias("date"),
        *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"),
        F.coalesce(F.col("adj_close"), F.col("close")).cast("double").alias("adj_close"),
        F.year("date").alias("year"),
        *also,
    )


def parse_model(df: DataFrame) -> Model:
    """Model from a one-row frame of the model schema; a ``best`` wrapper is optional."""
    names = F.coalesce(F.col("best.feature_names"), F.col("feature_names")).alias("names")
    weights = F.coalesce(F.col("best.weights"), F.col("weights")).alias("weights")
    row = df.select(names, weights).first()
    if row is None or row["names"] is None or row["weights"] is None:
        raise ValueError("model needs the lists feature_names and weights")
    return Model(tuple(row["names"]), tuple(row["weights"]))


def load_model(spark: SparkSession, path: str) -> Model:
    return parse_model(spark.read.schema(MODEL_SCHEMA).option("multiLine", True).json(path))
