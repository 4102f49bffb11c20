"""The incremental load as a file stream: arriving bar files merged into the lake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barloom.plans.ingest import merge_into_lake
from barloom.schema import BAR_SCHEMA

ARRIVING = T.StructType([f for f in BAR_SCHEMA.fields if f.name != "year"])


def bar_stream(spark: SparkSession, folder: str, fmt: str = "parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Bars from files as they arrive; the schema is fixed.

    ``_arrived`` (modification time, file, block) tells which file brought a row.
    """
    reader = spark.readStream.format(fmt).schema(ARRIVING).option("maxFilesPerTrigger", files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    parts = ("file_modification_time", "file_path", "file_block_start")
    return reader.load(folder).select("*", F.struct(*[F.col(f"_metadata.{x}") for x in parts]).alias("_arrived"))


def start_feed(bars: DataFrame, root: str, checkpoint: str, layout: str = "year") -> StreamingQuery:
    """Merge everything available into the lake, then stop.

    The merge is idempotent by (ticker, date): a batch replayed after a lost
    executor or driver writes the same rows again. Late bars simply update
    their key, so no watermark is needed. Of rows with one key the last of the
    newest file stays.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        numbered = batch.withColumn("_row", F.monotonically_increasing_id())
        merge_into_lake(batch.sparkSession, numbered, root, layout, ["_arrived", "_row"])

    return (
        bars.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
