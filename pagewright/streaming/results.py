"""Streams of recognition results and files: what stays latest, and counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.persist import shared_folder


def read_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def latest_results(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key, for output mode update or complete. Its state is one row a key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def progress(stream: DataFrame, time: str, width: str = "1 day", late: str = "7 days", failed: str = "error") -> DataFrame:
    """(start, n, n_failed) by window of event time; rows later than `late` are dropped by the watermark, null times too."""
    kind = stream.schema[time].dataType.simpleString()
    return (
        stream.where(F.col(time).isNotNull()).withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width))
        .agg(F.count("*").alias("n"), F.count_if(F.col(failed).isNotNull()).alias("n_failed"))
        .select(F.col("window.start").cast(kind).alias("start"), "n", "n_failed")
    )


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: rows that come again are dropped."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through the stream, as a table of files in the shared folder.

    In complete mode each batch replaces the table, in append mode it is added; the driver holds no rows.
    """
    spark = df.sparkSession
    folder = shared_folder(spark, "stream-")
    write = "overwrite" if mode == "complete" else "append"

    spark.createDataFrame([], df.schema).write.parquet(f"{folder}/table")  # for streams without a batch

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode(write).parquet(f"{folder}/table")

    query = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/table")
