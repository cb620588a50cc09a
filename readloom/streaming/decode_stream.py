"""Decoding a stream of reads.

The decode chain holds no state, so the same functions serve streaming frames: reads append, counts are a
streaming aggregation (update or complete mode), and each micro-batch may be written by channel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from readloom.operators import decode, stats
from readloom.operators.decode import Decoder
from readloom.plans import engine
from readloom.plans.compile import Plan


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_batch: int = 64) -> DataFrame:
    """Reads that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def decode_stream(reads: DataFrame, plan: Plan) -> DataFrame:
    """The stream filtered and decoded by a plan."""
    return engine.decode_reads(reads, plan)


def class_counts(decoded: DataFrame, decoder: Decoder) -> DataFrame:
    """Running counts of a decoder's classes, for update or complete mode."""
    return stats.barcode_counts(decoded, [decoder])


def windowed_counts(decoded: DataFrame, decoder: Decoder, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of classes per window of event time. Reads later than the watermark are left out."""
    timed = decoded.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window), F.col(f"{decoder.column}.barcode_index").alias("barcode_index")).agg(F.count("*").alias("count"), F.count_if(~F.col("qcfail")).alias("pf_count"))


def write_channels(decoded: DataFrame, plan: Plan, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that puts each micro-batch's records into a folder per channel. A batch that runs again replaces what it wrote before."""

    def write(batch: DataFrame, number: int) -> None:
        records = engine.output_records(batch, plan)
        if plan.document.get("filter outgoing qc fail"):
            records = records.where(~F.col("qcfail"))
        records.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/batch={number}")

    return decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def decode_function(decoders: list[Decoder], source: dict) -> Callable[[DataFrame], DataFrame]:
    """The decode chain as a function for DataFrame.transform()."""
    return lambda reads: decode.decode_all(reads, decoders, source)
