"""Frame operators on streams.

Selection by time range, depth, calibration-free filters and detection are maps over single frames,
so they take a streaming DataFrame as they are. What needs other frames is here: statistics over
event-time windows with a watermark, and the first frame of each time bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..functions.arrays import measured


def stream_frames(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Frames from a folder to which Parquet files are added."""
    return spark.readStream.schema(T.StructType.fromDDL(schema.FRAMES)).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_contrast(frames: DataFrame, window: str, late: str) -> DataFrame:
    """n, mean and standard deviation of the pixels of each stack and event-time window; frames later than `late` are left out."""
    px = frames.withWatermark("ts", late).select("stack_id", "ts", F.explode("px").alias("v"))
    v = measured(F.col("v"))
    out = px.groupBy("stack_id", F.window("ts", window)).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"))
    return out.select("stack_id", F.col("window.start").alias("start"), "n", "mean", "std")


def first_of_bucket(frames: DataFrame, window: str, late: str) -> DataFrame:
    """stack_id, start and the number of the first frame (by time, then number) of each bucket; emitted when the watermark passes the bucket."""
    first = F.min(F.struct("ts", "frame")).alias("first")
    out = frames.withWatermark("ts", late).groupBy("stack_id", F.window("ts", window)).agg(first)
    return out.select("stack_id", F.col("window.start").alias("start"), F.col("first.frame").alias("frame"))
