"""Sampling on Structured Streaming frames.

The Arrow operators keep no state across rows, so they run on a stream as on a table;
counts per event-time window use a watermark.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.sketch import sketch
from strandloom.options import SketchOptions


def sketch_stream(stream: DataFrame, seq: str, options: SketchOptions, keep: list[str] | None = None, value: bool = False) -> DataFrame:
    """Samples of a streaming frame's sequences, in append mode."""
    return sketch(stream, seq, options, keep, value)


def windowed_counts(samples: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Samples per event-time window of `width`; rows later than `late` are dropped."""
    return samples.withWatermark(time, late).groupBy(F.window(time, width).alias("window")).agg(F.count(F.lit(1)).alias("n"))


def _shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; a temporary one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="strandloom-")
    return path.rstrip("/")


def run_to_end(stream: DataFrame) -> DataFrame:
    """All rows of a streaming frame's present input, as a table.

    Waits however long the stream takes and raises if it fails. Rows and checkpoint go to the
    shared folder; none pass through the driver.
    """
    spark = stream.sparkSession
    path = f"{_shared_dir(spark)}/strandloom-stream-{uuid.uuid4().hex}"
    sink = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
