"""Streams of sequences: block profiles, count windows, retained state by key, ordered delivery.

A stream runs to the end of what is there (availableNow) or for ever, by its trigger; results are those of the batch
operators on the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import blobs


def folder(spark: SparkSession) -> str:
    """A new folder under the cluster's checkpoint folder; a temporary one only where that is unset and the session is local."""
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandframe-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Parquet files of a path (a folder or one file, hence the pattern) as a stream, so many in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return the rows that its sink has committed."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    started = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows")
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def block_profiles(stream: DataFrame, key: str, data: str, size: int = 65_536) -> DataFrame:
    """Bytes, digest and entropy of each block of each sequence, as it arrives; a short last block closes with its row."""
    from ..functions import kernels as K

    cut = blobs.blocks(stream, [key], data, size)
    found = blobs.per_blob(cut, [key, "block", "n_bytes"], "data", lambda d: {"entropy": K.entropy(K.octets(d))}, "entropy double")
    return found


def feedback(stream: DataFrame, key: str, pos: str, value: str, bits: int = 16) -> DataFrame:
    """(pos, correction): value less the last value at the same key, wrapped; the last value is kept between micro-batches.

    Rows of one micro-batch are taken in the order of ``pos``; a later batch follows on what the earlier ones left.
    """
    half, whole = 1 << bits - 1, 1 << bits

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(pos)
        before = rows[value].shift(fill_value=last)
        state.update((int(rows[value].iloc[-1]),))
        yield pd.DataFrame({pos: rows[pos], "correction": (rows[value] - before + half) % whole - half})

    return stream.groupBy(key).applyInPandasWithState(step, f"{pos} long, correction long", "last long", "append", GroupStateTimeout.NoTimeout)


def count_windows(stream: DataFrame, size: str, window: int) -> DataFrame:
    """Windows and bytes by window number: windows of bytes, not of time."""
    rows = stream.where(F.col(size) > 0).select(F.col(size).alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / window))).alias("window_no"))
    return rows.select("window_no", F.least(F.lit(window), F.col("n") - F.col("window_no") * window).cast("long").alias("bytes"))


def ordered(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Blocks in the order of their stream and number, as a sink takes them."""
    return rows.orderBy(key, number)
