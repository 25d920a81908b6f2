"""What the operators of this subpackage share: the shared folder, batches, folds, small-table joins."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast if its rows, counted first, are at most so many.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local
    mode (as in tests); on a cluster executors would write where nobody else reads, so it is an error there."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if there is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = tempfile.mkdtemp(prefix="strandframe-")
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a table in this application's part of the shared folder, which goes when the application ends."""
    at = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"
    folder, fs = _hadoop(spark, at)
    fs.deleteOnExit(folder)
    return f"{at}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as a Parquet table to the shared folder and read it again; returns the table and its path.

    This cuts the lineage: a lost executor costs the tasks that read its part, never the work behind the table.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Remove tables of ``written`` that nothing reads any more."""
    for path in paths:
        at, fs = _hadoop(spark, path)
        fs.delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` as a written table, for small steps: one job (Spark's own checkpoint computes twice) and known sizes."""
    return written(df, "step")[0]


def freed(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of plans that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in ``column`` of each stays under ``limit`` bytes; a longer single row stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
        end = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def beside(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` as one struct column ``row``, with ``columns`` beside it: no name of df's can clash with theirs."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(name) for name, c in columns.items()))


def again(names: list[str]) -> list[Column]:
    """The columns ``names`` of what ``beside`` made."""
    return [F.col("row")[c].alias(c) for c in names]


def joined_small(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join of ``df`` with a table that has one row for each key.

    The table is counted first: up to BROADCAST_ROWS rows it is broadcast, beyond that the join is ``joined_hot``.
    """
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(table), keys, how)
    return joined_hot(df, table, keys, how)


def joined_hot(df: DataFrame, table: DataFrame, keys: list[str], how: str = "left", salts: int = 64, total: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Shuffled join of ``df`` with a table that has one row for each key, where some keys may hold a third of df's rows.

    ``total``: df's rows, ``counts``: (keys, count) of its keys, if they are known. Keys with more than 1 / (4 x tasks) of the rows (so fewer than 4 x tasks keys, which may be broadcast) are dealt out by
    a salt, and the table's rows of these keys, no others, are repeated once for each salt.
    """
    taken = {*df.columns, *table.columns}
    hot_, salt = (next(f"{n}{k}" for k in range(len(taken) + 1) if f"{n}{k}" not in taken) for n in ("hot_", "salt_"))
    total = df.count() if total is None else total
    if total <= BROADCAST_ROWS:
        return df.join(table, keys, how)
    hot = checkpointed((df.groupBy(*keys).count() if counts is None else counts).where(F.col("count") > total / (4 * tasks(df.sparkSession))).select(*keys, F.lit(True).alias(hot_)))
    if not hot.limit(1).count():
        return df.join(table, keys, how)
    is_hot = F.col(hot_).isNotNull()
    left = df.join(F.broadcast(hot), keys, "left").withColumn(salt, F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0)).drop(hot_)
    right = table.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(hot_)
    return left.join(right, [*keys, salt], how).drop(salt)


def local_union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the classes of the linked positions a and b in ``label``, in place; a class is named by its smallest position."""
    while len(a):
        x, y = label[a], label[b]
        differs = x != y
        if not differs.any():
            return
        a, b, x, y = a[differs], b[differs], x[differs], y[differs]
        least = np.minimum(x, y)
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
