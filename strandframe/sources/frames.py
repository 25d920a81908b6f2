"""Framed containers: blocks with lengths and digests, checked when they are read; windows in sequence; manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAME = "struct<route:int,source_len:int,payload_len:int,digest:binary,payload:binary>"


def framed(blocks: DataFrame, data: str, route: int = 0) -> DataFrame:
    """``blocks`` with a struct frame: route, source_len, payload_len, digest (SHA-256 of the content), payload."""
    size = F.octet_length(data).cast("int")
    frame = F.struct(F.lit(route).alias("route"), size.alias("source_len"), size.alias("payload_len"), F.unhex(F.sha2(F.col(data), 256)).alias("digest"), F.col(data).alias("payload"))
    return blocks.withColumn("frame", frame)


def intact(frame: str = "frame") -> Column:
    """Whether a stored frame's lengths and digest fit its payload."""
    f = F.col(frame)
    return (F.octet_length(f["payload"]) == f["payload_len"]) & (F.lower(F.hex(f["digest"])) == F.sha2(f["payload"], 256))


def write_container(frames: DataFrame, path: str, key: str, number: str) -> None:
    """A container: the frames as a table, and a summary row for each stream (frames, bytes) beside them. Nothing is
    overwritten, and a table appears only when it is complete (Spark's commit)."""
    frames.select(key, number, "frame").write.mode("errorifexists").parquet(f"{path}/frames")
    summary = frames.groupBy(key).agg(F.count("*").alias("frames"), F.sum("frame.source_len").cast("long").alias("bytes"), F.max(number).alias("last"))
    summary.write.mode("errorifexists").parquet(f"{path}/summary")


def read_container(spark: SparkSession, path: str, key: str, number: str) -> DataFrame:
    """The frames of a container with ``ok``: the digest fits, numbers follow one another from 0 and the stream is whole."""
    frames, summary = spark.read.parquet(f"{path}/frames"), spark.read.parquet(f"{path}/summary")
    w = Window.partitionBy(key).orderBy(number)
    follows = F.col(number) == F.row_number().over(w) - 1
    whole = frames.withColumn("_follows", follows).join(summary.withColumnRenamed("last", "_last"), key)
    complete = F.max(number).over(Window.partitionBy(key)) == F.col("_last")
    return whole.withColumn("ok", intact() & F.col("_follows") & complete).drop("_follows", "_last", "frames", "bytes")


def dispatched(data: Column) -> Column:
    """The container kind that the first bytes name."""
    magic = F.lower(F.hex(F.substring(data, 1, 6)))
    kinds = {"1f8b": "gzip", "28b52ffd": "zstd", "425a68": "bzip2", "fd377a585a00": "xz", "04224d18": "lz4", "7f454c46": "elf"}
    out = F.lit("stored")
    for start, name in kinds.items():
        out = F.when(F.startswith(magic, F.lit(start)), F.lit(name)).otherwise(out)
    return out


def default_output(path: Column, suffix: str, decode: bool = False) -> Column:
    """Name of what a file becomes: the suffix added, or taken off (without one: ``.out`` added)."""
    if not decode:
        return F.concat(path, F.lit(suffix))
    return F.when(F.endswith(path, F.lit(suffix)), F.substring(path, F.lit(1), F.length(path) - len(suffix))).otherwise(F.concat(path, F.lit(".out")))


def manifest(chunks: DataFrame, key: str, number: str, data: str) -> DataFrame:
    """For each chunk: its number, size and content address."""
    return chunks.select(key, number, F.octet_length(data).cast("long").alias("size"), F.sha2(F.col(data), 256).alias("address"))


def differences(wanted: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a manifest that the store lacks (missing) and rows of the store that the manifest lacks (extra)."""
    missing = wanted.join(stored, columns, "left_anti").select(*columns, F.lit("missing").alias("problem"))
    return missing.unionByName(stored.join(wanted, columns, "left_anti").select(*columns, F.lit("extra").alias("problem")))


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files as rows (path, length, content)."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "length", "content")


def restored(pieces: DataFrame, key: list[str], number: str, data: str) -> DataFrame:
    """Each blob from its pieces in the order of their numbers, and how many there were. A blob is one value of one row, so
    its pieces come together in one task."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.hex(data).alias("h")))), lambda p: p["h"])
    return pieces.groupBy(*key).agg(F.count("*").alias("pieces"), F.unhex(F.array_join(ordered, "")).alias("data"))


def bounded(df: DataFrame, data: str, cap: int) -> DataFrame:
    """``df`` with ``status`` (read, or too long: nothing is cut silently) and ``taken``, the bytes that were looked at."""
    size = F.octet_length(F.coalesce(F.col(data), F.lit("")))
    return df.withColumn("status", F.when(size <= cap, "read").otherwise("too long")).withColumn("taken", F.least(size, F.lit(cap + 1)))


def list_line(signature: Column, path: Column, restored_bytes: Column) -> Column:
    """One line about a decoded blob."""
    return F.format_string('signature="%s" path=%s restored_bytes=%d verified=true', signature, path, restored_bytes.cast("long"))
