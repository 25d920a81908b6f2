"""Queries that run as streams to the end of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import blocks
from .bytes import BYTES, H, R
from .registry import query
from .series import EVENTS, WRAP16


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.read_stream(spark, f"{sf_dir}/documents.parquet", "doc_id long, text string")


@query(f"""WITH {BYTES}, c AS (SELECT doc_id, pos // 4096 AS block, b, count(*) AS c FROM bytes GROUP BY ALL)
SELECT doc_id, block::BIGINT AS block, sum(c)::INT AS n_bytes, round({H}, {R}) AS entropy FROM c GROUP BY doc_id, block""")
def stream_block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.drained(blocks.block_profiles(documents(spark, sf_dir), "doc_id", "text", 4096)).withColumn("entropy", F.round("entropy", R))


@query("""WITH s AS (SELECT octet_length(encode(coalesce(text, ''))) AS n FROM documents), w AS (SELECT n, unnest(range((n + 4095) // 4096)) AS window_no FROM s)
SELECT window_no::BIGINT AS window_no, count(*) AS windows, sum(least(4096, n - window_no * 4096))::BIGINT AS bytes FROM w GROUP BY window_no""")
def stream_count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = documents(spark, sf_dir).select(F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return blocks.drained(blocks.count_windows(sizes, "n", 4096)).groupBy("window_no").agg(F.count("*").alias("windows"), F.sum("bytes").alias("bytes"))


@query(f"WITH {EVENTS} SELECT pos, {WRAP16.format('v - coalesce(lag(v) OVER (PARTITION BY q ORDER BY pos), 0)')}::BIGINT AS correction FROM s")
def stream_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = blocks.read_stream(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long, value double")
    rows = stream.select(F.col("event_id").alias("pos"), F.col("user_id").alias("q"), F.round(F.col("value") * 100).cast("long").alias("v"))
    return blocks.drained(blocks.feedback(rows, "q", "pos", "v"))
