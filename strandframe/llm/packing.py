"""Best-fit packing: documents into as few sequences as possible of a fixed number of tokens.

Bulk-synchronous best-fit, longest pieces first. Pieces are range-sorted by length: a piece's rank within its length
comes from counts by (length, bucket) and a window within each, so that a length with a third of all rows is spread over
all buckets. Gaps are runs of sequences with the same space left. A superstep takes the pieces of one length, sweeps the
gaps upwards from the smallest that is large enough (the successor), lets ranks settle which piece goes to which gap,
updates the gaps, and goes on. Both sorted orders are run-length coded, and a length or a gap is at most the capacity:
the sweep handles runs, of which the capacity bounds the number, and never rows; rows are matched to runs by rank, in
parallel. The packing equals that of best-fit decreasing, piece by piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .util import slices, tasks, written

#: Text tokenised at once: what that takes beside the vocabulary is some 40 times as much, and larger slices are no faster.
TEXT_BYTES = 2 << 20
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``, uint32 little-endian, if asked for) of every piece.

    A document is its text's ids and the end id (null: the end id alone). Longer ones are cut so that all pieces but the
    first are full.
    """

    def cut(batches):
        bpe = ByteBpe(tokenizer)
        for b in slices(batches, "text", TEXT_BYTES):
            flat, at = bpe.encode(b.column("text"), end)
            flat = flat.astype("<u4")
            n = np.diff(at)
            many = -(-n // capacity)
            row = np.repeat(np.arange(len(b)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            first = n - (many - 1) * capacity
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[row], capacity)
            begin = at[row] + start
            raw = memoryview(flat).cast("B")
            parts = [raw[4 * i : 4 * (i + k)] for i, k in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = {"doc_id": b.column("doc_id").take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length.astype(np.int32)), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([bytes(p) for p in parts], pa.binary())} if ids else {}))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES + ", ids binary" * ids)


def sweeps(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of the packing of ``counts`` (pieces by length): (length, rank from, rank to, first sequence, pieces of this
    run in each of its sequences, offset of the first of them).

    gaps: sorted (space left, first sequence) of runs of sequences; ``many`` has how many each run holds.
    """
    gaps: list[tuple[int, int]] = []
    many: dict[tuple[int, int], int] = {}
    out = []
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            insort(gaps, (space, first))
            many[space, first] = n

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect_left(gaps, (length, -1))
            if k < len(gaps):
                space, first = gaps.pop(k)
                n = many.pop((space, first))
            else:
                space, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = space // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, rank + full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # the last sequence that this run needs takes what is left
                out.append((length, rank, rank + left, first + full, left, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, n - full)
    return out


def packed(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32, of 1 to ``capacity`` tokens) with sequence_id and offset.

    Empty input: no rows. Pieces that are equal in all columns get places of their own.
    """
    spark = parts.sparkSession
    buckets = tasks(spark)
    keyed = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    table, _ = written(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: at most the capacity
    before = table.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = spark.createDataFrame(sweeps(counts, capacity), "length int, lo long, hi long, first long, each long, space long")  # a few runs for each length
    mine = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("rank", F.row_number().over(mine) - 1).join(before.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.join(F.broadcast(runs), "length").where("rank >= lo and rank < hi")
    slot = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("first") + F.floor(slot / F.col("each"))).alias("sequence_id"), (F.col("space") + slot % F.col("each") * F.col("length")).alias("offset"))


def best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text; more columns are ignored, whatever their names) once, keeping lengths and checksums,
    and pack the pieces.

    Null and empty texts are the end id alone; long ones are cut into pieces. Pieces of equal length are placed in the order
    of doc_id (null first), piece and checksum within a bucket; repeated rows have places of their own. Empty table: no rows.
    """
    table, _ = written(pieces(docs, tokenizer, capacity), "pieces")
    return packed(table, capacity)
