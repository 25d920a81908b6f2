"""Token-id output: frequency-ranked ids in byte-aligned variable-length blocks with separate control bytes.

Format of a block (little-endian): uint32 number of documents, uint64 number of ids; for each document its number of ids
(uint64); the control bytes, two bits an id (bytes of its rank, less one), first id in the lowest bits; the ranks' bytes.
A block holds whole documents, in ascending doc_id order; blocks are rows (shard, before, payload, ...) of a table that
Spark's writer commits, so they can lie in any store that Spark writes, and a lost executor costs its own tasks only.
A path holds three tables: blocks; ranks (rank, id), which decodes them; and shards (shard, start), the manifest of where
each shard's ids begin. It is read by itself, in any session.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import ByteBpe
from .util import dropped, freed, scratch, slices, tasks, written

#: Text bytes that are tokenised at a time, and ids in a block (one longer document makes a longer block).
TEXT_BYTES, BLOCK_IDS = 12 << 20, 1 << 20
_HEAD = np.dtype([("docs", "<u4"), ("ids", "<u8")])
#: For a control byte: the lengths of its four ranks.
_LENGTHS = np.array([[1 + (c >> 2 * k & 3) for k in range(4)] for c in range(256)], np.uint8)


def encode_block(ranks: np.ndarray, sizes: np.ndarray) -> bytes:
    """One block of the documents whose ids' ranks follow one another in ``ranks``, sizes[i] of document i."""
    ranks = ranks.astype("<u4")
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-len(ranks) % 4 + len(ranks), np.uint8)
    codes[: len(ranks)] = length - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = np.arange(4) < length[:, None]
    head = np.array([(len(sizes), len(ranks))], _HEAD)
    return head.tobytes() + sizes.astype("<u8").tobytes() + control.tobytes() + ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def decode_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ranks and sizes of ``encode_block``: a table gives the lengths that a control byte stands for."""
    head = np.frombuffer(payload, _HEAD, 1)[0]
    docs, n = int(head["docs"]), int(head["ids"])
    at = _HEAD.itemsize
    sizes = np.frombuffer(payload, "<u8", docs, at).astype(np.int64)
    at += 8 * docs
    length = _LENGTHS[np.frombuffer(payload, np.uint8, -(-n // 4), at)].reshape(-1)[:n]
    at += -(-n // 4)
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(payload, np.uint8, int(length.sum(dtype=np.int64)), at)
    return out.view("<u4").reshape(-1), sizes


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``value`` (null: 0), by binary search."""
    steps = [1 << k for k in reversed(range(max(1, len(cuts).bit_length())))]
    padded = F.lit([*cuts, *[2**63 - 1] * (2 * steps[0] - 1 - len(cuts))])
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.element_at(padded, at + step) <= value, at + step).otherwise(at))
    return F.when(value.isNull(), 0).otherwise(found)


def tokenised(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """(shard, before, doc_id, ids, width): each text's ids (uint16 or uint32, little-endian; null: the end id only) and
    the shard's ids before them; whole shards of consecutive doc_ids in one task each, sorted by doc_id and, for equal doc_ids, by text.

    Shard bounds are quantiles of doc_id (read alone), a few for each shuffle partition; null ids come first.
    """
    n = tasks(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / (4 * n) for i in range(1, 4 * n)], 10_000)).first()[0] or []
    dealt = docs.select(_place(F.col("doc_id"), sorted(set(cuts))).alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "text")

    def encode(batches):
        bpe = ByteBpe(tokenizer)
        width = 2 if bpe.tokenizer.get_vocab_size() <= 0x10000 else 4
        shard, done = None, 0
        for b in slices(batches, "text", TEXT_BYTES):
            ids, at = bpe.encode(b.column("text"), end)
            shards, before = np.asarray(b.column("shard")), at[:-1].copy()
            new = np.flatnonzero(np.diff(shards, prepend=shards[0] if shard is None else shard))
            base = np.zeros(len(b), np.int64) - done
            for k in new.tolist():
                base[k:] = at[k]
            before -= base
            done, shard = int(at[-1] - base[-1]), int(shards[-1])
            binary = pa.Array.from_buffers(pa.large_binary(), len(b), [None, pa.py_buffer(at * width), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(before), b.column("doc_id"), binary.cast(pa.binary()), pa.array(np.full(len(b), width, np.int32))], ["shard", "before", "doc_id", "ids", "width"])

    return dealt.mapInArrow(encode, "shard int, before long, doc_id long, ids binary, width int")


def ranked_ids(tokens: DataFrame) -> np.ndarray:
    """The vocabulary's ids that occur, most frequent first (ties: the smaller id): at most as many rows as the vocabulary."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            for ids, width in zip(b.column("ids"), b.column("width").to_pylist(), strict=True):
                got = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"), minlength=len(total))
                got[: len(total)] += total
                total = got
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], ["id", "n"])

    counts = tokens.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id")
    return np.array([r.id for r in counts.select("id").collect()], np.int64)


#: The table of blocks. before: the shard's ids before the block.
BLOCKS = "shard int, before long, doc_ids array<long>, n_ids long, payload binary"


def encoded(tokens: DataFrame, order: np.ndarray) -> DataFrame:
    """Blocks of ``tokenised`` rows, each of one shard."""
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order))
    shared = tokens.sparkSession.sparkContext.broadcast(rank)  # 4 bytes an id of the vocabulary

    def block(shard, before, docs, parts):
        sizes = np.array([len(p) for p in parts], np.int64)
        ids = np.concatenate(parts)
        payload = encode_block(shared.value[ids], sizes)
        columns = {"shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    def encode(batches):
        shard, before, docs, parts, n = None, 0, [], [], 0
        for b in batches:
            for s, at, d, ids, width in zip(*(b.column(c).to_pylist() for c in ("shard", "before", "doc_id")), b.column("ids"), b.column("width").to_pylist(), strict=True):
                part = np.frombuffer(ids.as_buffer(), f"<u{width}")
                if docs and (s != shard or n + len(part) > BLOCK_IDS or before + n != at):
                    yield block(shard, before, docs, parts)
                    docs, parts, n = [], [], 0
                if not docs:
                    shard, before = s, at
                docs.append(d)
                parts.append(part.copy())
                n += len(part)
        if docs:
            yield block(shard, before, docs, parts)

    return tokens.mapInArrow(encode, BLOCKS)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Tokenise ``docs`` (doc_id, text; more columns are ignored, whatever their names) and write the tables of ``path``.

    Documents stand in ascending doc_id order, null ids first; rows that share a doc_id by text, repeated rows one after
    another. Null and empty texts are the end id alone; a text longer than a block is a block of its own. An empty table
    writes empty tables.
    """
    spark = docs.sparkSession
    tokens, ids_at = written(tokenised(docs, tokenizer, end), "ids")
    freed(spark)
    order = ranked_ids(tokens)
    encoded(tokens, order).write.option("compression", "zstd").parquet(f"{path}/blocks")
    dropped(spark, ids_at)
    spark.createDataFrame(list(enumerate(order.tolist())), "rank int, id long").coalesce(1).write.parquet(f"{path}/ranks")  # at most the vocabulary
    sums = sorted((r.shard, r.n) for r in spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # a few shards for each partition
    starts = list(zip((s for s, _ in sums), np.cumsum([0, *(n for _, n in sums)]).tolist(), strict=False))
    spark.createDataFrame(starts, "shard int, start long").coalesce(1).write.parquet(f"{path}/shards")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the blocks at ``path``: doc_id, start (ids of all documents before it), n_tokens, ids (uint32,
    little-endian)."""
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ranks = spark.read.schema("rank int, id long").parquet(f"{path}/ranks").orderBy("rank").toArrow()  # at most the vocabulary
    starts = {r.shard: r.start for r in spark.read.schema("shard int, start long").parquet(f"{path}/shards").collect()}
    shared = spark.sparkContext.broadcast((np.asarray(ranks.column("id")).astype("<u4"), starts))

    def rows(batches):
        ids_of, start_of = shared.value
        for b in batches:
            for shard, before, docs, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "before", "doc_ids")), b.column("payload"), strict=True):
                ranks, sizes = decode_block(payload.as_buffer())
                ends = np.cumsum(sizes)
                ids = pa.Array.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(np.concatenate([[0], ends]) * 4), pa.py_buffer(ids_of[ranks])])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(start_of[shard] + before + ends - sizes), pa.array(sizes), ids.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "before", "doc_ids", "payload").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs`` to the shared folder, read the files back: doc_id, start, n_tokens, ids_crc32, a row for each row of
    ``docs`` (odd rows: see ``write_ids``)."""
    spark = docs.sparkSession
    path = scratch(spark, "blocks")
    write_ids(docs, path, tokenizer)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
