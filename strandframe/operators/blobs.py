"""Operators on whole byte sequences: a column of texts or binaries in, columns of features, transforms or parses out.

Every sequence is handled where it lies: one Arrow pass over its partition, no shuffle, memory bounded by the largest
sequence. Texts count as their UTF-8 bytes; null counts as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores if it has fewer partitions than there are cores (a small table in one file); a larger
    one, or a stream, as it is: no shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def per_blob(df: DataFrame, keep: list[str], data: str, function: Callable[..., dict | list[dict]], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and what ``function`` returns for each sequence (and its ``more`` columns): a row, or a list of rows."""
    rows = spread(df.select(*keep, *more, F.coalesce(F.col(data).cast("binary"), F.lit(b"")).alias("_data")))
    names = [c.strip().split(" ")[0] for c in _columns(schema)]
    types = df.sparkSession.createDataFrame([], schema).schema
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(f.dataType) for f in types.fields]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [function(*d) for d in zip(*(b.column(k).to_pylist() for k in (b.num_columns - 1, *range(len(keep), b.num_columns - 1))), strict=True)]
            count = [len(f) if isinstance(f, list) else 1 for f in found]
            at = pa.array(np.repeat(np.arange(len(b)), count))
            flat = [r for f in found for r in (f if isinstance(f, list) else [f])]
            columns = [pa.array([r[n] for r in flat], t) for n, t in zip(names, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keep))), *columns], [*keep, *names])

    return rows.mapInArrow(apply, f"{kept}, {schema}" if keep else schema)


def _columns(schema: str) -> list[str]:
    depth, out = 0, [""]
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return out


def profile(df: DataFrame, keep: list[str], data: str, cap: int = 2048) -> DataFrame:
    """Features of each sequence's spread sample of ``cap`` bytes."""
    schema = "sample_bytes int, entropy double, symbols int, run_fraction double, repeat_fraction double, lag_entropy array<double>, predictability double, prediction_opportunities int, regional_entropy_range double"
    return per_blob(df, keep, data, lambda d: K.profile(d, cap), schema)


def region_entropies(df: DataFrame, keep: list[str], data: str, cap: int = 2048) -> DataFrame:
    """Entropy of each sample region."""

    def rows(d: bytes) -> list[dict]:
        x = K.octets(d)
        return [{"region": k, "start": a, "bytes": b - a, "entropy": K.entropy(x[a:b])} for k, (a, b) in enumerate(K.regions(len(x), cap))]

    return per_blob(df, keep, data, rows, "region int, start long, bytes long, entropy double")


def histogram(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Count and first position of each byte value of each whole sequence."""

    def rows(d: bytes) -> list[dict]:
        names, first, times = np.unique(K.octets(d), return_index=True, return_counts=True)
        return [{"byte": int(b), "times": int(t), "first": int(f)} for b, t, f in zip(names, times, first, strict=True)]

    return per_blob(df, keep, data, rows, "byte int, times long, first long")


def tiles(df: DataFrame, keep: list[str], data: str, size: int = 1024) -> DataFrame:
    """Bytes, symbols and most frequent byte (ties: the smallest) of each tile."""

    def rows(d: bytes) -> list[dict]:
        x, out = K.octets(d), []
        for k in range(0, len(x), size):
            c = np.bincount(x[k : k + size], minlength=256)
            out.append({"tile": k // size, "bytes": int(c.sum()), "symbols": int((c > 0).sum()), "mode": int(c.argmax()), "mode_times": int(c.max())})
        return out

    return per_blob(df, keep, data, rows, "tile int, bytes long, symbols int, mode int, mode_times long")


TRANSFORMS: dict[str, tuple[Callable, Callable]] = {
    **{f"xor{k}": (lambda x, k=k: K.xor_lag(x, k), lambda x, k=k: K.unxor_lag(x, k)) for k in (1, 2, 4, 8, 12, 16, 24, 32, 64)},
    **{f"sub{k}": (lambda x, k=k: K.sub_lag(x, k), lambda x, k=k: K.unsub_lag(x, k)) for k in (1, 2, 4, 8, 16)},
    **{f"shuffle{k}": (lambda x, k=k: K.shuffle(x, k), lambda x, k=k: K.unshuffle(x, k)) for k in (2, 4, 8)},
    "grid28": (K.grid_transposed, K.grid_restored),
    **{f"stride{k}": (lambda x, k=k: K.stride(x, k), lambda x, k=k: K.unstride(x, k)) for k in K.STRIDES},
    **{f"word_{kind}{w}{e}": (lambda x, w=w, e=e, kind=kind: _word(x, w, e, kind, K.word_step), lambda x, w=w, e=e, kind=kind: _word(x, w, e, kind, K.unword_step)) for w in (2, 4, 8) for e in ("le", "be") for kind in ("xor", "delta", "delta2", "zigzag")},
    "match_xor": (lambda x: K.octets(K.match_xor(x.tobytes())), lambda x: K.octets(K.match_xor(x.tobytes(), True))),
    "adaptive": (lambda x: K.octets(K.adaptive_residual(x.tobytes())), lambda x: K.octets(K.adaptive_residual(x.tobytes(), True))),
    "move_to_front": (lambda x: K.octets(K.move_to_front(x.tobytes())), lambda x: K.octets(K.unmove_to_front(x.tobytes()))),
}


def _word(x: np.ndarray, width: int, order: str, kind: str, step: Callable) -> np.ndarray:
    v, tail = K.words(x, width, order == "le")
    return K.unwords(step(v, kind), tail, width, order == "le")


def transformed(df: DataFrame, keep: list[str], data: str, name: str, inverse: bool = False) -> DataFrame:
    """``keep`` and the transform ``name`` (or its inverse) of each sequence, as ``data``."""
    function = TRANSFORMS[name][inverse]
    return per_blob(df, keep, data, lambda d: {"data": function(K.octets(d)).tobytes()}, "data binary")


def transform_check(df: DataFrame, keep: list[str], data: str, name: str) -> DataFrame:
    """Length, digest and entropy of each sequence's transform, and whether its inverse gives the sequence back."""
    apply, undo = TRANSFORMS[name]

    def row(d: bytes) -> dict:
        y = apply(K.octets(d))
        return {"n_bytes": len(y), "digest": hashlib.sha256(y.tobytes()).hexdigest(), "entropy": K.entropy(y), "restored": undo(y).tobytes() == d}

    return per_blob(df, keep, data, row, "n_bytes long, digest string, entropy double, restored boolean")


def entropies(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Bytes and entropy of each whole sequence that isn't empty."""
    return per_blob(df, keep, data, lambda d: [{"n_bytes": len(d), "entropy": K.entropy(K.octets(d))}] if d else [], "n_bytes long, entropy double")


def context_history(df: DataFrame, keep: list[str], data: str, size: int = 4) -> DataFrame:
    """How many positions follow bytes that were there before, and the distances to the last such positions in all."""

    def row(d: bytes) -> dict:
        last = K.previous_contexts(K.octets(d), size)
        hit = np.flatnonzero(last >= 0)
        return {"positions": len(last), "hits": len(hit), "distances": int((hit + size - last[hit]).sum())}

    return per_blob(df, keep, data, row, "positions long, hits long, distances long")


def match_history(df: DataFrame, keep: list[str], data: str, newest: int = 8, window: int = 65_536) -> DataFrame:
    """Of the newest earlier matches of each position: positions that have one, matches, the nearest's distances, all distances."""

    def row(d: bytes) -> dict:
        at, far = K.newest_matches(K.octets(d), newest, window)
        order = np.lexsort((far, at))
        first = np.concatenate([[True], np.diff(at[order]) != 0]) if len(at) else np.zeros(0, bool)
        return {"positions": int(first.sum()), "matches": len(at), "nearest": int(far[order][first].sum()), "distances": int(far.sum())}

    return per_blob(df, keep, data, row, "positions long, matches long, nearest long, distances long")


def lanes(df: DataFrame, keep: list[str], data: str, width: int) -> DataFrame:
    """For each lane of records of ``width`` bytes: bytes, distinct values, the bits of a palette index, entropy."""

    def rows(d: bytes) -> list[dict]:
        x = K.octets(d)
        return [{"lane": k, "n_bytes": len(x[k::width]), "symbols": (m := len(np.unique(x[k::width]))), "index_bits": (m - 1).bit_length(), "entropy": K.entropy(x[k::width])} for k in range(min(width, len(x)))]

    return per_blob(df, keep, data, rows, "lane int, n_bytes long, symbols int, index_bits int, entropy double")


def bit_planes(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """For each bit plane, the highest first: ones, and changes from one byte to the next."""

    def rows(d: bytes) -> list[dict]:
        bits = np.unpackbits(K.octets(d)).reshape(-1, 8)
        return [{"plane": 7 - k, "ones": int(bits[:, k].sum()), "changes": int((bits[1:, k] != bits[:-1, k]).sum())} for k in range(8)]

    return per_blob(df, keep, data, rows, "plane int, ones long, changes long")


def wavelet_levels(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """For each level of a wavelet tree over bytes: nodes that hold bytes, ones, and the bits of coding each node's ones apart."""

    def rows(d: bytes) -> list[dict]:
        x, out = K.octets(d).astype(np.int64), []
        for level in range(8):
            node, one = x >> (8 - level), x >> (7 - level) & 1
            n, ones = np.bincount(node), np.bincount(node, one)
            n, ones = n[n > 0].astype(float), ones[n > 0]
            p = np.clip(ones / np.maximum(n, 1), 1e-300, 1)
            q = np.clip(1 - ones / np.maximum(n, 1), 1e-300, 1)
            out.append({"level": level, "nodes": len(n), "ones": int(ones.sum()), "bits": float(-(ones * np.log2(p) + (n - ones) * np.log2(q)).sum())})
        return out

    return per_blob(df, keep, data, rows, "level int, nodes int, ones long, bits double")


def adaptive_costs(df: DataFrame, keep: list[str], data: str, orders: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Bits of each sequence under adaptive counts in the context of so many bytes before."""
    return per_blob(df, keep, data, lambda d: [{"order": k, "bits": K.context_bits(K.octets(d), k)} for k in orders], "order int, bits double")


def record_widths(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Record widths to try: the usual ones, those that votes name, and their divisors."""
    return per_blob(df, keep, data, lambda d: [{"width": w} for w in K.width_candidates(K.octets(d))], "width int")


def stride_choice(df: DataFrame, keep: list[str], data: str, sample: int = 4096) -> DataFrame:
    """The stride transform of least entropy on each sequence's sample (entropies equal to 9 digits: the first)."""

    def row(d: bytes) -> dict:
        which, score = K.best_stride(K.octets(d), sample)
        return {"stride": which, "entropy": score}

    return per_blob(df, keep, data, row, "stride int, entropy double")


def type_class(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Bytes, symbols and type-class estimate in bytes of each whole sequence."""

    def row(d: bytes) -> dict:
        x = K.octets(d)
        return {"n_bytes": len(d), "symbols": len(np.unique(x)), "estimate": K.estimate(x)}

    return per_blob(df, keep, data, row, "n_bytes long, symbols int, estimate double")


def period_profile(df: DataFrame, keep: list[str], data: str, most: int | None = 4, unit: int = 1 << 31) -> DataFrame:
    """The best periodic residuals of each sequence by local estimate, of all lags up to half of it; ``most`` None: all of them.

    A sequence of n bytes has n residuals of n bytes. Where these are more than ``unit``, its lags are dealt out, to at most
    four pieces a core, and the best of each piece are ranked again."""
    found = "rank int, lag int, operation string, estimate double"

    def rows(d: bytes, piece: int = 0, pieces: int = 1) -> list[dict]:
        lags = range(1, len(d) // 2 + 1)
        lags = lags[len(lags) * piece // pieces : len(lags) * (piece + 1) // pieces]
        return [{"rank": k, "lag": lag, "operation": op, "estimate": e} for k, (e, lag, op) in enumerate(K.best_periods(K.octets(d), most, lags))]

    size = F.coalesce(F.octet_length(data), F.lit(0)).cast("double")
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = F.least(F.ceil(size * size / unit), F.lit(4 * cores)).cast("int")
    whole = per_blob(df.where(pieces <= 1), keep, data, rows, found)
    long = df.where(pieces > 1).select(*keep, data, F.monotonically_increasing_id().alias("_id"), pieces.alias("_pieces"))
    dealt = long.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).repartition(4 * cores, "_id", "_piece")
    best = per_blob(dealt, [*keep, "_id"], data, rows, found, ("_piece", "_pieces"))
    order = Window.partitionBy("_id").orderBy("estimate", "lag", F.desc("operation"))
    ranked = best.withColumn("rank", F.row_number().over(order) - 1)
    return whole.unionByName((ranked.where(F.col("rank") < most) if most else ranked).drop("_id"))


def record_width_votes(df: DataFrame, keep: list[str], data: str, top: int = 16) -> DataFrame:
    return per_blob(df, keep, data, lambda d: [{"rank": k, "width": w, "votes": v} for k, (w, v) in enumerate(K.record_widths(K.octets(d), top=top))], "rank int, width int, votes int")


def phrase_palette(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """The phrase dictionary of each sequence: frequent digrams."""
    return per_blob(df, keep, data, lambda d: [{"rank": k, "digram": g, "times": t, "first": f} for k, (g, t, f) in enumerate(K.phrases(K.octets(d)))], "rank int, digram int, times int, first int")


def blocks(df: DataFrame, keep: list[str], data: str, size: int = 65_536) -> DataFrame:
    """Blocks of at most ``size`` bytes: number, bytes, content. An empty sequence has none."""
    return per_blob(df, keep, data, lambda d: [{"block": k // size, "n_bytes": len(d[k : k + size]), "data": d[k : k + size]} for k in range(0, len(d), size)], "block long, n_bytes int, data binary")


def coded(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Costs in bytes of each sequence under each substream coder, with the coder's place in the order of preference."""

    def rows(d: bytes) -> list[dict]:
        import zlib

        x = K.octets(d)
        c = np.bincount(x, minlength=256)
        runs = int((np.diff(x.astype(np.int16)) != 0).sum()) + 1 if len(x) else 0
        whole = lambda bits: int(-(-bits // 8))
        costs = [("raw", len(d)), ("runs", 2 * runs), ("composition", int(np.ceil(K.estimate(x))) if K.entropy(x[:8192]) < 7.5 else None), ("deflate", len(zlib.compress(d, 6))), ("range", whole(K.context_bits(x, 0))), ("context", whole(K.context_bits(x, 1))), ("huffman", whole(K.huffman_bits(c)) + 128)]
        return [{"place": k, "coder": name, "bytes": n} for k, (name, n) in enumerate(costs) if n is not None]

    return per_blob(df, keep, data, rows, "place int, coder string, bytes long")


def standard_roundtrip(df: DataFrame, keep: list[str], data: str) -> DataFrame:
    """Size of each sequence in each standard format, and whether it decodes to the sequence."""

    def rows(d: bytes) -> list[dict]:
        out = []
        for name, (compress, restore) in K.codecs().items():
            packed = compress(d)
            out.append({"format": name, "bytes": len(packed), "restored": restore(packed) == d})
        return out

    return per_blob(df, keep, data, rows, "format string, bytes long, restored boolean")


def sequence_check(df: DataFrame, keep: list[str], data: str, size: int = 4096) -> DataFrame:
    """Block-sorting and LZ parse of each block: measures, and whether both give the block back."""

    def rows(d: bytes) -> list[dict]:
        out = []
        for k in range(0, len(d), size):
            block = d[k : k + size]
            row, last = K.rotations_sorted(K.octets(block))
            front = K.move_to_front(last.tobytes())
            parts = K.lz_parse(block)
            back = K.unrotations(row, K.octets(K.unmove_to_front(front))).tobytes() == block
            out.append({"block": k // size, "row": row, "zero_runs": len(K.zero_runs(front)), "front_entropy": K.entropy(K.octets(front)), "matches": len(parts) - 1, "literals": sum(len(p[0]) for p in parts), "restored": back and K.lz_restore(parts) == block})
        return out

    return per_blob(df, keep, data, rows, "block int, row int, zero_runs int, front_entropy double, matches int, literals int, restored boolean")
