"""What happens to one byte sequence, in numpy: profiles, reversible transforms, parsers and coders.

Each function takes and returns bytes or arrays of one sequence; operators/blobs.py applies them to columns. State that
runs along a sequence (context tables, recency lists, match pointers) can't be stated as a relational operator without a
shuffle of a row for each byte, which is why these run as Arrow functions over whole sequences.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import zlib
from functools import lru_cache
from math import factorial

import numpy as np

#: Lags of the profile, parameters of the stride transforms (id: width, little-endian, delta), record widths.
LAGS = (1, 2, 4, 8, 16, 32, 64)
STRIDES = {4: (1, True, False), 6: (4, True, True), 7: (8, True, True), 9: (4, False, True), 17: (4, True, False), 18: (8, True, False)}
CHUNKS = (128, 256, 512, 1024)
WIDTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024, 1536, 2048)


def octets(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8)


def entropy(x: np.ndarray) -> float:
    """Shannon entropy of byte values in bits; nothing: 0."""
    if not len(x):
        return 0.0
    c = np.bincount(x, minlength=1)
    c = c[c > 0].astype(float)
    return float(np.log2(len(x)) - (c * np.log2(c)).sum() / len(x))


def regions(n: int, cap: int) -> list[tuple[int, int]]:
    """Up to four sample regions of cap / 4 bytes: at the start, the thirds and the end; equal starts once, overlaps kept."""
    width = max(1, cap // 4)
    starts = sorted({0, n // 3, 2 * n // 3, max(0, n - width)})
    return [(s, min(n, s + width)) for s in starts]


def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """Big-endian numbers of all n-grams."""
    if len(x) < n:
        return np.zeros(0, np.int64)
    out = np.zeros(len(x) - n + 1, np.int64)
    for k in range(n):
        out = out << 8 | x[k : len(x) - n + 1 + k]
    return out


def profile(data: bytes, cap: int = 2048) -> dict:
    """Features of a bounded, spread sample: entropy, symbols, runs, repeats, lag entropies, prediction, regional range."""
    x = octets(data)
    parts = [x[a:b] for a, b in regions(len(x), cap)]
    sample = np.concatenate(parts)
    keys = np.concatenate([_grams(p, 4) for p in parts])
    lagged = [np.concatenate([p[lag:] ^ p[:-lag] if len(p) > lag else p[:0] for p in parts]) for lag in LAGS]
    contexts, follow = np.concatenate([_grams(p[:-1], 2) for p in parts]), np.concatenate([p[2:] for p in parts])
    order = np.argsort(contexts, kind="stable")  # the last symbol after the same two bytes, across regions
    same = contexts[order][1:] == contexts[order][:-1]
    hits = int((follow[order][1:][same] == follow[order][:-1][same]).sum())
    chances = int(same.sum())
    by_region = [entropy(p) for p in parts]
    equal = sum(int((p[1:] == p[:-1]).sum()) for p in parts)
    return {
        "sample_bytes": len(sample),
        "entropy": entropy(sample),
        "symbols": len(np.unique(sample)),
        "run_fraction": equal / max(len(sample) - len(parts), 1),
        "repeat_fraction": (len(keys) - len(np.unique(keys))) / max(len(keys), 1),
        "lag_entropy": [entropy(v) for v in lagged],
        "predictability": hits / max(chances, 1),
        "prediction_opportunities": chances,
        "regional_entropy_range": max(by_region) - min(by_region),
    }


def xor_lag(x: np.ndarray, lag: int) -> np.ndarray:
    out = x.copy()
    out[lag:] ^= x[:-lag] if lag else x
    return out


def unxor_lag(x: np.ndarray, lag: int) -> np.ndarray:
    out = x.copy()
    for lane in range(min(lag, len(x))):
        out[lane::lag] = np.bitwise_xor.accumulate(x[lane::lag])
    return out


def sub_lag(x: np.ndarray, lag: int) -> np.ndarray:
    out = x.copy()
    out[lag:] -= x[:-lag]
    return out


def unsub_lag(x: np.ndarray, lag: int) -> np.ndarray:
    out = x.copy()
    for lane in range(min(lag, len(x))):
        out[lane::lag] = np.add.accumulate(x[lane::lag], dtype=np.uint8)
    return out


def shuffle(x: np.ndarray, width: int) -> np.ndarray:
    """Byte planes of whole records one after another; the tail stays at the end."""
    whole = len(x) // width * width
    return np.concatenate([x[:whole].reshape(-1, width).T.reshape(-1), x[whole:]])


def unshuffle(x: np.ndarray, width: int) -> np.ndarray:
    whole = len(x) // width * width
    return np.concatenate([x[:whole].reshape(width, -1).T.reshape(-1), x[whole:]])


def words(x: np.ndarray, width: int, little: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned words of ``width`` bytes (1, 2, 4, 8) and the tail."""
    whole = len(x) // width * width
    return np.ascontiguousarray(x[:whole]).view(f"{'<' if little else '>'}u{width}").astype(f"u{width}"), x[whole:]


def unwords(v: np.ndarray, tail: np.ndarray, width: int, little: bool = True) -> np.ndarray:
    return np.concatenate([v.astype(f"{'<' if little else '>'}u{width}").view(np.uint8), tail])


def word_step(v: np.ndarray, kind: str) -> np.ndarray:
    """Differences of words modulo their width: xor, delta, delta2 or zigzag (of delta2)."""
    if kind == "xor":
        return np.concatenate([v[:1], v[1:] ^ v[:-1]])
    out = np.concatenate([v[:1], v[1:] - v[:-1]])
    if kind == "delta" or len(v) < 3:
        return out
    second = out[2:] - out[1:-1]
    if kind == "zigzag":
        bits = v.dtype.itemsize * 8
        second = (second << v.dtype.type(1)) ^ (np.zeros_like(second) - (second >> v.dtype.type(bits - 1)))
    return np.concatenate([out[:2], second])


def unword_step(v: np.ndarray, kind: str) -> np.ndarray:
    if kind == "xor":
        return np.bitwise_xor.accumulate(v)
    if kind == "delta" or len(v) < 3:
        return np.add.accumulate(v, dtype=v.dtype)
    second = v[2:]
    if kind == "zigzag":
        one = v.dtype.type(1)
        second = (second >> one) ^ (np.zeros_like(second) - (second & one))
    return np.add.accumulate(np.concatenate([v[:1], np.add.accumulate(np.concatenate([v[1:2], second]), dtype=v.dtype)]), dtype=v.dtype)


def stride(x: np.ndarray, which: int) -> np.ndarray:
    """A word difference (delta or xor), then byte planes; width 1: differences of bytes."""
    width, little, delta = STRIDES[which]
    if width == 1:
        return sub_lag(x, 1)
    v, tail = words(x, width, little)
    return shuffle(unwords(word_step(v, "delta" if delta else "xor"), tail, width, little), width)


def unstride(x: np.ndarray, which: int) -> np.ndarray:
    width, little, delta = STRIDES[which]
    if width == 1:
        return unsub_lag(x, 1)
    v, tail = words(unshuffle(x, width), width, little)
    return unwords(unword_step(v, "delta" if delta else "xor"), tail, width, little)


def best_stride(x: np.ndarray, sample: int = 4096) -> tuple[int, float]:
    """The stride of least entropy on a sample; the first of equals."""
    scored = [(round(entropy(stride(x[:sample], k)), 9), k) for k in STRIDES]
    least = min(s for s, _ in scored)
    return next((k, s) for s, k in scored if s == least)


@lru_cache(maxsize=32)
def _log2_factorials(bits: int) -> np.ndarray:
    """log2 of k! for all k below 2^bits."""
    return np.concatenate([[0.0], np.cumsum(np.log2(np.arange(1, 1 << bits)))])


def estimates(counts: np.ndarray) -> np.ndarray:
    """Type-class sizes in bytes of rows of 256 counts: a byte, the symbol set, the composition and the arrangement; empty: 1."""
    n, m = counts.sum(axis=1), (counts > 0).sum(axis=1)
    lf = _log2_factorials(max(int(n.max(initial=0)), 256).bit_length())
    bits = 8 + lf[256] - lf[m] - lf[256 - m] + lf[n] - lf[counts].sum(axis=1)
    several = m > 1
    bits[several] += (lf[np.maximum(n - 1, 0)] - lf[np.maximum(m - 1, 0)] - lf[np.maximum(n - m, 0)])[several]
    return np.where(n > 0, bits / 8, 1.0)


def estimate(x: np.ndarray) -> float:
    return float(estimates(np.bincount(x, minlength=256)[None])[0])


def local_estimate(x: np.ndarray, chunks: tuple[int, ...]) -> float:
    """The least of the whole sequence's estimate and, for chunk sizes that it holds twice, two bytes and its chunks'."""
    best = estimate(x)
    for size in chunks:
        if len(x) >= 2 * size:
            rows = -(-len(x) // size)
            key = np.repeat(np.arange(rows), size)[: len(x)] * 256 + x
            best = min(best, 2.0 + float(estimates(np.bincount(key, minlength=rows * 256).reshape(rows, 256)).sum()))
    return best


def width_candidates(x: np.ndarray, most: int = 2048) -> list[int]:
    """Record widths to try: the usual ones, the voted ones and their divisors, up to a sixteenth of the sequence."""
    limit = min(most, len(x) // 16)
    if limit < 2:
        return []
    voted = {w for w, _ in record_widths(x, most)}
    parts = {d for w in voted for d in range(2, w + 1) if w % d == 0}
    return sorted(w for w in {*WIDTHS, *voted, *parts} if w <= limit)


#: Residual bytes that are counted at once.
RESIDUALS = 1 << 17


@lru_cache(maxsize=4096)
def _headers(size: int) -> np.ndarray:
    """By the number of symbols: the bits of an estimate of ``size`` (at most 2048) bytes but for the factorials of the counts."""
    lf = _log2_factorials(12)
    m = np.arange(257)
    bits = 8 + lf[256] - lf[m] - lf[256 - m] + lf[size]
    several = (m > 1) & (m <= size)
    bits[several] += lf[size - 1] - lf[m[several] - 1] - lf[size - m[several]]
    return bits


@lru_cache(maxsize=1)
def _pairs() -> np.ndarray:
    """log2 of k! l! for all pairs of bytes k and l, as one 16-bit number."""
    lf = _log2_factorials(8)
    return (lf[:, None] + lf).ravel()


def _header_bits(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row of numbers of symbols, the ``_headers`` of its chunks of these sizes (0: no chunk)."""
    return sum(_headers(size).take(symbols[:, sizes == size]).sum(axis=1) for size in {*sizes.tolist()} - {0})


def _symbols(held: np.ndarray) -> np.ndarray:
    """How many of the 256 flags of the last axis are set: lanes of 32 flags fit a byte, eight at a time."""
    lanes, even = held.view(np.uint64).sum(axis=-1), np.uint64(0x00FF00FF00FF00FF)
    lanes = (lanes & even) + (lanes >> np.uint64(8) & even)
    return (lanes * np.uint64(0x0001000100010001) >> np.uint64(48)).astype(np.intp)


def _chunk_estimates(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each residual (counts: residual, chunk, byte value; 16 bits), the sum of ``estimates`` of its chunks of these
    sizes (0: no chunk)."""
    rows, many = len(counts), counts.max() > 255
    low = (np.minimum(counts, 255) if many else counts).astype(np.uint8).reshape(rows, -1).view(np.uint16)
    bits = -_pairs().take(low.astype(np.intp), mode="clip").sum(axis=1)
    if many:
        lf, flat = _log2_factorials(12), counts.ravel()
        at = np.flatnonzero(flat > 255)
        bits -= np.bincount(at // (len(flat) // rows), lf[flat[at]] - lf[255], minlength=rows)
    return (bits + _header_bits(_symbols(counts != 0), sizes)) / 8


def local_estimates(residuals: np.ndarray, chunks: tuple[int, ...]) -> np.ndarray:
    """``local_estimate`` of each row of ``residuals``, for chunk sizes that double up to 2048: bytes are counted once, in
    the smallest chunks, and the counts of larger ones are sums of these."""
    rows, n = residuals.shape
    chunks = tuple(c for c in chunks if n >= 2 * c)
    if not chunks:
        return estimates(np.bincount((residuals + 256 * np.arange(rows)[:, None]).ravel(), minlength=rows * 256).reshape(rows, 256))
    parts = -(-n // chunks[-1]) * (chunks[-1] // chunks[0])
    key = residuals + 256 * (np.arange(n) // chunks[0])
    key += 256 * parts * np.arange(rows)[:, None]
    counts = np.bincount(key.ravel(), minlength=rows * parts * 256).astype(np.uint16).reshape(rows, parts, 256)
    best = None
    for k, size in enumerate(chunks):
        if k:
            counts = counts[:, ::2] + counts[:, 1::2]
        found = 2.0 + _chunk_estimates(counts, np.clip(n - size * np.arange(counts.shape[1]), 0, size))
        best = found if best is None else np.minimum(best, found)
    return np.minimum(best, estimates(counts.sum(axis=1, dtype=np.int64)))


def periods(x: np.ndarray, most: int = 4) -> list[tuple[float, int, str]]:
    """(estimate, lag, operation) of the best residuals at the candidate lags; equal estimates: the smaller lag, xor first.
    The candidates are a guess (a few voted distances, up to a sixteenth of the sequence); ``best_periods`` tries all lags."""
    names, lags = (("xor", xor_lag), ("sub", sub_lag)), [lag for lag in width_candidates(x) if 2 * lag <= len(x)]
    todo = [(lag, place) for lag in lags for place in range(2)]
    step, tried = max(1, RESIDUALS // max(len(x), 1)), []
    for k in range(0, len(todo), step):
        some = todo[k : k + step]
        found = local_estimates(np.stack([names[place][1](x, lag) for lag, place in some]), (*CHUNKS, 2048))
        tried += [(round(e, 6), lag, place) for e, (lag, place) in zip(found.tolist(), some, strict=True)]
    return [(e, lag, names[place][0]) for e, lag, place in sorted(tried)[:most]]


@lru_cache(maxsize=1)
def _slopes() -> np.ndarray:
    """By a count m, log2 of m! over m - 1. As log2 of k! is convex, it is at most k - 1 times this for k from 1 to m."""
    lf = _log2_factorials(12)
    return np.concatenate([[0.0, 0.0], lf[2:] / np.arange(1, len(lf) - 1)])


class _Sieve:
    """Tells which residuals of ``n`` bytes, up to ``rows`` at once, can have a low local estimate.

    For each chunk size the factorials of the counts are bounded by chords, from how often each byte value occurs, in how
    many chunks and how often in one. Only residuals that this bound does not rule out have their counts looked up."""

    def __init__(self, n: int, rows: int, chunks: tuple[int, ...]):
        self.chunks, parts = chunks, -(-n // chunks[-1]) * (chunks[-1] // chunks[0])
        self.sizes = [np.clip(n - size * np.arange(parts * chunks[0] // size), 0, size) for size in chunks]
        self.base = 256 * (rows * (np.arange(n) // chunks[0]) + np.arange(rows)[:, None])
        self.key = np.empty_like(self.base)
        self.counts = np.empty((parts, rows, 256), np.uint8)  # no chunk of the first size holds more than 128

    def may_reach(self, residuals: np.ndarray, limit: float) -> np.ndarray:
        """Numbers of the rows of ``residuals`` whose ``local_estimates`` can be at most ``limit``; no other row's is."""
        rows = len(residuals)
        key = self.key[:rows]
        key[...] = residuals
        key += self.base[:rows]
        counts, levels = self.counts, []
        counts.fill(0)
        np.add.at(counts.reshape(-1), key.reshape(-1), np.uint8(1))
        for size in self.chunks:
            if levels:
                counts = np.add(counts[::2], counts[1::2], dtype=np.uint8 if 2 * int(top.max()) < 256 else np.uint16)
            top, held = counts.max(axis=0), counts != 0
            chunks = sum(np.add.reduce(held[k : k + 255].view(np.uint8), axis=0, dtype=np.uint8).astype(np.intp) for k in range(0, len(held), 255))
            levels.append((counts, top, chunks, _symbols(held)))
        total = counts.sum(axis=0, dtype=np.int64)
        may = estimates(total) <= limit
        for (counts, top, chunks, symbols), sizes in zip(levels, self.sizes, strict=True):
            chords = ((total - chunks) * _slopes().take(top)).sum(axis=1)
            at = np.flatnonzero(~may & (2.0 + (_header_bits(symbols.T, sizes) - chords) / 8 <= limit))
            if len(at):
                may[at] = 2.0 + _chunk_estimates(np.ascontiguousarray(counts[:, at].swapaxes(0, 1), np.uint16), sizes) <= limit
        return np.flatnonzero(may[:rows])


def best_periods(x: np.ndarray, most: int | None = 4, lags: range | None = None) -> list[tuple[float, int, str]]:
    """(estimate, lag, operation) of the best residuals at all lags up to half the sequence, or at ``lags``, consecutive
    ones (``most`` None: of every residual); equal estimates: the smaller lag, xor first.

    Long lags come first: they leave more of a text as it is, and so are often the best."""
    n, lags = len(x), range(1, len(x) // 2 + 1) if lags is None else lags
    if not lags:
        return []
    chunks = tuple(c for c in (*CHUNKS, 2048) if n >= 2 * c)
    step, found, limit = max(1, 2 * RESIDUALS // n), [], np.inf
    sieve = _Sieve(n, step, chunks) if most and chunks else None
    behind = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(lags[-1], np.uint8), x]), n)[::-1]
    stop = len(lags)
    while stop:
        some = lags[max(0, stop - (step if found else min(step, 8))) : stop]  # a few first, for a limit
        stop -= len(some)
        before = behind[some[0] : some[-1] + 1]  # nothing before the start: a zero, which leaves a byte as it is
        for place, residual in enumerate((np.bitwise_xor, np.subtract)):
            rows = residual(x, before)
            at = sieve.may_reach(rows, limit + 1e-5) if sieve and limit < np.inf else np.arange(len(rows))
            if len(at):
                tried = zip(local_estimates(rows[at], (*CHUNKS, 2048)).tolist(), at.tolist(), strict=True)
                found = sorted([*found, *((round(e, 6), some[i], place) for e, i in tried)])[:most]
                if most and len(found) == most:
                    limit = found[-1][0]
    return [(e, lag, ("xor", "sub")[place]) for e, lag, place in found]


def record_widths(x: np.ndarray, most: int = 2048, top: int = 16) -> list[tuple[int, int]]:
    """(distance, votes) between equal aligned 4-byte tokens of the first 64 KiB, most votes first (ties: seen first)."""
    limit = min(most, len(x) // 16)
    sample = x[:65_536]
    stops = range(0, max(len(sample) - 4, 0), 4)
    if limit < 2 or not len(stops):
        return []
    token = _grams(sample, 4)[::4][: len(stops)]
    order = np.argsort(token, kind="stable")
    same = token[order][1:] == token[order][:-1]
    at = order[1:][same]
    distance = (at - order[:-1][same]) * 4
    ok = (distance >= 2) & (distance <= limit)
    at, distance = at[ok], distance[ok]
    names, votes = np.unique(distance, return_counts=True)
    first = {}
    for d in distance[np.argsort(at)].tolist():
        first.setdefault(d, len(first))
    ranked = sorted(zip(names.tolist(), votes.tolist(), strict=True), key=lambda r: (-r[1], first[r[0]]))
    return ranked[:top]


def move_to_front(data: bytes) -> bytes:
    table = list(range(256))
    out = bytearray()
    for b in data:
        k = table.index(b)
        out.append(k)
        table.insert(0, table.pop(k))
    return bytes(out)


def unmove_to_front(data: bytes) -> bytes:
    table = list(range(256))
    out = bytearray()
    for k in data:
        b = table.pop(k)
        out.append(b)
        table.insert(0, b)
    return bytes(out)


def rotations_sorted(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Last column of the sorted rotations and the row of the text itself, by doubling ranks (equal rotations: by place)."""
    n = len(x)
    if n == 0:
        return 0, x
    rank, width = x.astype(np.int64), 1
    while True:
        key = rank * (n + 256) + np.roll(rank, -width)
        order = np.lexsort((np.arange(n), key))
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        width *= 2
        if width >= n or rank.max() == n - 1:
            break
    order = np.lexsort((np.arange(n), rank))
    return int(np.flatnonzero(order == 0)[0]), x[order - 1]


def unrotations(row: int, last: np.ndarray) -> np.ndarray:
    if not len(last):
        return last
    follow = np.argsort(last, kind="stable")
    out = np.empty(len(last), np.uint8)
    at = row
    for k in range(len(last)):
        at = follow[at]
        out[k] = last[at]
    return out


def zero_runs(data: bytes) -> list[tuple[int, int]]:
    """(value, length): zeros as runs, other bytes one by one."""
    x = octets(data)
    if not len(x):
        return []
    cut = np.flatnonzero(np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)]))
    return list(zip(x[cut].tolist(), np.diff(np.append(cut, len(x))).tolist(), strict=True))


def match_xor(data: bytes, inverse: bool = False) -> bytes:
    """Exclusive or with the byte that followed the last occurrence of the four bytes before; a match is followed as long
    as it predicts."""
    seen: dict[bytes, int] = {}
    out = bytearray()
    plain = out if inverse else data
    follow = -1
    for k in range(len(data)):
        if follow < 0 and k >= 4:
            follow = seen.get(bytes(plain[k - 4 : k]), -1)
        guess = plain[follow] if follow >= 0 else 0
        out.append(data[k] ^ guess)
        if k >= 4:
            seen[bytes(plain[k - 4 : k])] = k
        if follow >= 0:
            follow = follow + 1 if plain[k] == guess else -1
    return bytes(out)


def adaptive_residual(data: bytes, inverse: bool = False) -> bytes:
    """Exclusive or with the best of three predictions (the last byte, the one four back, the last after the same two bytes);
    the best has the most hits so far, halved every 256 bytes; ties: the first."""
    out = bytearray()
    plain = out if inverse else data
    scores, after = [0, 0, 0], {}
    for k in range(len(data)):
        context = bytes(plain[max(0, k - 2) : k])
        guesses = (plain[k - 1] if k else 0, plain[k - 4] if k >= 4 else 0, after.get(context, 0))
        guess = guesses[scores.index(max(scores))]
        out.append(data[k] ^ guess)
        now = plain[k]
        scores = [s + (g == now) for s, g in zip(scores, guesses, strict=True)]
        after[context] = now
        if k % 256 == 255:
            scores = [s // 2 for s in scores]
    return bytes(out)


def lz_parse(data: bytes, window: int = 65_536, newest: int = 8, least: int = 4, most: int = 65_535) -> list[tuple[bytes, int, int]]:
    """(literals, distance, length): greedy parse by 4-byte keys; of the newest candidates the one of the best score, eight
    bits a byte less the bits of its distance and length (equal scores: the longer, then the newer); the last entry has no
    match."""
    table: dict[bytes, list[int]] = {}
    out, literals, k, n = [], bytearray(), 0, len(data)

    def seen(at: int) -> None:
        if at + 4 <= n:
            places = table.setdefault(data[at : at + 4], [])
            places.append(at)
            del places[:-newest]

    while k < n:
        best = (0, 0, 0)
        for place in reversed(table.get(data[k : k + 4], ()) if k + 4 <= n else ()):
            if k - place > window:
                continue
            length = 4
            while length < most and k + length < n and data[place + length] == data[k + length]:
                length += 1
            score = 8 * length - (k - place).bit_length() - length.bit_length() - 3
            if score > best[0] or (score == best[0] and length > best[2]):
                best = (score, k - place, length)
        if best[2] >= least:
            out.append((bytes(literals), best[1], best[2]))
            literals.clear()
            for at in range(k, k + best[2]):
                seen(at)
            k += best[2]
        else:
            literals.append(data[k])
            seen(k)
            k += 1
    return [*out, (bytes(literals), 0, 0)]


def lz_restore(parts: list[tuple[bytes, int, int]]) -> bytes:
    out = bytearray()
    for literals, distance, length in parts:
        out += literals
        for _ in range(length):
            out.append(out[-distance])
    return bytes(out)


def phrases(x: np.ndarray, most: int = 32, least: int = 8) -> list[tuple[int, int, int]]:
    """(digram, times, first position) of the digrams that a phrase dictionary takes: most frequent first, ties by place."""
    g = _grams(x, 2)
    names, first, times = np.unique(g, return_index=True, return_counts=True)
    keep = times >= least
    rows = sorted(zip(names[keep].tolist(), times[keep].tolist(), first[keep].tolist(), strict=True), key=lambda r: (-r[1], r[2]))
    return rows[:most]


def previous_contexts(x: np.ndarray, size: int = 4) -> np.ndarray:
    """For each position from ``size`` on, the last position before it that follows the same ``size`` bytes (none: -1)."""
    if len(x) <= size:
        return np.zeros(0, np.int64)
    key = _grams(x, size)[:-1]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    out = np.full(len(key), -1, np.int64)
    out[order[1:][same]] = order[:-1][same] + size
    return out


def newest_matches(x: np.ndarray, newest: int = 8, window: int = 65_536) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the newest earlier positions, at most ``newest``, that start with the same four bytes; those
    farther than ``window`` fall out."""
    key = _grams(x, 4)
    order = np.argsort(key, kind="stable")
    at, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for back in range(1, newest + 1):
        same = key[order][back:] == key[order][:-back] if len(key) > back else np.zeros(0, bool)
        here, there = order[back:][same], order[: max(len(order) - back, 0)][same]
        near = here - there <= window
        at.append(here[near])
        far.append((here - there)[near])
    return np.concatenate(at), np.concatenate(far)


def grid_transposed(x: np.ndarray, width: int = 28) -> np.ndarray:
    """The first record, then the columns of the other whole records one after another, then the tail."""
    return np.concatenate([x[:width], shuffle(x[width:], width)])


def grid_restored(x: np.ndarray, width: int = 28) -> np.ndarray:
    return np.concatenate([x[:width], unshuffle(x[width:], width)])


def modal(counts: dict[int, int]) -> int:
    """The most frequent value (ties: the least magnitude, then the smaller); no values: 0."""
    return min(counts, key=lambda v: (-counts[v], abs(v), v)) if counts else 0


def predicted(keys: list[int], values: list[int], mode: int, bits: int = 32, inverse: bool = False, cap: int = 1024) -> list[int]:
    """Residuals of values, wrapped to signed numbers of ``bits``, to a guess from the rows before; or the values from them.

    Modes: 0 the last value at the key; 1 the modal value at the key; 2 the last value at the key, else the modal value of
    its context; 3 the modal value at the key, else that of its context; 4 the modal value of its context. A key's context is
    its sign, its bit length and its value modulo 16; a context's counts are halved, upwards, when they sum to ``cap``.
    """
    half, whole = 1 << bits - 1, 1 << bits
    last: dict[int, int] = {}
    own: dict[int, dict[int, int]] = {}
    contexts: dict[tuple, dict[int, int]] = {}
    out = []
    for q, v in zip(keys, values, strict=True):
        context = contexts.setdefault((q < 0, abs(q).bit_length(), q % 16), {})
        mine = own.setdefault(q, {})
        if mode == 0:
            guess = last.get(q, 0)
        elif mode == 2 and q in last:
            guess = last[q]
        elif mode == 1 or (mode == 3 and mine):
            guess = modal(mine)
        else:
            guess = modal(context)
        now = (v + guess + half) % whole - half if inverse else v
        out.append(now if inverse else (v - guess + half) % whole - half)
        last[q] = now
        mine[now] = mine.get(now, 0) + 1
        context[now] = context.get(now, 0) + 1
        if sum(context.values()) >= cap:
            for k in context:
                context[k] = -(-context[k] // 2)
    return out


def context_bits(x: np.ndarray, order: int = 1) -> float:
    """Cost in bits under adaptive counts (each symbol starts at one) in the context of ``order`` bytes before."""
    if not len(x):
        return 0.0
    padded = np.concatenate([np.zeros(order, np.uint8), x])
    context = _grams(padded, order)[: len(x)] if order else np.zeros(len(x), np.int64)
    seen_context, seen_pair = _before(context), _before(context << 8 | x)
    return float(np.log2((256 + seen_context) / (1 + seen_pair)).sum())


def _before(key: np.ndarray) -> np.ndarray:
    """How often each value occurred before its place."""
    order = np.argsort(key, kind="stable")
    start = np.concatenate([[True], np.diff(key[order]) != 0])
    place = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = place - np.maximum.accumulate(np.where(start, place, 0))
    return out


def huffman_bits(counts: np.ndarray) -> int:
    """Bits of a Huffman code of these counts (one symbol: one bit each)."""
    import heapq

    heap = [int(c) for c in counts if c]
    if len(heap) == 1:
        return heap[0]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def arrangement_rank(data: bytes) -> int:
    """Exact rank of a sequence among all arrangements of its own counts, symbols in ascending order."""
    left = np.bincount(octets(data), minlength=256).tolist()
    n = len(data)
    total = factorial(n)
    for c in left:
        total //= factorial(c)
    rank = 0
    for k, b in enumerate(data):
        m = n - k
        for s in range(b):
            if left[s]:
                rank += total * left[s] // m
        total = total * left[b] // m
        left[b] -= 1
    return rank


def arrangement(counts: list[int], rank: int) -> bytes:
    """Inverse of ``arrangement_rank``."""
    left, n = list(counts), sum(counts)
    total = factorial(n)
    for c in left:
        total //= factorial(c)
    out = bytearray()
    for m in range(n, 0, -1):
        for s in range(256):
            share = total * left[s] // m
            if left[s] and rank < share:
                out.append(s)
                total = share
                left[s] -= 1
                break
            rank -= share if left[s] else 0
    return bytes(out)


def varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def unvarint(data: bytes, at: int = 0) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = data[at]
        v |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return v, at


def _arrow_codec(name: str):
    import pyarrow as pa

    return (lambda d: varint(len(d)) + pa.compress(d, name, asbytes=True), lambda d: pa.decompress(d[unvarint(d)[1] :], unvarint(d)[0], name, asbytes=True))


def _zstd():
    import zstandard

    return (lambda d: zstandard.ZstdCompressor(level=3).compress(d), lambda d: zstandard.ZstdDecompressor().decompress(d, max_output_size=max(1, 1 << 31)) if d else b"")


def codecs() -> dict[str, tuple]:
    """Standard formats: (compress, decompress)."""
    raw = lambda d: (c := zlib.compressobj(6, zlib.DEFLATED, -15)).compress(d) + c.flush()
    return {
        "gzip": (lambda d: gzip.compress(d, 6, mtime=0), gzip.decompress),
        "zlib": (lambda d: zlib.compress(d, 6), zlib.decompress),
        "deflate": (raw, lambda d: zlib.decompress(d, -15)),
        "bzip2": (lambda d: bz2.compress(d, 9), bz2.decompress),
        "xz": (lambda d: lzma.compress(d, preset=3), lzma.decompress),
        "zstd": _zstd(),
        "brotli": _arrow_codec("brotli"),
        "lz4": _arrow_codec("lz4"),
        "snappy": _arrow_codec("snappy"),
    }
