"""Pinned vectors and inverses of what happens to one byte sequence."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.functions import kernels as K
from strandframe.operators.blobs import TRANSFORMS

EDGES = [b"", b"a", b"\x00" * 300, bytes(range(256)) * 2, b"abcd" * 100, b"ab" * 33 + b"x", "é日👍".encode() * 20, bytes(70_000)]


def test_pinned_profile():
    p = K.profile(b"abcdabcdabcdabcd", 16)
    assert p["entropy"] == 2.0 and p["run_fraction"] == 0.0 and p["repeat_fraction"] == 0.25
    assert p["lag_entropy"] == pytest.approx([1.9591479170272448, 1.0, 0, 0, 0, 0, 0], abs=1e-12)
    assert p["predictability"] == 1.0 and p["prediction_opportunities"] == 4 and p["regional_entropy_range"] == 0.0


def test_empty_profile():
    p = K.profile(b"", 0)
    assert p["sample_bytes"] == p["symbols"] == p["prediction_opportunities"] == 0
    assert p["entropy"] == p["run_fraction"] == p["repeat_fraction"] == p["regional_entropy_range"] == 0.0 and p["lag_entropy"] == [0.0] * 7


@pytest.mark.parametrize("name", [n for n in TRANSFORMS])
def test_transform_inverse(name):
    apply, undo = TRANSFORMS[name]
    for data in EDGES if name not in ("match_xor", "adaptive", "move_to_front") else EDGES[:-1]:
        assert undo(apply(K.octets(data))).tobytes() == data


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_sequential_inverse(data):
    assert K.lz_restore(K.lz_parse(data)) == data
    row, last = K.rotations_sorted(K.octets(data))
    assert K.unrotations(row, last).tobytes() == data
    assert K.unmove_to_front(K.move_to_front(data)) == data
    assert sum(n for _, n in K.zero_runs(data)) == len(data)


def test_block_sort_matches_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        data = bytes(rng.randrange(3) for _ in range(rng.randrange(1, 30)))
        row, last = K.rotations_sorted(K.octets(data))
        rows = sorted((data[k:] + data[:k], k) for k in range(len(data)))
        assert last.tobytes() == bytes(r[-1] for r, _ in rows) and rows[row][1] == 0


def test_rank_of_arrangement():
    rng = random.Random(6)
    for _ in range(50):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 12)))
        counts = np.bincount(K.octets(data), minlength=256).tolist()
        assert K.arrangement(counts, K.arrangement_rank(data)) == data


def test_ties():
    assert K.best_stride(np.zeros(64, np.uint8))[0] == 4  # all entropies are 0: the first
    assert K.phrases(K.octets(b"abababababababababab"))[0][0] == 0x6162  # ab before ba by place and count


def test_standard_formats_come_back():
    for compress, restore in K.codecs().values():
        for data in EDGES:
            assert restore(compress(data)) == data


def test_huffman_bits():
    assert K.huffman_bits(np.array([5, 1, 1])) == 9 and K.huffman_bits(np.array([7])) == 7 and K.huffman_bits(np.zeros(3, int)) == 0


def test_predictor_and_match_vectors():
    # the guess for the second byte is the first one: an exclusive or, not a difference
    assert K.adaptive_residual(bytes([5, 6, 6])) == bytes([5, 3, 0])
    # a near match of four bytes and a far one of five have the same score: the longer is taken
    filler = np.random.default_rng(3).permutation(np.repeat(np.arange(128, 256, dtype=np.uint8), 20))[:2500].tobytes()
    parts = K.lz_parse(b"abcdE" + filler + b"abcdzqrs" + b"abcdE")
    assert parts[-2][1:] == (5 + 2500 + 8, 5) and K.lz_restore(parts) == b"abcdE" + filler + b"abcdzqrsabcdE"
    assert K.lz_parse(b"a" * 70_000)[0][2] == 65_535
    # move-to-front, block sorting and match prediction of short texts
    assert K.move_to_front(b"aab") == bytes([97, 0, 98]) and K.rotations_sorted(K.octets(b"banana")) [0] == 3
    assert K.rotations_sorted(K.octets(b"banana"))[1].tobytes() == b"nnbaaa"
    assert K.match_xor(b"abcdXabcdX")[9] == 0


def test_predictions_come_back():
    rng = np.random.default_rng(4)
    q, v = rng.integers(-3, 4, 3000).tolist(), (rng.integers(-2, 3, 3000) * 10**9).tolist()
    for mode in range(5):
        there = K.predicted(q, v, mode)
        assert K.predicted(q, there, mode, inverse=True) == v and all(-(2**31) <= x < 2**31 for x in there)
    assert K.modal({}) == 0 and K.modal({-2: 1, 2: 1, 3: 1}) == -2 and K.predicted([1, 1, 1], [7, 7, 9], 1) == [7, 0, 2]


def plain_periods(x: np.ndarray) -> list[tuple[float, int, str]]:
    """Each residual by itself, each chunk size counted anew."""
    tried = []
    for lag in K.width_candidates(x):
        for place, (name, residual) in enumerate((("xor", K.xor_lag), ("sub", K.sub_lag))):
            if 2 * lag <= len(x):
                tried.append((round(K.local_estimate(residual(x, lag), (*K.CHUNKS, 2048)), 6), lag, place, name))
    return [(e, lag, name) for e, lag, _, name in sorted(tried)[:4]]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 255, 256, 257, 511, 640, 2048, 4095, 4096, 4097, 9001, 70_000])
def test_periods_equal_plain_ones(n):
    rng = np.random.default_rng(n)
    record = np.resize(rng.integers(0, 256, 48), n).astype(np.uint8)
    record[::7] += rng.integers(0, 3, len(record[::7])).astype(np.uint8)
    for x in (rng.integers(0, 256, n).astype(np.uint8), np.zeros(n, np.uint8), record, rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), n)):
        assert K.periods(x) == plain_periods(x)


def test_periods_count_a_residual_once():
    """Work, not time: one count over the bytes of many residuals, where each chunk size of each had one of its own."""
    x = np.random.default_rng(1).integers(0, 64, 8192).astype(np.uint8)
    calls, count = [], np.bincount
    with pytest.MonkeyPatch.context() as m:
        m.setattr(K.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
        K.periods(x)
    assert len(calls) <= len(K.width_candidates(x))


def plain_best_periods(x: np.ndarray, lags: range, most: int | None) -> list[tuple[float, int, str]]:
    """Every lag, each residual by itself."""
    tried = [(round(K.local_estimate(residual(x, lag), (*K.CHUNKS, 2048)), 6), lag, place, name) for lag in lags for place, (name, residual) in enumerate((("xor", K.xor_lag), ("sub", K.sub_lag)))]
    return [(e, lag, name) for e, lag, _, name in sorted(tried)[:most]]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 31, 255, 256, 640, 2047, 4097])
def test_best_periods_try_every_lag(n):
    rng = np.random.default_rng(n)
    record = np.resize(rng.integers(0, 256, 607), n).astype(np.uint8)  # a period that is no candidate
    record[::7] += rng.integers(0, 3, len(record[::7])).astype(np.uint8)
    for x in (rng.integers(0, 256, n).astype(np.uint8), np.zeros(n, np.uint8), record, rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), n), np.repeat(rng.integers(0, 9, n // 90 + 1).astype(np.uint8), 90)[:n]):
        assert K.best_periods(x) == plain_best_periods(x, range(1, n // 2 + 1), 4)
        if n < 700:
            assert K.best_periods(x, None) == plain_best_periods(x, range(1, n // 2 + 1), None)


def test_best_periods_of_a_long_sequence():
    """More than 255 chunks, and a period beyond 2048."""
    rng = np.random.default_rng(5)
    for x in (np.resize(rng.integers(0, 256, 9013), 40_000).astype(np.uint8), rng.choice(np.frombuffer(b"etaoin shrdlu", np.uint8), 40_000), np.zeros(40_000, np.uint8)):
        assert K.best_periods(x, lags=range(8990, 9050)) == plain_best_periods(x, range(8990, 9050), 4)
    assert K.best_periods(np.resize(rng.integers(0, 256, 2503), 9000).astype(np.uint8))[0][1] == 2503
