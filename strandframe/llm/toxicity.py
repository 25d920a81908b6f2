"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct words, word pairs and pairs with one word skipped, ASCII case folded and ASCII marks
taken as space, hashed to 2^40 numbers. The per-coordinate rates and the L1 term leave few weights, which are shipped as
two sorted arrays. Scoring a text is a lookup of its features: one pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import slices

TEXT_BYTES = 4 << 20
#: The model is fitted on at most so many labelled rows (those with the least hash of the id) of at most so many characters,
#: so that training is bounded; every row is scored.
SAMPLE, SAMPLE_CHARS = 16_384, 65_536
#: A feature takes part if so many positive rows of the sample hold it. This bounds what the driver holds; it also leaves out
#: rarer features, and those of negative rows only, which would have had (small or negative) weights.
LEAST = 4
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_MIX, _PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h ^ (h >> np.uint64(29))) >> np.uint64(24)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all words, pairs and skip pairs, with repeats; null and empty texts have none."""
    import xxhash

    lines = pa.array([(t or "").encode("utf-8", "replace").translate(_FOLD) for t in texts], pa.large_binary()).cast(pa.large_string())
    parts = pc.ascii_split_whitespace(lines)
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(parts.offsets)))
    flat = parts.flatten()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    coded = flat.filter(pa.array(full)).dictionary_encode()
    row = row[full]
    names = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    h = names[np.asarray(coded.indices)] if len(names) else np.zeros(0, np.uint64)
    rows, found = [row], [_mixed(h)]
    for step, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[step:] == row[:-step]
        rows.append(row[step:][same])
        found.append(_mixed(h[:-step][same] * salt + h[step:][same]))
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Weights:
    """The features that have a weight, sorted, their weights, and the bias."""

    keys: np.ndarray
    values: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, found = features(texts)
        total = np.full(len(texts), self.bias)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            once = np.unique(rows[hit] * len(self.keys) + at[hit])
            total += np.bincount(once // len(self.keys), self.values[once % len(self.keys)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, width: int, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 1.0, epochs: int = 3) -> Weights:
    """Weights of ``width`` features from each row's distinct feature numbers, one row after another."""
    z, n = np.zeros(width), np.zeros(width)
    zb = nb = 0.0
    for _ in range(epochs):
        for k, y in zip(rows, labels, strict=True):
            zk, nk = z[k], n[k]
            root = np.sqrt(nk)
            w = np.where(np.abs(zk) <= l1, 0.0, (np.sign(zk) * l1 - zk) / ((beta + root) / alpha + l2))
            bias = -zb / ((beta + nb**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -500, 500))) - y
            z[k] = zk + g - (np.sqrt(nk + g * g) - root) / alpha * w
            n[k] = nk + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Weights(np.arange(width), w, float(-zb / ((beta + nb**0.5) / alpha + l2)))


def calibrated(weights: Weights, margins: np.ndarray, labels: np.ndarray) -> Weights:
    """Rescale so that margins fit rows that took no part in training (Platt's method, smoothed targets); a single class: as is."""
    ones, zeros = int(labels.sum()), int(len(labels) - labels.sum())
    if not ones or not zeros:
        return weights
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    y = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (y - p) - 1e-6 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if beta[0] <= 0:
        return weights
    return Weights(weights.keys, weights.values * beta[0], float(weights.bias * beta[0] + beta[1]))


def fitted(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Weights:
    """Weights from ``docs`` (doc_id, text) and ``labels`` (doc_id and the 0/1 column ``label``).

    Rows without a label or with a null text are left out; a doc_id with several labels counts as its largest. No rows or
    a single class: no weights, and a bias that tells that class.
    """
    truth = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    chosen = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id").join(truth, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.where(F.length("text") <= SAMPLE_CHARS).select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")

    def hashed(keys):
        """Each row's distinct features: all of them, or the places in sorted ``keys`` of those that are there."""

        def rows(batches):
            for b in slices(batches, "text", TEXT_BYTES):
                row, found = features(b.column("text").to_pylist())
                if keys is not None:
                    at = np.minimum(np.searchsorted(keys.value, found), max(len(keys.value) - 1, 0))
                    hit = keys.value[at] == found if len(keys.value) else np.zeros(len(found), bool)
                    row, found = row[hit], at[hit]
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, len(b)))
                parts = [np.unique(f).astype("<u8" if keys is None else "<u4").tobytes() for f in np.split(found[order], cuts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_label").cast(pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "label", "found"])

        return rows

    schema = "doc_id long, label int, found binary"
    # features of enough positive rows, then each row's share of them: what reaches the driver is bounded by SAMPLE
    positive = [np.frombuffer(f.as_buffer(), "<u8") for f in texts.where("_label = 1").mapInArrow(hashed(None), schema).select("found").toArrow().column("found")]
    keys, count = np.unique(np.concatenate(positive), return_counts=True) if positive else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys = keys[count >= LEAST]
    del positive
    table = texts.mapInArrow(hashed(docs.sparkSession.sparkContext.broadcast(keys)), schema).toArrow()
    order = np.argsort(np.asarray(table.column("doc_id")) * 0x9E3779B1 % 1_000_003, kind="stable")  # ids in a fixed mixed order
    found = table.column("found").to_pylist()
    rows, truth = [np.frombuffer(found[k], "<u4").astype(np.int64) for k in order], np.asarray(table.column("label"))[order]
    apart = np.arange(len(rows)) % 8 == 0  # for calibration
    weights = ftrl([r for r, a in zip(rows, apart, strict=True) if not a], truth[~apart], len(keys))
    margins = np.array([weights.bias + weights.values[r].sum() for r, a in zip(rows, apart, strict=True) if a])
    weights = calibrated(Weights(keys, weights.values, weights.bias), margins, truth[apart])
    kept = weights.values != 0
    return Weights(weights.keys[kept], weights.values[kept], weights.bias)


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id and score (0 to 1) of every text of ``docs`` (doc_id, text; more columns are ignored, whatever their names).

    Null and empty texts, and texts without a known feature, score what the bias says. Repeated rows and rows that share a
    doc_id are scored each; long texts are read whole. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def rows(batches):
        for b in slices(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(b.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")
