"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells (source, language, topic). Raking scales the cells' token weights until each marginal has its
target shares. A document's probability is its cell's weight times a rate, at most 1; the rate is calibrated so that the
expected number of tokens is the asked share of all. A document stays if a hash of its id, as a number in [0, 1), is below
its probability.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import BROADCAST_ROWS, again, beside, checkpointed, joined_small, written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, CLOSE = 200, 1e-9
#: Topics by what a text holds (the first that applies).
_TOPICS = (("shouted", ("!!",)), ("symbols", ("###", "***", "$$$", "%%%", "&&&")), ("tabular", (" | ",)), ("legal", ("opyright", "icense")), ("contact", ("@",)))


def topic(text: Column) -> Column:
    """A text's topic by its form; null and plain texts are prose."""
    out = F.lit("prose")
    for name, marks in reversed(_TOPICS):
        held = F.lit(False)
        for m in marks:
            held = held | F.contains(text, F.lit(m))
        out = F.when(F.coalesce(held, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Words of a text, at least 1."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(1))


def smoothed(shares: dict[str, float], power: float = 0.7) -> dict[str, float]:
    """Shares to a power, summing to 1: rare values gain."""
    raised = {k: v**power for k, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def raked(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """``weights`` scaled until, for each dimension, the sum over the cells of code k is targets[k] of the total.

    A target for a value that no cell has can't be met; its share falls to the others in proportion.
    """
    out = weights / max(weights.sum(), 1e-300)
    for _ in range(ROUNDS):
        worst = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, out, minlength=len(target))
            want = np.where(now > 0, target, 0)
            want = want / max(want.sum(), 1e-300)
            factor = np.divide(want, now, out=np.ones(len(now)), where=now > 0)
            worst = max(worst, float(np.abs(now - want).max(initial=0)))
            out = out * factor[code]
        if worst < CLOSE:
            break
    return out


def calibrated(size: np.ndarray, ratio: np.ndarray, share: float) -> float:
    """The rate for which the sum of size * min(1, rate * ratio) is ``share`` of the sum of size."""
    want = share * size.sum()
    low, high = 0.0, 1.0
    while (size * np.minimum(1, high * ratio)).sum() < want and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (size * np.minimum(1, mid * ratio)).sum() < want else (low, mid)
    return high


def _targets(cells: DataFrame, power: float) -> dict[str, dict[str, float]]:
    """Smoothed shares of tokens by each dimension's values."""
    out = {}
    for d in DIMENSIONS:
        rows = cells.groupBy(d).agg(F.sum("size").alias("size")).collect()
        total = sum(r["size"] for r in rows) or 1
        out[d] = smoothed({r[d]: r["size"] / total for r in sorted(rows, key=lambda r: r[d])}, power)
    return out


def probabilities(cells: DataFrame, targets: dict[str, dict[str, float]], share: float) -> DataFrame:
    """(source, lang, topic, weight, probability) of each cell: weight is its raked share over its own share.

    Up to BROADCAST_ROWS cells (counted first) are fitted in memory; beyond that by rounds of joins, to the same numbers.
    """
    spark = cells.sparkSession
    if cells.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _fitted_apart(cells, targets, share)
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))
    size = np.array([r["size"] for r in rows], float)
    names = [sorted({r[d] for r in rows}) for d in DIMENSIONS]
    codes = [np.array([{x: k for k, x in enumerate(n)}[r[d]] for r in rows], np.int64) for d, n in zip(DIMENSIONS, names, strict=True)]
    fit = raked(size, codes, [np.array([targets[d].get(x, 0.0) for x in n]) for d, n in zip(DIMENSIONS, names, strict=True)])
    ratio = fit / (size / max(size.sum(), 1e-300))
    rate = calibrated(size, ratio, share) if len(size) else 0.0
    found = [(*(r[d] for d in DIMENSIONS), float(w), float(min(1.0, rate * w))) for r, w in zip(rows, ratio, strict=True)]
    return spark.createDataFrame(found, "source string, lang string, topic string, weight double, probability double")


def _fitted_apart(cells: DataFrame, targets: dict[str, dict[str, float]], share: float) -> DataFrame:
    """The same as ``probabilities`` in DataFrames: a round is an aggregation and a join for each dimension."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("size").alias("t")).first().t
    fit = cells.withColumn("fit", F.col("size") / F.lit(float(total)))
    for k in range(ROUNDS):
        worst = 0.0
        for d in DIMENSIONS:
            want = spark.createDataFrame(sorted(targets[d].items()), f"{d} string, want double")
            now = fit.groupBy(d).agg(F.sum("fit").alias("now")).join(want, d, "left").fillna(0.0, ["want"])
            now = checkpointed(now)
            held = now.agg(F.sum("want")).first()[0] or 1.0
            now = now.withColumn("want", F.col("want") / held)
            worst = max(worst, now.agg(F.max(F.abs(F.col("now") - F.col("want")))).first()[0] or 0.0)
            fit = joined_small(fit, now, [d]).withColumn("fit", F.when(F.col("now") > 0, F.col("fit") * F.col("want") / F.col("now")).otherwise(F.col("fit"))).drop("now", "want")
        fit = checkpointed(fit)
        if worst < CLOSE:
            break
    ratio = checkpointed(fit.withColumn("weight", F.col("fit") / (F.col("size") / F.lit(float(total)))))
    low, high = 0.0, 1.0
    expected = lambda rate: ratio.agg(F.sum(F.col("size") * F.least(F.lit(1.0), F.lit(rate) * F.col("weight")))).first()[0]
    while expected(high) < share * total and high < 1e18:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < share * total else (low, mid)
    return ratio.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.lit(high) * F.col("weight")).alias("probability"))


def mixed(docs: DataFrame, share: float = 0.9, power: float = 0.7, targets: dict[str, dict[str, float]] | None = None, seed: int = 17, name: str = "_mix") -> DataFrame:
    """``docs`` with struct ``name``: source, lang, topic, n_tokens, weight, probability, sampled.

    Null sources and languages count as the empty name, null and empty texts as one token of prose; rows that share a doc_id
    stay or go together, and so do those without one. Repeated rows count each. More columns stay as they are, whatever
    their names (but ``name``, which is replaced). An empty table comes back empty. ``targets``: shares of tokens by value
    for each dimension (without: smoothed shares).
    """
    kept = [c for c in docs.columns if c != name]
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mine = beside(docs, source=of("source"), lang=of("lang"), topic=topic(F.col("text")), n_tokens=tokens(F.col("text")), doc_id=F.col("doc_id"))
    cells, _ = written(mine.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("size")), "cells")
    wanted = _targets(cells, power) | (targets or {})
    rows = joined_small(mine, probabilities(cells, wanted, share), list(DIMENSIONS))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return rows.select(*again(kept), F.struct(*DIMENSIONS, "n_tokens", "weight", "probability", (chance < F.col("probability")).alias("sampled")).alias(name))
