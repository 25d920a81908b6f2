"""Quality by hierarchical empirical Bayes: a document's own evidence on top of what its host and path are like.

A logistic regression on shape features gives each document's evidence. Hosts and paths get posterior means of that
evidence by grouped sums: a path shrinks towards its host and a host towards all documents, by as many pseudo-documents
as the spread between hosts (paths) calls for. A document's posterior odds are its own odds times its path's, over those
of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import again, beside, checkpointed, joined_small

#: The regression is fitted on at most so many labelled rows, those with the least hash of the id, of at most so many characters.
SAMPLE, SAMPLE_CHARS = 16_384, 65_536
#: A document goes if its posterior is below this.
LEAST = 0.5
_UPPER = bytes(range(65, 91))
_MARKS = (b"#*$%&|<>", b"!", b"|", b"0123456789", _UPPER, b".,;:", b"@", b"\n")


def shape(text: str | None) -> list[float]:
    """Features of a text's shape; an empty or null text has zeros."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    shares = [(len(raw) - len(raw.translate(None, m))) / size for m in _MARKS]
    lines = raw.split(b"\n")
    distinct = len(set(words)) / n
    out = [np.log1p(len(words)), len(raw) / n / 10, distinct, len(set(lines)) / len(lines), sum(w[-1] in b"!#*$%&" for w in words) / n, sum(w.isupper() for w in words) / n]
    return out + [np.log(s + 1e-3) for s in shares] + [s * 10 for s in shares]


@dataclass
class Evidence:
    """A fitted regression: probability of quality 1 from a text's shape."""

    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def of(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([shape(t) for t in texts]).reshape(len(texts), -1) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.beta[:-1] + self.beta[-1], -30, 30)))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Evidence:
    """By Newton's method; no rows or a single class: the (smoothed) share of ones for every text."""
    width = len(shape(""))
    share = (y.sum() + 1) / (len(y) + 2)
    start = np.append(np.zeros(width), np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Evidence(np.zeros(width), np.ones(width), start)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    beta = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(width + 1), z.T @ (y - p) - ridge * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, beta)


def fitted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Evidence:
    """From ``docs`` (doc_id, text) and ``labels`` (doc_id, 0/1); a doc_id with several labels counts as its least."""
    truth = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    short = docs.where(F.length("text") <= SAMPLE_CHARS)
    chosen = short.select("doc_id").join(truth, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_label").cast(pa.int32()), pa.array([shape(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    got = short.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_label", "text").mapInArrow(rows, "label int, x array<double>").toArrow()  # at most SAMPLE rows
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, len(shape(""))))
    y = np.asarray(got.column("label")).astype(float)
    order = np.lexsort([*x.T, y])  # sums in a fixed order
    return regression(x[order], y[order])


def evidence(model: Evidence, text: Column) -> Column:
    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd

        return pd.Series(model.of(texts.where(texts.notna(), None).tolist()), dtype="float64")

    return of(text)


def logit(p: Column) -> Column:
    held = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(held / (1 - held))


def sites(rows: DataFrame) -> tuple[DataFrame, float]:
    """From (host, path, p) rows: host_posterior and path_posterior of every (host, path), and the mean of all.

    Pseudo-documents of a level: mean variance of a document over the variance between groups beyond what the groups'
    sizes explain (at least 1, at most 10,000). Sums are pre-aggregated, so a host with a third of all rows is two numbers
    from each task; they are written, so that the rows are read once.
    """
    paths = checkpointed(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))

    def pseudo(groups: DataFrame, centre: Column) -> float:
        mean = F.col("s") / F.col("n")
        r = groups.agg(F.sum(F.col("ss") - F.col("s") * mean).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (mean - centre) * (mean - centre)).alias("between")).first()
        if not r.n or r.k < 2:
            return 1.0
        within = r.within / max(r.n - r.k, 1)
        between = max((r.between - within * (r.k - 1)) / r.n, 1e-9)
        return float(min(max(within / between, 1.0), 10_000.0))

    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    centre = total.s / total.n if total.n else 0.5
    m = pseudo(hosts, F.lit(centre))
    hosts = hosts.select("host", ((F.col("s") + m * centre) / (F.col("n") + m)).alias("host_posterior"))
    both = joined_small(paths, hosts, ["host"])
    k = pseudo(both, F.col("host_posterior"))
    return checkpointed(both.select("host", "path", "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))), centre


def rated(docs: DataFrame, model: Evidence, host: Column, path: Column, name: str = "_quality") -> DataFrame:
    """``docs`` with struct ``name``: host, path and evidence of each text; one pass. Null hosts and paths count as the empty
    name, null texts as empty ones."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.withColumn(name, F.struct(text(host).alias("host"), text(path).alias("path"), evidence(model, F.col("text")).alias("evidence")))


def judged(rows: DataFrame, name: str = "_quality") -> DataFrame:
    """``rated`` rows with struct ``name``: host, path, evidence, host_posterior, path_posterior, posterior, kept.

    ``rows`` are read twice: for the sums of each site, and for the verdicts.
    """
    kept = [c for c in rows.columns if c != name]
    table, centre = sites(rows.select(f"{name}.host", f"{name}.path", F.col(f"{name}.evidence").alias("p")))
    named = table.select(F.struct("host", "path").alias("key"), F.struct("host_posterior", "path_posterior").alias("site"))
    mine = beside(rows, key=F.struct(f"{name}.host", f"{name}.path"), p=F.col(f"{name}.evidence"))
    both = joined_small(mine, named, ["key"])
    odds = logit(F.col("p")) + logit(F.col("site.path_posterior")) - logit(F.lit(centre))
    posterior = 1 / (1 + F.exp(-odds))
    fields = [F.col("key.host").alias("host"), F.col("key.path").alias("path"), F.col("p").alias("evidence"), F.col("site.host_posterior").alias("host_posterior"), F.col("site.path_posterior").alias("path_posterior"), posterior.alias("posterior"), (posterior >= LEAST).alias("kept")]
    return both.select(*again(kept), F.struct(*fields).alias(name))


def classified(docs: DataFrame, model: Evidence, host: Column, path: Column, name: str = "_quality") -> DataFrame:
    """``docs`` with struct ``name``: host, path, evidence, host_posterior, path_posterior, posterior, kept.

    Null hosts and paths count as the empty name, null and empty texts have the evidence of a text without words. Repeated
    rows have the same verdict and each its weight in the sums. More columns stay as they are, whatever their names (but
    ``name``, which is replaced). An empty table comes back empty.
    """
    return judged(rated(docs, model, host, path, name), name)
