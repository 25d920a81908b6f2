"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fertility, langid, mixing, neighbours, packing, quality, secrets, simhash, token_output, toxicity
from .util import fold, written

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Where the file of a public vocabulary lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fitted(docs, training=fold("doc_id", 4) != 2, calibration=fold("doc_id", 32) == 1)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return langid.predicted(held, models).withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select("doc_id", "_mix.*")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.digest(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.assessed(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *fertility.MEASURES)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.filter("_spans", lambda s: s["kind"] == k)
    base = F.filter("_spans", lambda s: s["kind"] < len(secrets.BASE))
    counts = [F.size(of(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return docs.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("_spans")).alias("spans"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.linked(table(spark, sf_dir, "embeddings"), least=0.9)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.clusters(table(spark, sf_dir, "documents"), words=3, within=2)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    rows = quality.rated(docs.select("doc_id", "text", "lang", "source"), model, host=F.col("source"), path=F.col("lang"))
    return quality.judged(written(rows.select("doc_id", "_quality"), "evidence")[0]).select("doc_id", "_quality.*")  # texts are read once


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.fitted(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.scored(docs, weights)
    return scored.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_source_mixing,
        op3_token_output,
        op4_tokeniser_fertility,
        op5_secret_scan,
        op6_best_fit_packing,
        op7_embedding_near_dedup,
        op8_simhash_near_dedup,
        op9_quality_classifier,
        op10_toxicity,
    )
}


def _secret_sql() -> str:
    """Spans of each rule from the lengths of the texts between its matches and of the matches."""
    lengths = "list_transform({0}, lambda x: length(x))"
    parts = []
    for k, rule in enumerate(secrets.RULES):
        regex = rule.regex.replace("'", "''")
        all_of = lambda g: lengths.format(f"regexp_extract_all(t, '{regex}', {g})")  # noqa: E731, B023
        parts.append(f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {lengths.format(f"string_split_regex(t, '{regex}')")} AS gaps, {all_of(0)} AS longs, {all_of(rule.group)} AS sizes, {rule.least} AS least FROM d")
    base = f"k < {len(secrets.BASE)}"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT doc_id, k, kind, gaps, longs, sizes, least, unnest(range(1, len(longs) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, (list_sum(gaps[1:i]) + coalesce(list_sum(longs[1:i - 1]), 0))::BIGINT AS a, longs[i] AS n FROM i WHERE sizes[i] >= least),
g AS (SELECT doc_id, {counts}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) FILTER (WHERE {base}) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


#: Embeddings by all pairs (for small tables only; the query itself never makes them).
_NEIGHBOUR_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, p.y FROM r JOIN p ON p.x = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x), n AS (SELECT x AS vec_id, count(*) AS n FROM p GROUP BY x)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""
#: The others need a tokenizer, trained models or XXH64, which SQL doesn't have: tests hold them against brute force.
ORACLES: dict[str, str] = {"op5_secret_scan": _secret_sql(), "op7_embedding_near_dedup": _NEIGHBOUR_SQL}
