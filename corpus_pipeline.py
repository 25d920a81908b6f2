"""A training-data pipeline over ``documents``: each stage calls one operator of strandframe.llm.

Every stage takes the documents that the one before it kept, and returns documents with the same columns; the last one
returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.llm import mixing, packing, quality, secrets, simhash
from strandframe.llm.queries import table, tokenizer
from strandframe.llm.util import again, beside, checkpointed, dropped, joined_small, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def spare(docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    return next(name for k in range(len(docs.columns) + 1) if (name := f"found{k}") not in docs.columns)


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects; fitted on the labels of ``documents``.

    Null and empty texts are judged as texts without words, null sources and languages as sites of the empty name. Repeated
    rows stay or go together. More columns stay as they are, whatever their names. Empty input: no rows.
    """
    name = spare(docs)
    model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    found = quality.classified(docs, model, host=F.col("source"), path=F.col("lang"), name=name)
    return found.where(F.col(name)["kept"]).select(*columns(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id: SimHash fingerprints at most 2 bits apart, or
    five-word shingles with a similarity of 0.8 or more, which fingerprints alone don't tell.

    Null and empty texts are copies of one another. Rows with a null doc_id stay; of rows that share a doc_id, all or none.
    More columns stay as they are, whatever their names. Empty input: no rows.
    """
    found = simhash.near_copies(docs, words=3, within=2, similar_words=5, similarity=0.8)
    copies = checkpointed(found.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct())
    return joined_small(beside(docs, id=F.col("doc_id").cast("long")), copies, ["id"], "left_anti").select(*again(docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; n_chars, if there is such a column, follows the text.

    Null texts stay null, and their n_chars as it was; rows without a secret stay as they are. Repeated rows are each
    redacted. More columns stay as they are, whatever their names. Empty input: no rows.
    """
    name = spare(docs)
    found = secrets.scanned(docs, name=name)
    clean = secrets.redacted(F.col("text"), F.col(name))
    new = {"text": clean}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(name) > 0, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that sampling keeps: nine tenths of the tokens, towards smoothed shares of sources, languages and topics.

    Null sources and languages count as the empty name, null and empty texts as one token; rows that share a doc_id, and
    those without one, stay or go together. More columns stay as they are, whatever their names. Empty input: no rows.
    """
    name = spare(docs)
    return mixing.mixed(docs, share=0.9, power=0.7, name=name).where(F.col(name)["sampled"]).select(*columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, packed into sequences of at most 2048 tokens.

    A null text is an empty one: its end id alone. Repeated rows have pieces of their own. Empty input: no rows.
    """
    return packing.best_fit(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("secret scan", redact),
    ("source mixing", mix),
    ("best-fit packing", pack),
]
#: The last stage needs a tokenizer, which SQL doesn't have; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet to the shared folder and read again."""
    at = scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(rows.schema).parquet(f"{at}/{k}")
        if before is not None:
            dropped(spark, before)
        before = f"{at}/{k}"
    return docs
