"""The corpus pipeline: stages that each write their result, which the next one reads as its documents.

toxicity -> exact dedup -> SimHash near-dedup -> benchmark decontamination -> best-fit packing

All stages bear null ids and texts, empty and very long texts, repeated rows, other columns of any name, and empty tables; all but the last
return the columns that they got.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnwork.llm import decontamination, exact_dedup, packing, simhash, toxicity
from tarnwork.llm.common import column, pick, stash, table


def kept(docs: DataFrame, operator: Callable[..., DataFrame], condition: str) -> DataFrame:
    """The rows that the operator marks, with all their columns as they were, whatever their names."""
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    marked = operator(plain, id_col=f"_{column(docs, 'doc_id')}", text_col=f"_{column(docs, 'text')}")
    return marked.filter(condition).select(*plain.columns).toDF(*docs.columns)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, trained on the labelled ones among the stage's own, doesn't call toxic.

    Without any label nothing is called toxic. A null or empty text stays; of equal texts all stay or all go.
    """
    labels = pick(table(spark, sf_dir, "labels"), doc_id="doc_id", toxic="toxic")
    model = toxicity.train(pick(docs, doc_id="doc_id", text="text"), labels)
    return kept(docs, lambda plain, **named: toxicity.score(plain, model, **named), "predicted = 0")


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id; null and empty texts are equal to each other."""
    return kept(docs, exact_dedup.exact_dedup, "kept")


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are connected by five-word shingles with a similarity of 0.8 or more, the row with the smallest id; texts without words stay."""
    return kept(docs, simhash.near_dedup, "kept")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and empty texts stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document in its sequence of 1,024 tokens; a null or empty text is its end id alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", keep_one_of_equal),
    ("simhash_near_dedup", keep_one_of_near),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None  # a trained model and a fingerprint search; tests/llm holds the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stash(docs, name)
    return docs
