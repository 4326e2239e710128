"""The corpus pipeline: language ID, toxicity, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. Stages but the last return the columns of documents.

No SQL twin exists: learned classifiers, MinHash verification and tokenisers are not expressible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geotab.llm import common, langid, mixing, ngram_join, packing, toxicity
from geotab.llm.queries import tokenizer


def _whole(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column _doc beside the columns an operator reads, so that no name of docs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language that the model knows."""
    judged = langid.identify(_whole(docs, "text"), langid.train(docs))
    known = (F.col("lang_pred") != "und") & (F.col("lang_score") >= langid.LEAST)
    return judged.where(known).select("_doc.*")


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(_whole(docs, "text"), model).where("toxic_predicted = 0").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, a row for each copy taken."""
    copies = mixing.expand(mixing.mix(_whole(docs, "doc_id", "text", "source", "n_chars")), ["_doc", "text", "n_chars"])
    changed = {"text", "n_chars"}
    return copies.select(*[F.col(c) if c in changed else F.col(f"_doc.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("toxicity", toxic_filter),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
