"""The registered queries of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, conversation_repair, html_main, langid, lm_score, mixing, near_vectors, ngram_join, packing, periodic_runs, permutation_index, quality, toxicity, url_filter


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.dedup(_table(spark, sf_dir, "embeddings"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(_table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return judged.select("doc_id", common.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "rate", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", common.held_out("doc_id", 5, 0).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op10_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_main.extract(pages.select("page_id", "url", "html"), html_main.train(pages)).select("page_id", "url", "text", "n_chars")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(_table(spark, sf_dir, "documents"), ~common.held_out("doc_id", 5, 1))
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), *scored.columns[2:])


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(_table(spark, sf_dir, "conversations"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.detect(docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL twins, where SQL can express the result."""
    return {
        "op1_ngram_join": ngram_join.ORACLE, "op2_near_vectors": near_vectors.ORACLE, "op3_url_filter": url_filter.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE, "op13_periodic_runs": periodic_runs.ORACLE,
    }
