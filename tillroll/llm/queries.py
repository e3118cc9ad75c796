"""Registered queries of this subpackage, each over its whole table, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    chat, divergence, hard_negatives, line_dedup, near_dup, packing, pii, suffix_dedup, tiling, token_files, topk, toxicity, url_vocab)
from tillroll.llm.common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix-target examples of all conversations and of the control-string conversation -7, read back as digests."""
    own = spark.sql(r"""SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                        (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)""")
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"),
                                                         F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.digests(chat.expand(given.unionByName(own)))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document held against all benchmark items."""
    return tiling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms of every document."""
    return pii.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    return url_vocab.judge(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learnt outside the held-out fold."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written in patched frame-of-reference files and read back."""
    return token_files.read(token_files.write(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents share."""
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 4096 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every hundredth vector among all vectors."""
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that 50-byte strings share with a smaller document."""
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh vector has a wrong label."""
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.usable(table(spark, sf_dir, "embeddings"), label=wrong), F.col("vec_id") % 100 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every source of a language differs from the others, and by which terms from the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_jaccard_join, op3_decontamination, op4_pii, op5_url_filter,
                                    op6_toxicity, op7_token_files, op8_line_dedup, op9_packing, op10_topk,
                                    op11_suffix_dedup, op12_hard_negatives, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_vocab.oracle_sql(), "op8_line_dedup": line_dedup.oracle_sql(), "op10_topk": topk.oracle_sql(),
            "op12_hard_negatives": hard_negatives.oracle_sql(), "op13_source_divergence": divergence.oracle_sql()}
