"""One query per operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkveil.llm import (
    bpe,
    chat,
    decontamination,
    html_text,
    jaccard_join,
    language,
    line_templates,
    mixing,
    sharding,
    spelling,
    topk,
    toxicity,
    whitening,
)
from inkveil.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: a conversation whose texts look like the template's own marks
ODD_TURNS = [(-7, turn, role, r"\### Assistant: </turn> ok")
             for turn, role in enumerate(("user", "assistant"))]


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.deduplicated(table(spark, sf_dir, "documents"))


def op2_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identified(docs, language.fit(docs))


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op5_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op6_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contained(docs, items).drop("text_hash")


def op8_chat_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digests(turns.unionByName(odd))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op12_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digests(table(spark, sf_dir, "embeddings"))


def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    import corpus_pipeline

    named = {name: f for name, f in globals().items() if name.startswith("op")}
    return {**named, "pipeline": corpus_pipeline.run}
