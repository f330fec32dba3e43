"""From raw documents to shards, in five stages.

Each stage gets what the one before it kept, reads ``doc_id, text, lang, source`` and
returns the columns of its documents; the last returns the shards' manifest. Documents
are never changed, only left out or, where sources are mixed, taken several times.

1. language: documents without a letter go, and those that lie farther from all languages
   than held-out documents do. Where nothing can be learned, all with letters stay.
2. near duplicates: of each class of the Jaccard join one document stays, the smallest
   doc_id, documents without one behind all others, then the smallest hash of the text.
   Rows with the same doc_id and text are one document; different texts of a doc_id are
   documents of their own. Texts without a word are in no class.
3. decontamination: documents that hold an item of the benchmark go.
4. mixing: documents in training order, once for each time they are taken. Documents
   of sources above their share that the mix does not take, and texts without words, go.
5. sharding: every row gets a shard and a slot.

Empty tables pass through all stages; extra columns are kept until the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.llm import decontamination, jaccard_join, language, mixing, sharding
from inkveil.llm.common import staged, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    return language.recognised(docs, model, language.farthest(docs, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    first = jaccard_join.firsts(docs).withColumnsRenamed(
        {"doc_id": "_id", "text_hash": "_hash", "repeats": "_repeats"}
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    met = docs.where(words).join(first.hint("merge"), same)
    once = met.where("_repeats = 1").select(*docs.columns)
    blank = docs.where(~words)
    unnamed = blank.where(F.col("doc_id").isNull())
    named = blank.where(F.col("doc_id").isNotNull())
    # rows of one id and text: the same one stays in every run
    rest = F.to_json(F.struct(F.lit(0), *[c for c in docs.columns if c not in ("doc_id", "text")]))
    row = F.min_by(F.struct(*docs.columns), rest).alias("_row")
    repeated = met.where("_repeats > 1").groupBy("_id", "_hash").agg(row).select("_row.*")
    named = named.groupBy("doc_id", "text").agg(row).select("_row.*")
    return once.unionByName(repeated).unionByName(named).unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: a trained classifier decides in the first stage, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
