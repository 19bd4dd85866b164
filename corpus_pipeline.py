"""From raw documents to token ids in five stages: filter, two deduplications, mix, encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, exact, jaccard, mixing, quality
from quillspark.llm.common import documents, fold, stored
from quillspark.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; those that the classifier rejects go.

    Null and empty texts are scored as texts without words, repeated rows each; an empty table stays
    empty. No column is added on the way.
    """
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id") != 1)
    model = quality.fit(docs, labels)
    return quality.kept(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, the one with the largest id; null ids come before all others.

    Null texts count as empty. Of rows that share id and text one stays.
    """
    return exact.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at Jaccard similarity 0.8 or more.

    The one with the smallest id stays. Rows with null ids and texts without words stay all.
    """
    return jaccard.drop_near_duplicates(docs, num=80, den=100, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: the words taken, a row per pass over a document.

    Null and empty texts have no words and give no row; a null source is a source.
    """
    return mixing.take_words(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the token ids of each row; a null text has none."""
    tokens = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mixing", mix_sources), ("bpe", encode_tokens)]

# No SQL: the classifier and the tokenizer cannot be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
