"""From raw documents to packed training sequences: each stage works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parley.llm import mil, near_dup, packing, repeats, rules
from parley.llm.store import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier predicts as good."""
    return mil.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def host_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected."""
    return rules.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return near_dup.one_of_each(docs, near_dup.Join(percent=80))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 200 bytes (some 35 words) that occur elsewhere; letters cut in half go, and n_chars follows.

    Other columns, whatever their names, stay as they are.  Null texts stay null; repeated rows repeat each other.
    """
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_all"))
    cut = repeats.without_repeats(whole, size=200, gram=100)
    text = F.when(F.col("_all")["text"].isNotNull(), repeats.letters(F.col("rest")))
    new = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cut.select(*((new[c] if c in new else F.col("_all")[c]).alias(c) for c in docs.columns))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("quality rules", host_rules), ("near duplicates", near_duplicates),
          ("suffix-array dedup", repeated_strings), ("best-fit packing", sequences)]

ORACLE_SQL = None  # learning, sorting suffixes and packing are beyond SQL; the tests hold the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
