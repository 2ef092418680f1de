"""A corpus pipeline from the numbered operators: filter, deduplicate, cut, decontaminate, pack.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns the columns of
``documents`` (the last one: the packed pieces)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerlake.llm import decontam, packing, rules, simhash, suffixes
from layerlake.llm.common import materialize, prepare, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go."""
    prepare(spark)
    return rules.keep_documents(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies (0.8 of their sets of five words) stays."""
    prepare(spark)
    return simhash.keep_dissimilar(docs.select(*COLUMNS))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that start elsewhere too are cut out of the texts."""
    prepare(spark)
    cut = suffixes.remove_repeats(docs, suffixes.PASSAGES, carry=("lang", "source"))
    return cut.select(
        "doc_id", F.col("kept").alias("text"), F.col("_0").alias("lang"), F.col("_1").alias("source"), F.length("kept").cast("long").alias("n_chars")
    )


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of benchmark windows are cut out of the texts."""
    prepare(spark)
    clean = decontam.decontaminate(docs.select(*COLUMNS[:4]), read(spark, sf_dir, "benchmark"))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048, neighbours on a Hilbert curve together."""
    prepare(spark)
    return packing.pack(docs.select("doc_id", "text")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("curve_packing", curve_packing),
]

#: SQL has no tokenizers, forests or suffix arrays; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
