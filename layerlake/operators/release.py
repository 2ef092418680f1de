"""Releases: a searchable index of artifacts with the lineage of each, stored together and read without the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, index


def write_release(artifacts: DataFrame, label: str, columns: list[str], edges: DataFrame, path: str) -> int:
    """Writes the index of ``artifacts`` and their chains over ``edges(child, parent)`` as a new version under ``path``; the
    index's version names both, and it is switched last. Returns the version."""
    spark = artifacts.sparkSession
    number = index.version(spark, f"{path}/index") + 1
    chains, _ = graph.closure(edges, artifacts.select(F.col(label).alias("node")))
    chains.select(F.col("node").alias("label"), "ancestor", F.col("depth").cast("long").alias("depth")).write.mode("overwrite").parquet(f"{path}/chains/{number:08d}")
    index.build(artifacts, label, columns, f"{path}/index")
    return number


def chains(spark, path: str) -> DataFrame:
    """label, ancestor, depth of the newest release."""
    return spark.read.parquet(f"{path}/chains/{index.version(spark, f'{path}/index'):08d}")


def search_release(spark, path: str, queries: DataFrame, query_id: str, text: str, k: int = 10) -> DataFrame:
    """query_id, label, score, rank, ancestor, depth: the ``k`` best artifacts for each query with all that they are derived from."""
    hits = index.search_many(spark, f"{path}/index", queries, query_id, text, k)
    return hits.join(chains(spark, path), "label").select("query_id", "label", "score", "rank", "ancestor", "depth")
