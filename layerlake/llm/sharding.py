"""Contiguous shards of nearly equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, text_of


def balanced_shards(docs: DataFrame, n_shards: int = 8, slack: float = 0.01) -> DataFrame:
    """Deals ``docs(doc_id, text)`` into ``n_shards`` contiguous runs of nearly equal bytes.

    Rows are put in the total order (MD5 of the text, doc_id), so copies of one text lie side by side. Range partitions
    are summed on their own, their totals give every row its global byte position, and the position's middle is cut at
    equal targets. Of the groups of copies that a cut meets (as many as there are cuts at most), those of at most
    ``slack`` of a shard go whole to the shard of their middle; larger ones, which may exceed a shard, are cut between
    rows. So sizes of shards differ from the target by one row's size or ``slack`` at most. The texts themselves are
    never shuffled: only ids, sizes and checksums are.

    Null text: no bytes, size 1. Null doc_id: a row as any other. Repeated rows: each keeps a place of its own. Very long
    texts: whole, so one may exceed a shard. Empty table: no rows. Other columns are ignored, and may have any names.
    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    t = text_of(docs)
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.md5(t.cast("binary")).alias("h"),
    )
    s = prefix_sums(rows, ["h", "doc_id"], "size", "shards")
    cut = s.where(f"((start + size) * {n_shards} - 1) div total >= (start * {n_shards} + total - 1) div total").select("h").distinct()
    met = s.join(F.broadcast(cut), "h", "left_semi").groupBy("h").agg(F.min("start").alias("g0"), F.sum("size").alias("gs"), F.first("total").alias("all"))
    whole = materialize(met.where(F.col("gs") * n_shards <= slack * F.col("all")).select("h", "g0", "gs"), "groups")
    middle = F.coalesce(F.expr("2 * g0 + gs - 1"), F.expr("2 * start + size - 1"))
    s = s.join(F.broadcast(whole), "h", "left").withColumn("middle", middle)
    s = s.withColumn("shard", F.least(F.expr(f"middle * {n_shards} div (2 * total)"), F.lit(n_shards - 1)).cast("int"))
    first = s.groupBy("shard").agg(F.min("nth").alias("first"))
    return s.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
