"""Sources: conversations to transcripts, text metadata, JSON properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank


def spoken_turns(turns: DataFrame) -> DataFrame:
    """User and assistant turns that are not blank."""
    return turns.where(F.col("role").isin("user", "assistant") & ~is_blank(F.col("text")))


def transcripts(turns: DataFrame) -> DataFrame:
    """One transcript a conversation: ``role: text`` in turn order, blank lines between, a final line feed."""
    said = spoken_turns(turns).select("conv_id", F.struct("turn", F.concat_ws(": ", "role", "text").alias("line")).alias("t"))
    rows = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return rows.select(
        "conv_id",
        F.concat(F.lit("t-chat-"), F.col("conv_id")).alias("label"),
        F.size("ts").cast("long").alias("message_count"),
        F.concat(F.array_join("ts.line", "\n\n"), F.lit("\n")).alias("content"),
    )


def json_field(df: DataFrame, col: str, field: str) -> DataFrame:
    return df.withColumn(field, F.get_json_object(col, f"$.{field}"))
