"""Transcripts from a table of submitted sessions, and product catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_sessions(sessions: DataFrame) -> DataFrame:
    """label, content, metadata of sessions ``(session_id, project_dir, subsession_seq, submitted_by, processed, body)`` that were not
    processed yet and have a body; later parts of a session have their number in the label."""
    seq = F.coalesce(F.col("subsession_seq"), F.lit(0))
    label = F.concat(F.lit("t-mesh-"), F.col("session_id"), F.when(seq > 0, F.format_string("-sub%04d", seq)).otherwise(""))
    text = {"source": F.lit("mesh"), "session_id": F.col("session_id"), "subsession_seq": seq, "parent_session_id": F.col("session_id"), "project_dir": F.col("project_dir"), "submitted_by": F.col("submitted_by")}
    metadata = F.create_map(*[x for k, v in text.items() for x in (F.lit(k), v.cast("string"))])
    rows = sessions.where(~F.coalesce(F.col("processed"), F.lit(False)) & F.col("body").isNotNull())
    return rows.select(label.alias("label"), F.col("body").alias("content"), metadata.alias("metadata"))


def with_offers(catalogue: DataFrame, offers: DataFrame, sku: str, offer_sku: str, value: str) -> DataFrame:
    """Every product with the number of its offers and the largest ``value`` among them."""
    o = offers.groupBy(F.col(offer_sku).alias(sku)).agg(F.count("*").alias("n_offers"), F.max(value).cast("double").alias("largest"))
    return catalogue.join(o, sku, "left").withColumn("n_offers", F.coalesce("n_offers", F.lit(0)).cast("long"))
