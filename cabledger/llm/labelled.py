"""Held-out folds and bounded draws of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FOLDS = 5


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    """Whether the labels of this id are kept for measuring; never for null."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def labelled_ids(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label, _h) of the ids that may be learnt from, with the hash they are drawn by.

    Of several labels of an id the greatest counts; labels other than 0 and 1, null ids and held-out ids are left out.
    """
    return (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
            .filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id")) != 0))
            .groupBy("id").agg(F.max("label").alias("label")).withColumn("_h", F.xxhash64(F.col("id"), F.lit(7))))


def draw(ids: DataFrame, most: int) -> DataFrame:
    """The first ``most`` ids by hash."""
    return ids.orderBy("_h", "id").limit(most)


def texts_of(docs: DataFrame, drawn: DataFrame) -> DataFrame:
    """(text, label) of drawn ids; ``docs`` has id and text. Only drawn ids, a bounded number, are sent to every task."""
    return docs.join(F.broadcast(drawn.select("id", "label")), "id").select("text", "label")
