"""Bounded samples of labelled rows, and the fold that is held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_fold


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of rows outside the held-out fold; null ids and labels are left out, and of several labels of one id the greatest counts."""
    fold = crc_fold(F.col(id_col), folds)
    return labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold != held_out)).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("label"))


def sampled(ids: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of ids, by the hash of the id: the same rows whatever the partitioning."""
    return ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)
