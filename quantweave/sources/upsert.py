"""Keyed upserts: last load wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str | Sequence[str] | None = None) -> DataFrame:
    """Old and new rows merged by key; a new row replaces the old one, or, with ``order`` (one column
    or several), the row with the larger version wins whatever its arrival, so replays are harmless.
    ``max_by`` folds map-side: many versions of one key never meet in one task."""
    keys = list(keys)
    rest = [c for c in old.columns if c not in keys]
    versions = [order] if isinstance(order, str) else list(order or [])

    def version(load: int):
        return F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(versions)], F.lit(load).alias("load"))
    seq, seq_new = version(0), version(1)
    both = (old.withColumn("_seq", seq)
            .unionByName(new.select(*[c for c in new.columns if c in old.columns]).withColumn("_seq", seq_new),
                         allowMissingColumns=True))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_seq").alias("_row")).select(*keys, "_row.*").select(*old.columns)


def merge_columns(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Update only the columns the new side carries; untouched columns survive. A new null
    means "not known" and keeps the old value."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    cols = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c)
            for c in old.columns if c != key]
    return old.join(n, key, "full_outer").select(key, *cols)


def evolve(old: DataFrame, new: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """Union of two schema versions; legacy columns back-fill their successors and disappear."""
    df = old.unionByName(new, allowMissingColumns=True)
    for legacy, current in renamed.items():
        if legacy in df.columns:
            df = df.withColumn(current, F.coalesce(F.col(current), F.col(legacy)) if current in df.columns
                               else F.col(legacy)).drop(legacy)
    return df


def upsert_table(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str,
                 order: str | Sequence[str] | None = None) -> None:
    """Merge into a parquet table partitioned by ``partition``, rewriting only the touched partitions.

    The write is rebalanced on the partition column: adaptive execution splits a
    partition by its size (``spark.sql.adaptive.advisoryPartitionSizeInBytes``), so a full
    year is written by many tasks, and packs small ones.
    """
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = None
    if old is None:
        merged = merge_latest(new.limit(0), new, keys, order)
    else:
        touched = new.select(partition).distinct()
        merged = merge_latest(old.join(touched, partition, "left_semi"), new, keys, order)
    (merged.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
