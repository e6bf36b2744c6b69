"""Shared helpers: words, staged tables, query registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word is a maximal run of characters other than blank, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def query(name: str, oracle: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``."""
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def word_array(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back, so lineage is
    cut by files that survive any executor."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of :func:`staged` that no later plan reads, so they don't take disk until the session ends."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            jpath = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(jpath, True)


def packed(docs: DataFrame, **cols: Column) -> DataFrame:
    """The columns asked for, and the input row whole as struct ``_row``, so
    that no column of the input can clash with a working column."""
    return docs.select(*[c.alias(k) for k, c in cols.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
