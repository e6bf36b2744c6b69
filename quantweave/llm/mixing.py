"""Mixing sources to target weights by pivotal dependent rounding (operator 7).

Every source gets a target: its share, by weight, of ``budget`` times all words;
a target stops at ``most`` times the source's own size and the excess goes to the
others by weight. A document should then be taken ``target / size of its source``
times. The whole part is taken as it is; the fractions are rounded dependently:
two fractional documents exchange word mass, in a random direction that leaves
both expectations alone, until one of them is at 0 or 1. The words of the pair stay the same, so
only the last fractional document of a source moves the source's total.

The reduction is a tree. Documents are dealt to blocks by hash; a block leaves
at most one fractional document, which joins those of ``FAN`` blocks on the next
level, and the top level rounds the last one to the nearer side, so a source
misses its target by at most half a document. Random numbers are hashes of the documents, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantweave.llm.base import packed, query, read, staged, word_array

WEIGHTS, BUDGET, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_DOCS, FAN = 2_000, 512
TINY = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target), one row per source.

    Filling by weight: with sources ordered by ``most * size / weight``, the first
    ones stop at their limit and the level of the others follows from what is left.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int"))).withColumn("limit", F.col("source_size") * most)
    everywhere = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, rest = everywhere.rowsBetween(Window.unboundedPreceding, -1), everywhere.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy(F.lit(0))) * budget - F.coalesce(F.sum("limit").over(upto), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy(F.lit(0))).level
    return per.withColumn("target", F.least(F.col("limit"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).drop("weight", "limit", "level")


def uniform(*parts) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)), seed=7) / 2.0 ** 64


def pivot(p: np.ndarray, size: np.ndarray, names: list, seed: str, close: bool) -> np.ndarray:
    """Rounds ``p`` in the order given until at most one entry is fractional (none if ``close``)."""
    p, held = p.astype(float).copy(), -1
    for j in range(len(p)):
        if p[j] < TINY or p[j] > 1 - TINY:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, p[held] * size[held], p[j] * size[j]
        up, down = min(size[i] - a, b), min(a, size[j] - b)  # words i may take from j, and give to j
        move = up if uniform(seed, names[i], names[j]) * (up + down) < down else -down
        p[i], p[j] = (a + move) / size[i], (b - move) / size[j]
        for k in (i, j):
            if p[k] < TINY or p[k] > 1 - TINY:
                p[k] = round(p[k])
        held = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    if close and held >= 0:
        p[held] = float(p[held] >= 0.5)
    return p


def rounded(rows: DataFrame, blocks: int) -> DataFrame:
    """``rows`` (row_key, source, block, size, p and others) with ``p`` 0 or 1. ``blocks`` is the largest number of blocks of a source."""
    kind = rows.schema

    def level(close: bool, depth: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("size", "descending"), ("row_key", "ascending")])
            p = pivot(table["p"].to_numpy(), table["size"].to_numpy().astype(float), table["row_key"].to_pylist(), f"level{depth}", close)
            return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p))
        return run
    done, depth = None, 0
    while True:
        close = blocks <= 1
        out = rows.groupBy("source", "block").applyInArrow(level(close, depth), kind)
        if close:
            return done.unionByName(out) if done is not None else out
        out = staged(out, "rounded")
        whole = out.filter("p = 0 OR p = 1")
        done = whole if done is None else done.unionByName(whole)
        rows = out.filter("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        blocks, depth = -(-blocks // FAN), depth + 1


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: float = MOST, block_docs: int = BLOCK_DOCS,
          doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(row_key, doc_id, source, size, source_size, target, copies), one row per document.

    Defined cases: a null text has size 0 and is taken 0 times; sources sort by
    code point, null last and a source of its own; a source without words gets
    target 0; equal sizes go in the order of the row hash; repeated rows are rounded each on its own; an
    empty table gives an empty result.
    """
    sizes = staged(docs.select(F.xxhash64(doc_id, text, source).alias("row_key"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                               F.size(word_array(F.col(text))).cast("long").alias("size")), "sizes")
    targets = staged(source_targets(sizes, weights, budget, most), "targets").withColumnRenamed("source", "_s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    number = F.ceil(F.col("n_docs") / block_docs)
    rows = (sizes.join(targets, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("share", F.least(share, F.lit(float(most))))
            .withColumn("whole", F.when(F.col("size") > 0, F.floor(F.col("share") + TINY)).otherwise(0).cast("int"))
            .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("share") - F.col("whole"), F.lit(0.0))).otherwise(0.0))
            .withColumn("block", F.pmod(F.xxhash64("row_key", F.lit("block")), number).cast("int")).drop("share", "n_docs"))
    most_docs = targets.agg(F.max("n_docs")).first()[0]
    if most_docs is None:
        return rows.withColumn("copies", F.lit(0).cast("long")).drop("p", "whole", "block")
    return (rounded(rows, -(-most_docs // block_docs)).withColumn("copies", (F.col("whole") + F.col("p")).cast("long"))
            .select("row_key", "doc_id", "source", "size", "source_size", "target", "copies"))


def take(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Rows with equal id, text
    and source share their copies; extra columns pass through."""
    copies = mixed(docs, **kw).groupBy("row_key").agg(F.sum("copies").cast("int").alias("copies")).filter("copies > 0")
    rows = packed(docs, row_key=F.xxhash64("doc_id", "text", "source"))
    return (rows.join(copies, "row_key").dropDuplicates(["row_key"])
            .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*"))


@query("op7_pivotal_mixing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
