"""Average-tie ranks and exact order statistics inside a group.

``split_positions`` collapses equal values (map-side), sorts the distinct values of all
groups in one range-partitioned pass and adds the counts of earlier partitions, so no task
has to hold a whole group, a hot value is a single row, and the result does not depend
on where the partitions are cut. The sorted table is written once, so all readers see
the same cuts. ``dealt_ranks`` ranks whole rows: it deals them once by value and needs no join back to
them. A caller who knows that a group is small (``bounded=True``) gets one window sort instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from quantweave.session import staged


def tied_rank(keys: Sequence[str], value: str | Column) -> Column:
    """Average-tie rank of the non-null values as one window expression."""
    v = F.col(value) if isinstance(value, str) else value
    order = Window.partitionBy(*keys).orderBy(v.asc_nulls_last())
    ties = order.rangeBetween(Window.currentRow, Window.currentRow)
    return F.when(v.isNotNull(), F.rank().over(order) + (F.count(v).over(ties) - 1) / F.lit(2.0))


def group_size(keys: Sequence[str], value: str) -> Column:
    return F.count(value).over(Window.partitionBy(*keys))


def _running(names: list[str]):
    """Running sums of the columns ``names`` within runs of equal ``_g``, ``_h``, over a sorted partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            g, h = (batch.column(c).to_numpy() for c in ("_g", "_h"))
            new = np.r_[last != (g[0], h[0]), (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
            starts, group = np.flatnonzero(new), np.cumsum(new) - 1
            out = []
            for i, c in enumerate(names):
                x = batch.column(c).to_numpy()
                total = np.cumsum(x)
                before = np.r_[total[starts] - x[starts], -carry[i]]  # group -1 goes on from the batch before
                out.append(total - before[group])
                carry[i] = out[-1][-1]
            last = (g[-1], h[-1])
            kept = [k for k in batch.schema.names if k not in ("_g", "_h")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *map(pa.array, out)], names=[*kept, *[f"_run_{c}" for c in names]])
    return run


def split_positions(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column] | None = None, few_groups: bool = False,
                    weight: Column | None = None) -> DataFrame:
    """One row per distinct value: ``cnt`` equal rows, ``before`` smaller rows, ``n`` rows in
    the group, plus the ``sums`` (whole numbers) over the equal rows and their totals ``before_<sum>`` over
    the smaller rows and ``total_<sum>`` over the group. A row counts ``weight`` times.

    ``few_groups`` says that the keys are feature, model or grid ids, so that the offsets (one row
    for each group and partition) can be broadcast and the rows of a group, possibly the whole
    table, never shuffle by the group key alone.
    """
    keys, sums = list(keys), sums or {}
    added = ["cnt", *sums]
    vals = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.sum(F.lit(1) if weight is None else weight).cast("long").alias("cnt"), *[F.sum(c).cast("long").alias(k) for k, c in sums.items()])
    vals = staged(vals, "values")  # the range cuts look at it before it is dealt
    dealt = vals.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    marked = dealt.select(F.xxhash64(*keys, F.lit(0)).alias("_g"), F.xxhash64(*keys, F.lit(1)).alias("_h"), F.spark_partition_id().alias("_p"), *vals.columns)
    kind = ", ".join([f"_p int, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in vals.schema)}", *[f"`_run_{c}` long" for c in added]])
    table = staged(marked.mapInArrow(_running(added), kind), "positions")
    totals = table.groupBy(*keys, "_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in added])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_p", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in added],
                            *[F.sum(f"_t_{c}").over(group).alias(f"total_{c}") for c in added])

    def before(c):
        return F.col(f"_off_{c}") + F.col(f"_run_{c}") - F.col(c)
    return (table.join(F.broadcast(offsets) if few_groups else offsets, [*keys, "_p"])
            .select(*keys, value, "cnt", before("cnt").alias("before"), F.col("total_cnt").alias("n"), *sums,
                    *[before(c).alias(f"before_{c}") for c in sums], *[f"total_{c}" for c in sums]))


#: Two hashes of the group and two of the value, which tell where a run ends.
_MARKS = ("_g1", "_g2", "_v1", "_v2")


def _in_runs(weight: str | None = None):
    """Of a sorted partition, every row with the smaller rows of its group here (``_before``), its equals here (``_cnt``) and whether
    these may go on in a neighbour (``_edge``). Rows wait until their run of equal marks is complete; a row counts ``weight`` times."""
    def done(parts, before, cnt, edge):
        for part in parts:
            n = part.num_rows
            kept = [k for k in part.schema.names if k not in _MARKS]
            cells = [pa.array(np.broadcast_to(x, n)) for x in (np.asarray(before, np.int64), np.asarray(cnt, np.int64), np.asarray(edge, bool))]
            yield pa.RecordBatch.from_arrays([*[part.column(k) for k in kept], *cells], names=[*kept, "_before", "_cnt", "_edge"])

    def weights(batch):
        return batch.column(weight).to_numpy() if weight else np.ones(batch.num_rows, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, waiting, key, first = None, 0, [], None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            g, h, v, w = (batch.column(c).to_numpy() for c in _MARKS)
            starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
            ends = np.r_[starts[1:], batch.num_rows]
            if waiting:
                if key == (v[0], w[0]):
                    waiting.append(batch.slice(0, ends[0]))
                    if len(starts) == 1:
                        continue
                    starts, ends = starts[1:], ends[1:]
                cnt = sum(int(weights(x).sum()) for x in waiting)
                yield from done(waiting, rows, cnt, first)
                first, rows = False, rows + cnt
            a, z = starts[0], starts[-1]
            length, size = ends - starts, np.add.reduceat(weights(batch), starts)
            fresh = np.r_[group != (g[a], h[a]), (g[starts[1:]] != g[starts[:-1]]) | (h[starts[1:]] != h[starts[:-1]])]
            upto = np.cumsum(size) - size
            base = np.r_[-rows, upto[fresh]][np.cumsum(fresh)]  # the group before goes on
            before = upto - base
            if z > a:
                edge = np.zeros(len(starts) - 1, bool)
                edge[0], first = first, False
                yield from done([batch.slice(a, z - a)], *[np.repeat(x[:len(edge)], length[:-1]) for x in (before, size, edge)])
            group, rows, waiting, key = (g[z], h[z]), int(before[-1]), [batch.slice(z)], (v[z], w[z])
        if waiting:
            yield from done(waiting, rows, sum(int(weights(x).sum()) for x in waiting), True)
    return run


def dealt_ranks(rows: DataFrame, keys: Sequence[str], value: str, rank_col: str, size_col: str, few_groups: bool = False,
                weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``rows`` (written ones, numbered by ``_id``) whose value and keys are there, with average-tie rank and group size; and (keys, size) of the groups.

    Rows are dealt once, by keys, value and number, so that neither a large group nor a hot value lands in one task. A task
    counts inside its range; what earlier ranges hold of a group, and the few values that a cut goes through, are small tables.
    ``few_groups`` says that the groups are dates, features or grid points, so that these are broadcast. A row counts ``weight`` times."""
    keys = list(keys)
    there = reduce(lambda d, c: d.where(F.col(c).isNotNull()), [value, *keys], rows)
    dealt = there.repartitionByRange(*keys, value, "_id").sortWithinPartitions(*keys, value)
    marks = [F.xxhash64(*x, F.lit(i)).alias(c) for c, x, i in zip(_MARKS, (keys, keys, [*keys, value], [*keys, value]), (0, 1, 0, 1), strict=True)]
    kind = StructType([*rows.schema.fields, StructField("_p", IntegerType()), StructField("_before", LongType()), StructField("_cnt", LongType()), StructField("_edge", BooleanType())])
    table = staged(dealt.select(*marks, *rows.columns, F.spark_partition_id().alias("_p")).mapInArrow(_in_runs(weight), kind), "dealt")
    group = Window.partitionBy(*keys)
    offsets = table.groupBy(*keys, "_p").agg(F.sum(weight or F.lit(1)).alias("_t"))
    offsets = offsets.select(*keys, "_p", F.coalesce(F.sum("_t").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                             F.sum("_t").over(group).alias(size_col))
    # At most two values of a task: those that go on in a neighbour.
    cut = table.where("_edge").groupBy(*keys, value, "_p").agg(F.max("_before").alias("_before"), F.max("_cnt").alias("_cnt")).join(F.broadcast(offsets) if few_groups else offsets, [*keys, "_p"])
    cut = cut.groupBy(*keys, value).agg(F.min(F.col("_off") + F.col("_before")).alias("_first"), F.sum("_cnt").alias("_all"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1").drop("_parts")
    found = table.join(F.broadcast(offsets) if few_groups else offsets, [*keys, "_p"]).join(F.broadcast(cut), [*keys, value], "left")
    before, cnt = F.coalesce("_first", F.col("_off") + F.col("_before")), F.coalesce("_all", "_cnt")
    return (found.select(*rows.columns, (before + (cnt + 1) / F.lit(2.0)).alias(rank_col), size_col),
            offsets.select(*keys, size_col).distinct())


def avg_rank(df: DataFrame, keys: Sequence[str], value: str, rank_col: str = "rank",
             size_col: str | None = None, bounded: bool = False, few_groups: bool = False) -> DataFrame:
    """Add the average-tie rank of ``value`` inside ``keys`` (null stays null).

    Rows are written as they are and dealt once (:func:`dealt_ranks`), so choose the columns that are needed before.
    Only non-null values are dealt; rows with null keep out of it.
    """
    keys = list(keys)
    if bounded:
        cols = {rank_col: tied_rank(keys, value)}
        if size_col:
            cols[size_col] = group_size(keys, value)
        return df.withColumns(cols)
    rows = staged(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    full, sizes = dealt_ranks(rows, keys, value, rank_col, size_col or "_size", few_groups)
    empty = rows.where(F.col(value).isNull()).withColumn(rank_col, F.lit(None).cast("double"))
    if size_col:
        empty = empty.join(F.broadcast(sizes) if few_groups else sizes, keys, "left").withColumn(size_col, F.coalesce(size_col, F.lit(0)))
    out = [*df.columns, rank_col, *([size_col] if size_col else [])]
    return full.select(*out).unionByName(empty.select(*out))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], few_groups: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles per group, read off the split positions
    (two values per group and quantile); ``keys`` may be empty for the whole table."""
    keys = list(keys)
    src = df if keys else df.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    pos = split_positions(src, group, value, few_groups=few_groups or not keys)

    def pick(k):
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("cnt")), F.col(value)))
    aggs = []
    for name, share in wanted.items():
        at = (F.col("n") - 1) * F.lit(share)
        aggs += [pick(F.floor(at)).alias(f"_lo_{name}"), pick(F.ceil(at)).alias(f"_hi_{name}"),
                 F.max(at - F.floor(at)).alias(f"_f_{name}")]
    agg = pos.groupBy(*group).agg(*aggs)
    return agg.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
                               for n in wanted])
