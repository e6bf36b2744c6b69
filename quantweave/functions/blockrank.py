"""Average-tie ranks of many columns inside a group, rows kept wide.

The rows of a partition are taken in blocks of about ``BLOCK_ROWS``. Of every block, the values of one (group, column) are one packed
array. The arrays of a (group, column) meet in one task, which ranks them all and sends one packed array of ranks back for each; the other
columns of a block wait as one piece and take their ranks up there. So a value is moved once and its rank once, whatever else a row
holds, and nothing is joined or written in between.

The values of a group of more than ``range_rows`` rows are cut at quantiles into ranges first, with equal values folded to one entry
for each block, and the sizes of the ranges are counted beforehand: no task holds more than a block or a range, however many rows the group has.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# Ship the kernels with the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 65_536
#: A group of more than so many blocks of rows is cut into ranges.
RANGE_BLOCKS = 32
#: A null among the values: a NaN of its own.
NULL = np.array([0x7FF8_0000_0000_0D0D], np.uint64)
#: ``p``, ``f`` and ``k`` deal a piece: group, column and range; with ``k`` = -1 it passes on to its block ``c`` as it is.
PIECE = {"p": pa.int64(), "f": pa.int32(), "k": pa.int32(), "c": pa.int64(), "g": pa.int64(), "x": pa.binary(), "counts": pa.binary(), "rows": pa.int64()}
MERGED = {"c": pa.int64(), "g": pa.int64(), "f": pa.int32(), "k": pa.int32(), "x": pa.binary(), "n": pa.int64(), "rows": pa.int64()}


def _ddl(schema: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {({pa.int64(): 'long', pa.int32(): 'int', pa.binary(): 'binary'})[t]}" for c, t in schema.items())


def _batch(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


def _values(column: pa.ChunkedArray) -> np.ndarray:
    there = column.is_valid().to_numpy()
    x = np.array(column.fill_null(0.0).to_numpy(), "<f8")
    x.view(np.uint64)[~there] = NULL[0]
    return x


def _known(x: np.ndarray) -> np.ndarray:
    return x[~np.isnan(x)]


def _deal(columns: Sequence[str], kept: Sequence[str], block_rows: int, cuts: dict[int, list[np.ndarray]]):
    """Blocks of rows as pieces. The columns that stay follow as one piece of the block, in the order of its groups."""
    def pieces(table: pa.Table, c: int) -> Iterator[pa.RecordBatch]:
        g = table.column("_g").to_numpy()
        order = np.argsort(g, kind="stable")
        groups, starts, sizes = np.unique(g[order], return_index=True, return_counts=True)
        sink = pa.BufferOutputStream()
        stay = table.select(["_g", *kept]).take(pa.array(order))
        with pa.ipc.new_stream(sink, stay.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(stay)
        yield _batch(PIECE, [(c, -1, -1, c, 0, sink.getvalue().to_pybytes(), None, len(g))])
        small = np.array([int(i) not in cuts for i in groups])
        ends = np.concatenate([starts, [len(g)]])
        for f, name in enumerate(columns):
            x = _values(table.column(name))[order]
            cells = pa.Array.from_buffers(pa.binary(), len(groups), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(x)])
            n = len(groups)
            all_ = pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(np.full(n, f, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, c, np.int64)),
                                               pa.array(groups, pa.int64()), cells, pa.nulls(n, pa.binary()), pa.array(sizes, pa.int64())], names=list(PIECE))
            yield all_ if small.all() else all_.filter(pa.array(small))
            rows = []
            for i in np.flatnonzero(~small).tolist():
                own, group = x[ends[i]:ends[i + 1]], int(groups[i])
                v, place, count = np.unique(_known(own), return_inverse=True, return_counts=True)
                index = np.full(len(own), -1, "<i4")
                index[~np.isnan(own)] = place
                rows.append((c, f, -1, c, group, index.tobytes(), None, len(own)))
                at = [0, *np.searchsorted(v, cuts[group][f], "left").tolist(), len(v)]
                rows += [(group, f, k, c, group, v[a:b].tobytes(), count[a:b].astype("<i8").tobytes(), len(own)) for k, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
            if rows:
                yield _batch(PIECE, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            for start in range(0, batch.num_rows, block_rows):
                held.append(batch.slice(start, block_rows))
                if sum(b.num_rows for b in held) >= block_rows:
                    yield from pieces(pa.Table.from_batches(held), c)
                    c, held = c + 1, []
        if sum(b.num_rows for b in held):
            yield from pieces(pa.Table.from_batches(held), c)
    return run


def _planes(twice: np.ndarray) -> bytes:
    """The bytes of the numbers, the lowest of all first: the high ones are nearly all 0 and take no room once compressed."""
    return np.ascontiguousarray(twice.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _rank(x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Twice the average-tie rank of each value; 0 for NaN."""
    there = ~np.isnan(x)
    v, place = np.unique(x[there], return_inverse=True)
    total = np.bincount(place, None if weights is None else weights[there], len(v)).astype(np.int64)
    out = np.zeros(len(x), np.int64)
    out[there] = (2 * (np.cumsum(total) - total) + total + 1)[place]
    return out


def _merge(big: dict[int, tuple[int, np.ndarray, np.ndarray]]):
    """Ranks the pieces of one (group, column, range), which follow one another. ``big``: rows of a cut group, and of each of its
    columns the values before a range and all values."""
    def ranked(pieces: list[tuple]) -> list[tuple]:
        (p, f, k, *_), xs = pieces[0], [np.frombuffer(r[5], "<f8") for r in pieces]
        x, ends = np.concatenate(xs), np.cumsum([0, *map(len, xs)])
        if p in big:
            rows, before, totals = big[p]
            twice, n = _rank(x, np.concatenate([np.frombuffer(r[6], "<i8") for r in pieces])) + 2 * int(before[f, k]), int(totals[f])
        else:
            twice, n, rows = _rank(x), len(_known(x)), sum(r[7] for r in pieces)
        if 2 * rows >= 1 << 32:
            raise ValueError(f"a group of {rows} rows")
        if rows == 1:  # its value itself
            return [(r[3], r[4], f, k, r[5], n, rows) for r in pieces]
        return [(r[3], r[4], f, k, _planes(twice[a:b]), n, rows) for r, a, b in zip(pieces, ends, ends[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[2] < 0:
                    rows, _, totals = big.get(r[4], (r[7], None, None)) if r[1] >= 0 else (r[7], None, None)
                    out.append((r[3], r[4], r[1], r[2], r[5], 0 if totals is None else int(totals[r[1]]), rows))
                    continue
                if held and r[:3] != held[0][:3]:
                    out += ranked(held)
                    held = []
                held.append(r)
            if out:
                yield _batch(MERGED, out)
        if held:
            yield _batch(MERGED, ranked(held))
    return run


def _gather(columns: Sequence[str], schema: pa.Schema, finish: Callable):
    """The rows of a block with what ``finish`` makes of (value of a lone row, twice the rank or 0, values and rows of the group)."""
    def run(table: pa.Table) -> pa.Table:
        pieces = list(zip(*[table.column(c).to_pylist() for c in MERGED], strict=True))
        with pa.ipc.open_stream(next(r[4] for r in pieces if r[2] < 0)) as reader:
            stay = reader.read_all()
        groups, starts = np.unique(stay.column("_g").to_numpy(), return_index=True)
        span = dict(zip(groups.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(stay)], strict=True), strict=True))
        found: list[list[tuple]] = [[] for _ in columns]
        for r in pieces:
            if r[2] >= 0:
                found[r[2]].append(r)
        out = {c: stay.column(c) for c in stay.column_names if c != "_g"}
        size = len(stay)
        for f, name in enumerate(columns):
            twice, lone, n, rows, index, cut = np.zeros((4, size), np.uint8), np.full(size, np.nan), np.zeros(size, np.int64), np.ones(size, np.int64), {}, {}
            lone.view(np.uint64)[:] = NULL[0]
            for _, g, _, k, x, values, of in found[f]:
                a, b = span[g]
                n[a:b], rows[a:b] = values, of
                if k < 0:
                    index[g] = np.frombuffer(x, "<i4")
                    continue
                if of == 1:
                    lone[a:b] = np.frombuffer(x, "<f8")
                elif len(x) == 4 * (b - a) and g not in cut and k == 0:
                    twice[:, a:b] = np.frombuffer(x, np.uint8).reshape(4, -1)
                cut.setdefault(g, []).append((k, x))
            whole = np.ascontiguousarray(twice.T).view("<u4").reshape(-1).astype(np.int64)
            for g, place in index.items():
                a, b = span[g]
                parts = [np.frombuffer(x, np.uint8).reshape(4, -1) for _, x in sorted(cut.get(g, []), key=lambda p: p[0])]
                of_value = np.ascontiguousarray(np.concatenate([*parts, np.zeros((4, 1), np.uint8)], axis=1).T).view("<u4").reshape(-1)
                whole[a:b] = of_value[place]  # -1: the 0 at the end
            out |= finish(name, lone, whole, n, rows)
        return pa.table([out[c] for c in schema.names], schema=schema)
    return run


def _numbers(x: np.ndarray, there: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=~there)


def _as_ranks(name, lone, twice, n, rows):
    one = (rows == 1) & ~np.isnan(lone)
    return {f"_rank_{name}": _numbers(np.where(one, 1.0, twice / 2.0), one | (twice > 0)), f"_rank_{name}_n": pa.array(n), "_rows": pa.array(rows)}


def _as_shares(plus_one: bool, null_rank: float | None):
    def finish(name, lone, twice, n, rows):
        alone = rows == 1
        rank = np.where(alone & ~np.isnan(lone), 1.0, twice / 2.0)
        there = rank > 0
        share = rank / np.where(there, rows + 1 if plus_one else n, 1)
        if null_rank is not None:
            share, there = np.where(there, share, null_rank), np.ones(len(there), bool)
        if plus_one:
            share, there = np.where(alone, lone, share), np.where(alone, lone.view(np.uint64) != NULL[0], there)
        return {name: _numbers(share, there)}
    return finish


def _blocks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], kept: Sequence[str], kind: StructType, finish: Callable, block_rows: int, range_rows: int | None,
            sizes: DataFrame | None = None) -> DataFrame:
    keys, columns, kept = list(keys), list(columns), list(kept)
    range_rows = range_rows or RANGE_BLOCKS * block_rows
    group = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys])

    def large(of: DataFrame) -> dict[int, int]:
        return {r["_g"]: r["n"] for r in of.select(group.alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > range_rows).collect()}
    big = large(df) if sizes is None or large(sizes) else {}
    cells = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(columns)], *kept)
    names = [f"_v{i}" for i in range(len(columns))]
    cuts, offsets = _ranges(cells, names, big, range_rows) if big else ({}, {})
    dealt = cells.mapInArrow(_deal(names, kept, block_rows, cuts), _ddl(PIECE))
    merged = dealt.repartition("p", "f", "k").sortWithinPartitions("p", "f", "k").mapInArrow(_merge(offsets), _ddl(MERGED))
    return merged.groupBy("c").applyInArrow(_gather(columns, to_arrow_schema(kind), finish), kind)


def _ranges(cells: DataFrame, names: Sequence[str], big: dict[int, int], range_rows: int) -> tuple[dict, dict]:
    """Of the large groups: the cuts of each column, one for about ``range_rows`` rows, and (rows, values before each range, values)."""
    rows = cells.where(F.col("_g").isin(list(big)))
    most = -(-max(big.values()) // range_rows)
    known = [F.when(~F.isnan(c), F.col(c)) for c in names]
    at = F.array(*[F.lit(i / most) for i in range(1, most)])
    cuts = {r["_g"]: [np.unique(r[c] or []) for c in names] for r in rows.groupBy("_g").agg(*[F.percentile_approx(x, at, 100 * most).alias(c) for x, c in zip(known, names, strict=True)]).collect()}

    def count(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            g = batch.column(0).to_numpy()
            for group in np.unique(g).tolist():
                mine = total.setdefault(group, np.zeros((len(names), most), np.int64))
                for f in range(len(names)):
                    x = _known(_values(pa.chunked_array([batch.column(f + 1)]))[g == group])
                    mine[f] += np.bincount(np.searchsorted(cuts[group][f], x, "right"), minlength=most)
        for group, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), pa.array([n.ravel().tolist()], pa.list_(pa.int64()))], names=["g", "n"])
    counts = {group: np.zeros((len(names), most), np.int64) for group in big}
    parts = rows.select("_g", *names).mapInArrow(count, "g long, n array<long>").select("g", F.posexplode("n").alias("i", "n")).groupBy("g", "i").agg(F.sum("n").alias("n"))
    for r in parts.collect():
        counts[r["g"]].ravel()[r["i"]] = r["n"]
    return cuts, {group: (big[group], np.cumsum(n, axis=1) - n, n.sum(axis=1)) for group, n in counts.items()}


def block_ranks(df: DataFrame, keys: Sequence[str], columns: Sequence[str], block_rows: int = BLOCK_ROWS, range_rows: int | None = None) -> DataFrame:
    """Adds, for each column ``c``, ``_rank_c`` (average-tie rank inside ``keys``; null stays null) and ``_rank_c_n``
    (values of the group that are not null), and ``_rows`` (rows of the group).

    Defined cases: NaN counts as null; null keys form a group of their own; a column without values in a group has null ranks and size 0;
    equal rows get equal ranks; an empty table stays empty.
    """
    kind = StructType([*df.schema.fields, StructField("_rows", LongType()),
                       *[x for c in columns for x in (StructField(f"_rank_{c}", DoubleType()), StructField(f"_rank_{c}_n", LongType()))]])
    return _blocks(df, keys, columns, df.columns, kind, _as_ranks, block_rows, range_rows)


def block_shares(df: DataFrame, keys: Sequence[str], columns: Sequence[str], plus_one: bool, null_rank: float | None,
                 block_rows: int = BLOCK_ROWS, range_rows: int | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``df`` with ``columns`` replaced by their rank over the rows of the group and one (a lone row keeps its values), or over the values of the group;
    null becomes ``null_rank`` where given. The values themselves do not travel with the rows. ``sizes`` may hold the keys of all rows, and of others:
    where no group of it is large, the rows of ``df`` are not counted."""
    rest = [c for c in df.columns if c not in columns]
    kind = StructType([*[df.schema[c] for c in rest], *[StructField(c, DoubleType()) for c in columns]])
    return _blocks(df, keys, columns, rest, kind, _as_shares(plus_one, null_rank), block_rows, range_rows, sizes)
