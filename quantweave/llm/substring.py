"""Exact removal of repeated word windows with a count-min prefilter (operator 3).

Pass one draws, from every window of ``window`` words, its anchor: the run of
``anchor`` words inside it with the smallest hash. An anchor position is counted
once, however many windows draw it, so a window occurs at most as often as its
anchor is counted. Each task folds its anchors into a count-min sketch, sparse
and cut into blocks; the blocks are merged block by block, and what is kept is
one bit per counter, "counted twice or more". All rows of the sketch together
have a fixed size (``rows * 2**bits / 8`` bytes), which bounds what is broadcast.

Pass two looks every window's anchor up. Windows with a count of one in any
sketch row cannot repeat and go no further. Windows found twice within one batch
of documents are settled there and send one representative; all other
windows estimated repeated are grouped exactly by 96-bit hashes of their words
over the whole corpus. A full sketch lets more windows through and loses none.

Last, the words covered by repeated windows are removed from their documents.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read

WINDOW, ANCHOR = 35, 24
SKETCH_ROWS, SKETCH_BITS, BLOCK_BITS = 2, 27, 21
BATCH_WINDOWS, BATCH_ANCHORS, FAN = 400_000, 800_000, 8
#: Fixed odd multipliers of the rolling hashes.
ROLL = 0x9E3779B97F4A7C15
ROLL2 = 0xD6E8FEB86659FD93
SALT = 0xA0761D6478BD642F
WRAP = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), words), np.uint64, len(words))


def rolling(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of each run of ``size`` values modulo 2^64: doubling, so about log2(size) passes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, run, span, factor, rest = np.zeros(n, np.uint64), 0, 1, h, 1, base, size
    while rest:
        if rest & 1:
            out = out + run[done:done + n] * np.uint64(power)
            power, done = power * factor & WRAP, done + span
        rest >>= 1
        if rest:
            run = run[:-span] + run[span:] * np.uint64(factor)
            factor, span = factor * factor & WRAP, span * 2
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def window_anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each anchor run by position, position of each window's anchor; the leftmost of equals)."""
    runs, width = mixed(rolling(h, anchor, ROLL)), window - anchor + 1
    n = len(runs) - width + 1
    if n <= 0:
        return runs, np.empty(0, np.int64)
    best, at, span = runs, np.arange(len(runs)), 1

    def lower(b1, a1, b2, a2):
        left = b1 <= b2
        return np.where(left, b1, b2), np.where(left, a1, a2)
    while span * 2 <= width:
        best, at = lower(best[:-span], at[:-span], best[span:], at[span:])
        span *= 2
    rest = width - span
    _, at = lower(best[:n], at[:n], best[rest:rest + n], at[rest:rest + n])
    return runs, at


def slots(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    salt = np.uint64(SALT * (2 * row + 1) & WRAP | 1)
    return (mixed(anchors * salt) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, window: int, anchor: int, bits: int, depth: int) -> DataFrame:
    """(row, block, repeated): one bit per counter, set if the counter is two or more."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts):
            all_anchors = np.concatenate(parts)
            for row in range(depth):
                slot, count = np.unique(slots(all_anchors, row, bits), return_counts=True)
                slot = np.repeat(slot, np.minimum(count, 2))
                cut = np.flatnonzero(np.diff(slot >> BLOCK_BITS)) + 1
                groups = np.split(slot, cut)
                yield pa.RecordBatch.from_pydict({
                    "fan": pa.array([int(all_anchors[0] % np.uint64(FAN))] * len(groups), pa.int32()), "row": pa.array([row] * len(groups), pa.int32()), "block": pa.array([int(g[0] >> BLOCK_BITS) for g in groups], pa.int32()),
                    "slots": pa.array([(g & ((1 << BLOCK_BITS) - 1)).astype("<u4").tobytes() for g in groups], pa.binary())})
        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                h = word_hashes(words_of(text), 1)
                runs, at = window_anchors(h, window, anchor)
                if len(at):
                    parts.append(runs[at[np.flatnonzero(np.diff(at, prepend=-1))]])
                    held += len(parts[-1])
            if held > BATCH_ANCHORS:
                yield from flush(parts)
                parts, held = [], 0
        if parts:
            yield from flush(parts)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, n = np.unique(np.frombuffer(b"".join(pdf["slots"]), "<u4"), return_counts=True)
        return pdf[["fan", "row", "block"]].head(1).assign(slots=np.repeat(slot, np.minimum(n, 2)).tobytes())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, n = np.unique(np.frombuffer(b"".join(pdf["slots"]), "<u4"), return_counts=True)
        repeated = np.zeros(1 << BLOCK_BITS, np.uint8)
        repeated[slot[n > 1]] = 1
        return pdf[["row", "block"]].head(1).assign(repeated=np.packbits(repeated).tobytes())

    kind = "fan int, row int, block int, slots binary"
    partials = rows.select("text").mapInArrow(partial, kind).groupBy("fan", "row", "block").applyInPandas(fold, kind)
    return partials.groupBy("row", "block").applyInPandas(merge, "row int, block int, repeated binary")


def to_runs(at: np.ndarray) -> bytes:
    """Sorted positions as (first, last) pairs of consecutive ones."""
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]], 1).astype("<i4").tobytes()


def from_runs(raw: bytes) -> np.ndarray:
    pairs = np.frombuffer(raw, "<i4").reshape(-1, 2)
    return np.concatenate([np.arange(a, b + 1) for a, b in pairs]) if len(pairs) else np.empty(0, np.int64)


WINDOWS = pa.schema([("h1", pa.int64()), ("h2", pa.int32()), ("rid", pa.int64()), ("at", pa.int32()), ("state", pa.int8()), ("runs", pa.binary())])
WINDOW_KIND = "h1 long, h2 int, rid long, at int, state byte, runs binary"


def window_rows(rows: DataFrame, bitmaps, window: int, anchor: int, bits: int, depth: int) -> DataFrame:
    """The windows estimated repeated. State 0: a window to be settled; 2: one of those settled
    in its batch, which stands for its equals; 3: ``runs`` of positions of one document settled
    in a batch. A batch is a run of documents of one task with about
    ``BATCH_WINDOWS`` such windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = bitmaps.value

        def flush(out):
            rid, h1, h2, pos = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((h2, h1))
            same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
            before, after = np.empty(len(order), bool), np.empty(len(order), bool)
            before[order], after[order] = np.r_[False, same], np.r_[same, False]
            send, settled = np.flatnonzero(~before), np.flatnonzero(before | after)
            yield pa.RecordBatch.from_arrays([
                pa.array(h1[send].view(np.int64)), pa.array((h2[send] >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(rid[send]),
                pa.array(pos[send].astype(np.int32)), pa.array(np.where(after[send], 2, 0).astype(np.int8)), pa.nulls(len(send), pa.binary())], schema=WINDOWS)
            if len(settled):
                groups = np.split(settled, np.flatnonzero(np.diff(rid[settled]) != 0) + 1)  # documents are still in their order
                ids = np.array([rid[g[0]] for g in groups])
                none = np.zeros(len(groups))
                yield pa.RecordBatch.from_arrays([
                    pa.array(mixed(ids.view(np.uint64)).view(np.int64)), pa.array(none.astype(np.int32)), pa.array(ids), pa.array(none.astype(np.int32)),
                    pa.array((none + 3).astype(np.int8)), pa.array([to_runs(np.unique(pos[g])) for g in groups], pa.binary())], schema=WINDOWS)
        out, held = [], 0
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                if len(words) < window:
                    continue
                h = word_hashes(words, 1)
                runs, at = window_anchors(h, window, anchor)
                used, inverse = np.unique(at, return_inverse=True)
                likely = np.ones(len(used), bool)
                for row in range(depth):
                    s = slots(runs[used], row, bits)
                    likely &= (tables[row][s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
                pos = np.flatnonzero(likely[inverse])
                if len(pos):
                    out.append((np.full(len(pos), rid, np.int64), rolling(h, window, ROLL)[pos], rolling(mixed(h), window, ROLL2)[pos], pos))
                    held += len(pos)
                if held > BATCH_WINDOWS:
                    yield from flush(out)
                    out, held = [], 0
        if out:
            yield from flush(out)
    return rows.select("rid", "text").mapInArrow(run, WINDOW_KIND)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h1, h2): positions of unsettled windows that have an equal, and
    settled runs as they are. The last key is carried from batch to batch, so
    no key is held whole."""
    held = None  # (rid, at) of a last row that is alone so far
    last = None
    for batch in batches:
        runs = batch.filter(pc.equal(batch.column(4), 3))
        if runs.num_rows:
            yield pa.RecordBatch.from_pydict({"rid": runs.column(2), "at": pa.nulls(runs.num_rows, pa.int32()), "runs": runs.column(5)})
        batch = batch.filter(pc.less(batch.column(4), 3))
        if not batch.num_rows:
            continue
        h1, h2, rid, at, state = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        same = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
        joins = last == (h1[0], h2[0])
        before, after = np.r_[joins, same], np.r_[same, False]
        hit = (before | after) & (state == 0)
        r, a = rid[hit], at[hit]
        if joins and held is not None:
            r, a = np.r_[held[0], r], np.r_[held[1], a]
        held = (rid[-1], at[-1]) if state[-1] == 0 and not before[-1] else None
        last = (h1[-1], h2[-1])
        yield pa.RecordBatch.from_pydict({"rid": pa.array(r.astype(np.int64)), "at": pa.array(a.astype(np.int32)), "runs": pa.nulls(len(r), pa.binary())})


def covered_runs(at: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Union of [p, p + window) as sorted (start, end) runs."""
    at = np.unique(at)
    cut = np.flatnonzero(np.diff(at) > window) + 1
    return [(int(g[0]), int(g[-1]) + window) for g in np.split(at, cut)] if len(at) else []


def strip_runs(text: str | None, at: np.ndarray | None, runs: np.ndarray | None, window: int) -> tuple[int, int, str]:
    """(words, words removed, kept words joined by blanks)."""
    words = words_of(text)
    starts = np.concatenate([np.asarray(at if at is not None else [], np.int64), *map(from_runs, runs if runs is not None else [])])
    kept, done, removed = [], 0, 0
    for start, end in covered_runs(starts, window):
        kept += words[done:start]
        removed, done = removed + end - start, end
    kept += words[done:]
    return len(words), removed, b" ".join(kept).decode("utf-8", "surrogatepass")


def repeated_positions(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, bits: int = SKETCH_BITS, depth: int = SKETCH_ROWS) -> DataFrame:
    """(rid, at, runs): starts of the repeated windows of each row that has any, single and in
    runs; ``rows`` has ``rid`` and ``text``. One shuffle by window, one by row."""
    spark = rows.sparkSession
    tables = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(depth)]
    for x in sketch(rows, window, anchor, bits, depth).toLocalIterator():  # depth * 2**bits / 8 bytes in all
        start = x.block << (BLOCK_BITS - 3)
        tables[x.row][start:start + (1 << (BLOCK_BITS - 3))] = np.frombuffer(bytes(x.repeated), np.uint8)
    found = window_rows(rows, spark.sparkContext.broadcast(tables), window, anchor, bits, depth)
    exact = found.repartition("h1").sortWithinPartitions("h1", "h2").mapInArrow(settle, "rid long, at int, runs binary")
    return exact.groupBy("rid").agg(F.collect_set("at").alias("at"), F.collect_set("runs").alias("runs"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, text)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR,
                    bits: int = SKETCH_BITS, depth: int = SKETCH_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words of repeated windows.

    Defined cases: a null text has no words; texts shorter than the window are
    left as they are; windows that repeat within one document, or overlap
    themselves, count as repeated; repeated rows repeat each other's windows; kept
    words are joined by one blank; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("rid", row_key(F.col("doc_id"), F.col("text")))

    @F.pandas_udf("n_words long, n_removed long, kept string")
    def strip(texts: pd.Series, at: pd.Series, runs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([strip_runs(*x, window) for x in zip(texts, at, runs, strict=True)], columns=["n_words", "n_removed", "kept"])
    at = repeated_positions(rows, window, anchor, bits, depth)
    return rows.join(at, "rid", "left").select("doc_id", strip("text", "at", "runs").alias("x")).select("doc_id", "x.*")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
x AS (SELECT rid, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY g) AS c FROM x) WHERE c > 1),
c AS (SELECT DISTINCT rid, i + o AS j FROM r, (SELECT unnest(range(0, {WINDOW})) AS o)),
t AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM t ANTI JOIN c USING (rid, j) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""


@query("op3_substring_dedup", ORACLE)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
