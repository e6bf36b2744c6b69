"""Benchmark decontamination by windows of the size of an item (operator 9).

Every window that holds enough shingles of the benchmark is fingerprinted (SimHash, 64 bits, running bit sums). The
fingerprints of the items of its size stand in eight tables of one byte each, under all values within two bits, so every item
within 23 bits is found (multi-index hashing), and the complete distance and then the exact weighted similarity of
the five-word shingles decide (sum of the smaller over sum of the larger counts, 0.8 or more). At 0.8 fingerprints
differ in 10 bits with a deviation of 3. A document that is shorter than the item is one window.

The index of a block of items is broadcast; its size is bounded by
``BLOCK_WORDS`` words, and a larger benchmark is searched block after block.
Documents never move: the search is one narrow pass for each block.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read, word_array
from quantweave.llm.simhash import normal_words, shingles
from quantweave.llm.substring import ROLL, mixed, rolling, word_hashes

SHINGLE = 5
#: Least similarity as a fraction, so that prefixes and bounds are whole numbers.
PART, WHOLE = 4, 5
SIMILARITY = PART / WHOLE
FILTER_BITS = 24
#: Blocks of a fingerprint, and the bits in which a block may differ: BLOCKS * (BALL + 1) - 1 bits in all are guaranteed.
BLOCKS, BLOCK_BITS, BALL = 8, 8, 2
RADIUS = BLOCKS * (BALL + 1) - 1
#: Windows fingerprinted at once.
STRETCH = 1 << 14
BLOCK_WORDS = 2_000_000


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    return mixed(rolling(word_hashes(words, 2), SHINGLE, ROLL))


def member(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the sorted array ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def prints_of(hashes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """64-bit fingerprints of the windows of ``span`` shingles at ``starts``: a bit is set if it is in more than half of
    their hashes. Running sums of the bits serve all windows; a stretch of them is held at a time."""
    out = np.empty(len(starts), np.uint64)
    for low in range(0, len(starts), STRETCH):
        some = starts[low:low + STRETCH]
        cuts = np.flatnonzero(np.diff(some) > span) + 1  # far windows share no sums
        for part, at in zip(np.split(some, cuts), np.r_[0, cuts], strict=True):
            first = int(part[0])
            bits = np.unpackbits(hashes[first:int(part[-1]) + span].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums = np.zeros((len(bits) + 1, 64), np.int32)
            np.cumsum(bits, axis=0, out=sums[1:], dtype=np.int32)
            ones = sums[part - first + span] - sums[part - first]
            out[low + at:low + at + len(part)] = np.packbits(2 * ones > span, axis=1, bitorder="little").view("<u8").ravel()
    return out


def ball(value: int, radius: int, bits: int) -> list[int]:
    """All values of ``bits`` bits within ``radius`` of ``value``."""
    return [value ^ sum(1 << b for b in flips) for r in range(radius + 1) for flips in itertools.combinations(range(bits), r)]


class SizeClass:
    """The items of one number of words. Each item stands in every block table under the values of a small Hamming ball around its
    own block: within ``RADIUS`` bits, some block differs by at most ``BALL`` of them, so one lookup for each block misses none."""

    def __init__(self, items: list[int], prints: np.ndarray):
        self.items, self.prints = np.array(items), prints
        tables: list[dict[int, list[int]]] = [{} for _ in range(BLOCKS)]
        for k, p in enumerate(prints.tolist()):
            for j, table in enumerate(tables):
                for v in ball(p >> j * BLOCK_BITS & (1 << BLOCK_BITS) - 1, BALL, BLOCK_BITS):
                    table.setdefault(v, []).append(k)
        self.tables = [{v: np.array(ks) for v, ks in t.items()} for t in tables]

    def near(self, window: int) -> np.ndarray:
        """Places of the items within ``RADIUS`` bits of a fingerprint."""
        found = [t[v] for j, t in enumerate(self.tables) if (v := window >> j * BLOCK_BITS & (1 << BLOCK_BITS) - 1) in t]
        if not found:
            return np.empty(0, np.int64)
        ks = np.unique(np.concatenate(found))
        return ks[np.bitwise_count(self.prints[ks] ^ np.uint64(window)) <= RADIUS]


class ItemIndex:
    """Items of one block; a small, read-only object for the tasks."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, w in ((i, normal_words(t)) for i, t in items) if len(w) >= SHINGLE]
        self.counts = [Counter(shingles(w, SHINGLE)) for _, w in self.items]
        hashes = [shingle_hashes(w) for _, w in self.items]
        self.known = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]))
        by_size: dict[int, list[int]] = {}
        for k, h in enumerate(hashes):
            by_size.setdefault(len(h), []).append(k)
        self.sizes = {whole: SizeClass(ks, np.concatenate([prints_of(hashes[k], np.zeros(1, np.int64), whole) for k in ks])) for whole, ks in sorted(by_size.items())}
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.known >> np.uint64(64 - FILTER_BITS)] = True

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(item, span, windows): windows whose fingerprint lies within ``RADIUS`` of the item's. Only windows that hold enough shingles of the
        benchmark to reach the similarity with any item are fingerprinted."""
        known = self.filter[hashes >> np.uint64(64 - FILTER_BITS)]
        known[known] = member(self.known, hashes[known])
        sums = np.concatenate([[0], np.cumsum(known)])
        if not sums[-1]:
            return
        for whole, size in self.sizes.items():
            span = min(whole, len(hashes))
            need = -(-PART * (whole + span) // (PART + WHOLE))
            if need > span or need > sums[-1]:
                continue
            starts = np.flatnonzero(sums[span:] - sums[:len(sums) - span] >= need)
            windows: dict[int, list[int]] = {}
            for w, p in zip(starts.tolist(), prints_of(hashes, starts, span).tolist(), strict=True):
                for k in size.near(p).tolist():
                    windows.setdefault(int(size.items[k]), []).append(w)
            for k, ws in windows.items():
                yield k, span, ws

    def hits(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the most similar window of each item found."""
        words = normal_words(text)
        if len(words) < SHINGLE or not self.items:
            return []
        out, parts = [], None
        for k, span, windows in self.candidates(shingle_hashes(words)):
            parts = parts or shingles(words, SHINGLE)
            best = best_window(parts, self.counts[k], span, windows)
            if best:
                out.append((k, (self.items[k][0], *best, span + SHINGLE - 1)))
        return [hit for _, hit in sorted(out, key=lambda x: x[0])]


def best_window(parts: list[bytes], item: Counter, span: int, windows: list[int]) -> tuple[float, int] | None:
    """(similarity, window) of the most similar of the sorted ``windows`` at 0.8 or more, the first if several tie: the sum of the smaller over the sum
    of the larger counts. Counts slide from window to window."""
    whole, best, held, both, at = item.total(), None, Counter(), 0, None
    for w in windows:
        if at is None or w - at >= span:
            held, at = Counter(parts[w:w + span]), w
            both = sum(min(n, item[g]) for g, n in held.items())
        while at < w:
            gone, new = parts[at], parts[at + span]
            both -= held[gone] <= item[gone]
            held[gone] -= 1
            both += held[new] < item[new]
            held[new] += 1
            at += 1
        score = both / (whole + span - both)
        if score >= SIMILARITY and (best is None or score > best[0]):
            best = (score, w)
    return best


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", block_words: int = BLOCK_WORDS):
    """Broadcast indexes, one for each block of at most about ``block_words`` words."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    total = items.agg(F.sum(F.size(word_array(F.col("text"))))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_words)) if total > block_words else 1
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        rows = [tuple(r) for r in part.collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(ItemIndex(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): one row for each document and item found in it.

    Defined cases: null and empty texts, and items of fewer than five words, match
    nothing; a null id is kept as null; repeated rows and repeated items each match; of equally
    similar windows the first is reported; an empty table on either side gives an empty result.
    """
    kind = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = None
    for index in item_blocks(benchmark, **kw):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in index.value.hits(t)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)],
                                                     names=["doc_id", "item_id", "similarity", "first_word", "n_words"])
        found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, kind)
        out = found if out is None else out.unionByName(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` without any benchmark item; a filter, so no row moves."""
    at = docs.columns.index(text)
    for index in item_blocks(benchmark, **kw):
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.value.hits(t) for t in batch.column(at).to_pylist()], pa.bool_()))
        docs = docs.mapInArrow(run, docs.schema)
    return docs


ORACLE = rf"""
WITH low AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i5 AS (SELECT iid, item_id, len(w) AS n, g, count(*) AS c FROM (SELECT iid, item_id, w, array_to_string(w[j:j+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS j FROM items WHERE len(w) >= {SHINGLE})) GROUP BY ALL),
d5 AS (SELECT rid, doc_id, len(w) AS size, j - 1 AS j, array_to_string(w[j:j+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS j FROM low WHERE len(w) >= {SHINGLE})),
h AS (SELECT rid, doc_id, size, iid, item_id, n, j, g, c FROM d5 JOIN i5 USING (g)),
s AS (SELECT DISTINCT rid, iid, j - o AS s FROM (SELECT rid, iid, size, n, j, unnest(range(0, n - {SHINGLE - 1})) AS o FROM h) WHERE j - o BETWEEN 0 AND size - n),
m AS (SELECT rid, doc_id, iid, item_id, n, s, g, least(count(*), any_value(c)) AS b FROM s JOIN h USING (rid, iid) WHERE j BETWEEN s AND s + n - {SHINGLE} GROUP BY ALL),
v AS (SELECT rid, doc_id, iid, item_id, n, s, (sum(b) / (2 * (n - {SHINGLE - 1}) - sum(b)))::DOUBLE AS sim FROM m GROUP BY rid, doc_id, iid, item_id, n, s)
SELECT doc_id, item_id, max(sim) AS similarity, arg_min(s, [-sim, s])::BIGINT AS first_word, any_value(n)::BIGINT AS n_words
FROM v WHERE sim >= {SIMILARITY} GROUP BY rid, doc_id, iid, item_id"""


@query("op9_benchmark_decontamination", ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
