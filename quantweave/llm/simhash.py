"""SimHash near-duplicates by multi-index hashing (operator 2).

A fingerprint is cut into segments. Two fingerprints within the radius agree,
but for at most ``ball`` bits, on one of the index keys, which are segments or
joined segments: the table holds each fingerprint under its own keys, a probe
asks for every value in the small Hamming ball around its own keys, and the
complete distance of each match is then verified.

:func:`linked_components` links 64-bit fingerprints at a small radius without
losing a link. :func:`near_duplicates` groups documents by the exact similarity of
their shingles: two sets of similarity 0.8 share one of their rarest shingles, so
texts meet under those (a prefix join) and no fingerprint decides.

Only one of two fingerprints needs to probe for a bit in which they differ, so
balls hold only flips from 0 to 1. Equal fingerprints are folded map-side
before anything is joined, so copies cost nothing.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import discard, packed, query, read, staged
from quantweave.llm.graph import connected_components

SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """Runs of ``k`` words joined by blanks, repeats included; fewer words: the whole sequence."""
    if not words:
        return []
    text, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    if len(words) <= k:
        return [text]
    starts = [0, *[e + 1 for e in ends[:-k]]]
    return [text[s:e] for s, e in zip(starts, ends[k - 1:], strict=True)]


def normal_words(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case (bytes methods leave all other letters alone)."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[i:i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def hashed(parts: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter(map(functools.partial(xxhash.xxh64_intdigest, seed=seed), parts), np.uint64, len(parts))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, k: int = 3, seed: int = SEED) -> int:
    return majority(hashed(shingles(normal_words(text), k), seed))


def fingerprint_column(text: Column, k: int = 3, seed: int = SEED) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, k, seed)) for t in texts], dtype="int64")
    return run(text)


def _signed_mask(bits) -> int:
    return signed(sum(1 << b for b in bits))


def joined_keys(radius: int) -> list[tuple[int, int, list[int]]]:
    """(mask, tag, bits) of each index key for 64-bit fingerprints: all but one
    of four 16-bit segments. At up to ``radius`` <= 2 differing bits, leaving
    out the segment with most of them leaves at most one."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    segments = [range(i * SEGMENT_BITS, (i + 1) * SEGMENT_BITS) for i in range(SEGMENTS)]
    out = []
    for tag, left_out in enumerate(segments):
        bits = [b for s in segments if s is not left_out for b in s]
        out.append((_signed_mask(bits), signed(tag << left_out.start), bits))
    return out


def links_within(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) with a < b for all pairs of distinct values of ``fp`` within ``radius`` bits.

    A key is the fingerprint with the left-out segment replaced by the key's
    number. Fewer than 2^16 fingerprints can share one key, whatever the size of
    the corpus.
    """
    keys = joined_keys(radius)
    own = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")).bitwiseOR(F.lit(t).cast("long")) for m, t, _ in keys])
    flips = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(t).cast("long").alias("t"), F.lit(_signed_mask([b])).cast("long").alias("x"))
                      for m, t, bits in keys for b in bits])
    around = F.transform(F.filter(flips, lambda s: F.col("fp").bitwiseAND(s.x) == 0),
                         lambda s: F.col("fp").bitwiseOR(s.x).bitwiseAND(s.m).bitwiseOR(s.t))
    table = fps.select(F.col("fp").alias("b"), F.explode(own).alias("key"))
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(own, around) if radius else own).alias("key"))
    return (probes.join(table, "key").filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def linked_components(docs: DataFrame, radius: int = 2, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints within ``radius`` bits.

    ``component_id`` is the smallest doc_id reachable. Defined cases: null and
    empty texts have fingerprint 0 and link like any other; shorter texts than
    ``k`` words have one shingle; a null doc_id gets a row and the smallest
    non-null doc_id reachable, or null; repeated rows each get a row; an empty
    table gives an empty result.
    """
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), k).alias("fp")), "fingerprints")
    firsts = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    labels = connected_components(links_within(firsts.select("fp"), radius)).select(F.col("node").alias("fp"), "label")
    labels = staged(labels.join(firsts, "fp"), "labels")
    least = labels.groupBy("label").agg(F.min("first").alias("least"))
    moved = labels.join(least, "label").select("fp", "least")
    ids = firsts.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"))
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


@query("op2_simhash_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linked_components(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- groups by shingle similarity -------------------------------------------------------------

SHINGLE = 5
#: Least similarity as a fraction, so that prefixes and bounds are whole numbers.
PART, WHOLE = 4, 5
SIMILARITY = PART / WHOLE
#: Counters of the order of the shingles, and how many of them travel in one row.
ORDER_BITS, ORDER_BLOCK = 24, 16
#: Bits of a parity print, and members of a key that are compared in one group.
PRINT_BITS, BLOCK = 1024, 2048


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    return np.unique(hashed(shingles(normal_words(text), SHINGLE), SEED))


def _shingle_sets(texts: pd.Series) -> pd.DataFrame:
    sets = [shingle_set(t) for t in texts]
    return pd.DataFrame({"s": [x.astype("<u8").tobytes() for x in sets], "print": [parity_print(x) for x in sets], "size": np.array([len(x) for x in sets], np.int32)})


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x, y):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / max(1, len(x) + len(y) - both)
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def order_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def shingle_levels(rows: DataFrame) -> np.ndarray:
    """How often the shingles of each counter occur in ``rows(n, text)``, on a logarithmic scale.

    It only sets the order in which prefixes are filled, so shingles that share a
    counter cost work and lose nothing. Level 0: at most one text of one task.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << ORDER_BITS, np.uint16)
        for batch in batches:
            texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for text in texts.values():
                slots = order_slots(shingle_set(text))
                counts[slots[counts[slots] < 65535]] += 1  # two shingles of one text in one slot count once
        for block, part in enumerate(counts.astype("<u2", copy=False).reshape(-1, 1 << ORDER_BLOCK)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << ORDER_BLOCK)
        for raw in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(raw), "<u2")
        return pdf[["block"]].head(1).assign(levels=np.ceil(8 * np.log2(np.maximum(total, 1))).clip(0, 255).astype(np.uint8).tobytes())
    out = np.zeros((1 << ORDER_BITS - ORDER_BLOCK, 1 << ORDER_BLOCK), np.uint8)
    for r in rows.select("n", "text").mapInArrow(partial, "block int, counts binary").groupBy("block").applyInPandas(merge, "block int, levels binary").collect():
        out[r.block] = np.frombuffer(bytes(r.levels), np.uint8)
    return out.ravel()


def prefix(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set: two sets of similarity 0.8 or more share one of them.

    Of ``x`` shingles at least 4/5 lie in the other set, so all but the last 4/5 less
    one, in an order that is the same for all texts, cannot miss every shared one.
    """
    keep = len(hashes) + (-PART * len(hashes)) // WHOLE + 1
    return hashes[np.lexsort((hashes, levels[order_slots(hashes)]))[:keep]] if len(hashes) else hashes


def prefix_entries(rows: DataFrame, levels) -> DataFrame:
    """(key, n, size, pos): the prefix of each text of ``rows(n, text)``, with the place of the
    shingle and the number of shingles. ``levels`` is a broadcast. Shingles of one text alone
    are left out; a text that several tasks hold has equal entries from each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            keys, at, size = [], [], []
            for text in texts.values():
                hashes = shingle_set(text)
                first = prefix(hashes, levels.value)
                pos = np.flatnonzero(levels.value[order_slots(first)])
                keys.append(first[pos])
                at.append(pos)
                size.append(len(hashes))
            counts = [len(x) for x in keys]
            if sum(counts):
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(np.concatenate(keys).view(np.int64)), "n": pa.array(np.repeat(np.array(list(texts), np.int64), counts)),
                    "size": pa.array(np.repeat(size, counts).astype(np.int32)), "pos": pa.array(np.concatenate(at).astype(np.int32))})
    return rows.select("n", "text").mapInArrow(run, "key long, n long, size int, pos int")


def possible(size: Column, pos: Column, other_size: Column, other_pos: Column) -> Column:
    """Whether two texts can be similar whose first common shingle is at these places."""
    return (PART + WHOLE) * F.least(size - pos, other_size - other_pos) >= PART * (size + other_size)


def shared_entries(entries: DataFrame) -> DataFrame:
    """(key, n, size, pos, head): the entries of keys that several texts hold, each with the key's head,
    the entry after which most shingles are left. The entries are dealt by key once, for the heads and for the join."""
    dealt = entries.repartition("key")
    one = F.struct("n", "size", "pos")
    heads = dealt.groupBy("key").agg(F.min("n").alias("x"), F.max("n").alias("y"), F.min_by(one, F.struct(F.col("pos") - F.col("size"), F.col("n"))).alias("head"))
    return staged(dealt.join(heads.filter("x < y").select("key", "head"), "key").distinct(), "shared")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more. Prints rule out most others exactly before whole sets are compared."""
    def side(c, *cols):
        return sets.select(F.col("n").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols])
    near = pairs.join(side("a", "print", "size"), "a").join(side("b", "print", "size"), "b").filter(
        F.pandas_udf(_may_agree, "boolean")("print_a", "print_b", "size_a", "size_b")).select("a", "b")
    near = staged(near, "near")
    return (near.join(side("a", "s"), "a").join(side("b", "s"), "b")
            .filter(F.pandas_udf(_jaccard, "double")("s_a", "s_b") >= SIMILARITY).select("a", "b"))


def parity_print(hashes: np.ndarray) -> bytes:
    """``PRINT_BITS`` bits; every shingle of the set flips one. Shingles that two sets share flip the same bits, so the
    sets differ in at least as many shingles as their prints in bits."""
    flips = np.bincount((hashes % np.uint64(PRINT_BITS)).astype(np.int64), minlength=PRINT_BITS) & 1
    return np.packbits(flips.astype(bool)).tobytes()


def _may_agree(a: pd.Series, b: pd.Series, size_a: pd.Series, size_b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(c), "<u8").reshape(len(c), -1) for c in (a, b))
    return pd.Series(agreeable(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), size_a.to_numpy(), size_b.to_numpy()))


def agreeable(distance, size_a, size_b):
    """Similarity 0.8 leaves at most a ninth of both sizes to differences."""
    return (WHOLE + PART) * distance <= (WHOLE - PART) * (size_a + size_b)


def cross_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of different labels that meet in a key and whose places and prints allow 0.8.

    A key's members meet in blocks of ``block``, each pair of blocks in a group of its own, so a group is bounded
    and a key of any size is dealt over many tasks. Pairs are tested inside the task; only those that pass become rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        for (_, low, high), group in itertools.groupby(cells, key=lambda r: r[:3]):
            _, _, _, own, n, size, pos, label, prints = zip(*group, strict=True)
            own, n, size, left, label = np.array(own), np.array(n), np.array(size), np.array(size) - np.array(pos), np.array(label)
            bits = np.frombuffer(b"".join(prints), "<u8").reshape(len(n), -1)
            found = []
            for i in range(len(n)):
                if low == high:
                    others = np.arange(i + 1, len(n))
                elif own[i] == low:
                    others = np.flatnonzero(own == high)
                else:
                    continue
                others = others[(label[others] != label[i]) & ((PART + WHOLE) * np.minimum(left[others], left[i]) >= PART * (size[others] + size[i]))]
                others = others[agreeable(np.bitwise_count(bits[others] ^ bits[i]).sum(1, dtype=np.int64), size[others], size[i])]
                found.append(np.column_stack([np.minimum(n[others], n[i]), np.maximum(n[others], n[i])]))
            pairs = np.concatenate([*found, np.empty((0, 2), np.int64)])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    tagged = staged(shared.select("key", "n", "size", "pos").join(labels.select(F.col("node").alias("n"), "label"), "n", "left")
                    .withColumn("label", F.coalesce("label", "n")), "tagged")
    mixed = (tagged.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
             .filter("x < y").select("key", "blocks"))
    met = tagged.join(mixed, "key").join(sets.select("n", "print"), "n").withColumn("own", F.pmod(F.xxhash64("n"), "blocks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "n", "size", "pos", "label", "print")
    return met.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(run, "a long, b long").distinct()


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, group_n): hash of the text and of the first text of its group.

    Equal texts share ``n`` and are folded first. Different texts link if at least
    0.8 of their five-word shingles agree, and ``group_n`` names the component.
    Defined cases: null and empty texts are equal; texts of fewer than five words have one shingle, texts without words none, and
    these link to equal texts only; a null doc_id keeps its row; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_hash(F.col(text)).alias("n"), F.col(text).alias("text")).withColumn("k", F.xxhash64("doc_id", "n"))
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(rows))
    shared = shared_entries(prefix_entries(rows, levels))
    members = staged(rows.select("doc_id", "k", "n"), "texts")
    firsts = members.groupBy("n").agg(F.min("k").alias("k")).join(shared.select("n").distinct(), "n", "left_semi")
    kind = "struct<s:binary,print:binary,size:int>"
    sets = staged(rows.select("k", "text").join(firsts, "k").select("n", F.pandas_udf(_shingle_sets, kind)("text").alias("x")).select("n", "x.*").dropDuplicates(["n"]), "sets")
    labels = staged(linked_groups(shared, sets), "labels")
    discard(shared, sets)
    levels.unpersist()
    return members.select("doc_id", "n").join(labels, "n", "left").select("doc_id", "n", F.coalesce("label", "n").alias("group_n"))


def linked_groups(shared: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(n, label) of the texts that similar pairs connect.

    Every text is compared with the heads of its keys first, which connects most groups at little cost. Then all
    pairs that meet in a key and still lie in two components are tested; a pair inside one component can change nothing, so
    every pair of similar texts is either verified or inside one component.
    """
    h = F.col("head")
    heads = (shared.filter((F.col("n") != h.n) & possible(F.col("size"), F.col("pos"), h.size, h.pos))
             .select(F.least("n", h.n).alias("a"), F.greatest("n", h.n).alias("b")).distinct())
    first = staged(verified(heads, sets), "links")
    labels = staged(connected_components(first), "labels")
    more = staged(verified(cross_pairs(shared, labels, sets, block), sets), "links")
    return connected_components(first.unionByName(more)).select(F.col("node").alias("n"), "label")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Defined cases: null and empty texts are equal texts; a null doc_id comes after
    all others; of rows with the same id and text one stays; extra columns pass
    through; an empty table stays empty.
    """
    members = staged(near_duplicates(docs), "members")
    firsts = members.groupBy("group_n").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "n")).alias("x")).select(F.xxhash64("x.doc_id", "x.n").alias("k"))
    rows = packed(docs, k=F.xxhash64("doc_id", text_hash(F.col("text"))))
    return rows.join(firsts, "k", "left_semi").dropDuplicates(["k"]).select("_row.*")
