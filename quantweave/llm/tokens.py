"""Token ids in a bit-plane shuffled, compressed container (operator 8).

The container is a Parquet folder (any file system Spark writes to, committed
task by task). A row is a chunk: whole documents of one shard in order, about
``CHUNK_IDS`` ids, and its index. The chunk's ids, unsigned 32-bit, are padded
to blocks of ``BLOCK_IDS``; every block is transposed into planes, and the equal
planes of all blocks are one zstandard frame:

    shard, chunk        place; shards follow the order of doc_id, chunks count from 0
    start, n_ids        ids of the shard before the chunk, ids of the chunk
    doc_ids, doc_ends   documents, and the end of each inside the chunk
    block_ids, layout   ids a block, "byte" or "bit" planes
    planes              4 or 32 frames, lowest first; an empty one is all zero

A reader finds a document by the index columns alone, which Parquet prunes from
the planes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantweave.llm.base import query, read
from quantweave.session import work_dir

END_ID = 0
CHUNK_IDS, BLOCK_IDS = 1 << 18, 1 << 12
#: A piece of printable ASCII without an apostrophe is cut where letters, digits and other signs meet.
PRINTED, RUNS, WORD = re.compile(r"[!-&(-~]+"), re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+"), re.compile(r"[A-Za-z]+")
LAYOUT = ("shard int, chunk int, start long, n_ids long, doc_ids array<long>, doc_ends array<long>, block_ids int, layout string, "
          "planes array<binary>")


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Byte-level BPE never merges across a blank that follows a non-blank, so such a text
    is encoded piece by piece; pieces and words repeat, and their ids are kept in
    dictionaries of bounded size. A text with runs of blanks or with the string of a
    special token goes through ``encode`` whole, and so does any other kind of tokenizer.
    """

    LIMIT = 1_000_000
    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieced = self.tokenizer.normalizer is None and type(self.splitter).__name__ == "ByteLevel" and type(self.model).__name__ == "BPE" and not self.splitter.add_prefix_space
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= self.LIMIT:
                self.words.clear()
            ids = self.words[word] = self._ids([t.id for t in self.model.tokenize(word)])
        return ids

    def _new(self, piece: str) -> bytes:
        return b"".join([self._word(word) for word, _ in self.splitter.pre_tokenize_str(piece)])

    def _learn(self, pieces: set[str]) -> None:
        """Ids of new pieces. Printed ASCII is cut here; the others all at once by the splitter: between
        pieces that neither begin nor end with white space it always cuts before the blank."""
        plain, known, word, others = [], self.pieces, self._word, []
        for p in pieces:
            if PRINTED.fullmatch(p):
                first, *rest = RUNS.findall(p)
                known[p] = word("\u0120" + first) + b"".join(map(word, rest)) if rest else word("\u0120" + first)
            elif p and p.strip() == p:
                plain.append(p)
            else:
                others.append(p)
        words, k, end = self.splitter.pre_tokenize_str(" " + " ".join(plain)) if plain else [], 0, 0
        for p in plain:
            end, first = end + 1 + len(p), k
            while k < len(words) and words[k][1][0] < end:
                k += 1
            known[p] = b"".join([word(w) for w, _ in words[first:k]])
        for p in others:
            known[p] = self._new(" " + p)

    def encode(self, text: str | None) -> np.ndarray:
        text = text or ""
        if not self.pieced or "  " in text or text[-1:].isspace() or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        first, *rest = text.split(" ")
        known = self.pieces
        missing = set(rest).difference(known)
        if missing:
            if len(known) + len(missing) > self.LIMIT:
                known.clear()
                missing = set(rest)
            self._learn(missing)
        start = self._word(first) if WORD.fullmatch(first) else self._new(first)
        return np.frombuffer(start + b"".join(map(known.__getitem__, rest)), self.dtype)


def to_planes(ids: np.ndarray, layout: str, block: int = BLOCK_IDS) -> list[bytes]:
    """Blocks transposed into byte or bit planes, each plane compressed."""
    padded = np.zeros(-(-len(ids) // block) * block, "<u4")
    padded[:len(ids)] = ids
    cells = padded.view(np.uint8).reshape(-1, block, 4).transpose(2, 0, 1)  # byte, block, id
    if layout == "bit":
        bits = np.unpackbits(np.ascontiguousarray(cells)[:, :, :, None], axis=3, bitorder="little")  # byte, block, id, bit
        cells = np.packbits(bits.transpose(0, 3, 1, 2).reshape(32, len(padded) // block, block), axis=2, bitorder="little")
    frame = zstandard.ZstdCompressor(level=3)
    return [frame.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in cells]


def from_planes(planes: list[bytes], n: int, layout: str, block: int) -> np.ndarray:
    blocks, per = -(-n // block), {"byte": 1, "bit": 8}[layout]
    size, frame = blocks * block // per, zstandard.ZstdDecompressor()
    cells = np.stack([np.frombuffer(frame.decompress(p, max_output_size=size), np.uint8) if p else np.zeros(size, np.uint8) for p in planes])
    if layout == "bit":
        bits = np.unpackbits(cells.reshape(32, blocks, block // 8), axis=2, bitorder="little").reshape(4, 8, blocks, block)
        cells = np.packbits(bits.transpose(0, 2, 3, 1), axis=3, bitorder="little").reshape(4, -1)
    return np.ascontiguousarray(cells.reshape(4, size * per).T).view("<u4").ravel()[:n]


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, layout: str = "byte", doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the container. Documents are dealt by ranges of (doc_id, text hash), so
    shards follow the order of doc_id (null first) and no id fills one shard alone.

    Defined cases: a null or empty text is the end id alone; rows that repeat are
    written as often; a text longer than a chunk makes one long chunk; an empty
    table makes an empty container; other columns are not written.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder.at(tokenizer), TaskContext.get().partitionId()
        chunk = start = held = 0
        names, parts = [], []

        def flush():
            ids = np.concatenate(parts)
            ends = np.cumsum([len(p) for p in parts])
            row = {"shard": shard, "chunk": chunk, "start": start, "n_ids": len(ids), "doc_ids": names, "doc_ends": ends.tolist(),
                   "block_ids": BLOCK_IDS, "layout": layout, "planes": to_planes(ids, layout)}
            return pa.RecordBatch.from_pylist([row], schema=ARROW)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                parts.append(np.append(encoder.encode(value).astype("<u4"), np.uint32(END_ID)))
                held += len(parts[-1])
                if held >= CHUNK_IDS:
                    yield flush()
                    chunk, start, held, names, parts = chunk + 1, start + held, 0, [], []
        if parts:
            yield flush()
    order = [F.col("doc_id"), F.xxhash64("text")]
    (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(run, LAYOUT).write.parquet(path))


ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                   ("doc_ends", pa.list_(pa.int64())), ("block_ids", pa.int32()), ("layout", pa.string()), ("planes", pa.list_(pa.binary()))])


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, int, np.ndarray]]:
    """(shard, doc_id, start inside the shard, ids) of every document of chunk rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids, at = from_planes(row["planes"], row["n_ids"], row["layout"], row["block_ids"]), 0
            for name, end in zip(row["doc_ids"], row["doc_ends"], strict=True):
                yield row["shard"], name, row["start"] + at, ids[at:end]
                at = end


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids of all earlier shards. One row for each task of the writer."""
    sizes = spark.read.schema(LAYOUT).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.select("shard", before.alias("before"))


def _read(spark: SparkSession, path: str, make, kind: str) -> DataFrame:
    chunks = spark.read.schema(LAYOUT).parquet(path)
    return chunks.mapInArrow(make, kind).join(shard_starts(spark, path), "shard").withColumn("start", F.col("start") + F.col("before")).drop("before", "shard")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) from the files; ids include the end id."""
    def run(batches):
        for shard, name, start, ids in _decoded(batches):
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "doc_id": pa.array([name], pa.int64()),
                                              "start": pa.array([start], pa.int64()), "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})
    return _read(spark, path, run, "shard int, doc_id long, start long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    def run(batches):
        for batch in batches:
            rows = [(s, d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for s, d, at, ids in _decoded([batch])]
            if rows:
                s, d, at, n, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(s, pa.int32()), "doc_id": pa.array(d, pa.int64()), "start": pa.array(at, pa.int64()),
                                                  "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})
    return _read(spark, path, run, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op8_token_planes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_dir(spark, "token-ids")
    write_ids(read(spark, sf_dir, "documents"), path)
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
