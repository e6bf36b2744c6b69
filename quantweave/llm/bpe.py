"""Token counts by heap-and-linked-list pair merging (operator 13).

A word starts as a doubly linked list of symbols. A heap holds every adjacent pair
that has a merge rank; the lowest rank (leftmost first) is popped, joined, and the
two new neighbour pairs are pushed. A pair whose place has changed since is skipped.
The word's tokens are its first symbols minus the joins, so no identifier is made.
A word of n symbols costs n log n, however long it is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantweave.llm.base import query, read

LIMIT = 512
#: A piece of printable ASCII without an apostrophe is cut where letters, digits and other signs meet.
PRINTED, RUNS = re.compile(r"[!-&(-~]+"), re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
OUTPUT = "doc_id long, n_bytes long, n_tokens long"


class Merges:
    """Merge ranks of a byte-pair vocabulary: ``rank[a, b]`` is (rank, joined symbol)."""

    def __init__(self, pairs: Iterable[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.rank = {(a, b): (i, a + b) for i, (a, b) in enumerate(pairs)}

    def count(self, word: str) -> int:
        """Symbols of ``word`` that remain when no pair can be joined any more."""
        n = len(word)
        if n < 2:
            return n
        symbol = list(word)
        symbol[-1] += self.suffix
        find = self.rank.get
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        # What the pair that starts here would become; None also where the pair is gone.
        pending = [find(p) for p in zip(symbol, symbol[1:])]
        pending.append(None)
        heap = [p[0] * n + i for i, p in enumerate(pending) if p]
        heapify(heap)
        joins = 0
        while heap:
            rank, i = divmod(heappop(heap), n)
            now = pending[i]
            if now is None or now[0] != rank:
                continue
            joins += 1
            symbol[i] = now[1]
            gone = right[i]
            after = right[i] = right[gone]
            pending[gone] = None
            if after < n:
                left[after] = i
                new = pending[i] = find((symbol[i], symbol[after]))
                if new:
                    heappush(heap, new[0] * n + i)
            else:
                pending[i] = None
            before = left[i]
            if before >= 0:
                new = pending[before] = find((symbol[before], symbol[i]))
                if new:
                    heappush(heap, new[0] * n + before)
        return n - joins


class TokenCounter:
    """Counts tokens as ``Tokenizer.encode(text, add_special_tokens=False)`` would make them.

    The library cuts a text into words (its normalizer and pre-tokenizer); the merging is done here.
    Strings of added tokens count one each. A byte-level splitter always cuts before a
    blank that follows a non-blank, so most texts are looked up blank by blank; the counts
    of pieces are kept in a dictionary of bounded size.
    """

    KEPT = 600_000
    _made: dict[str, "TokenCounter"] = {}

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model.get("ignore_merges"):
            raise ValueError(f"{path}: not a plain byte-pair vocabulary")
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError(f"{path}: added tokens that take white space or normalized text")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges(pairs, model["end_of_word_suffix"] or "")
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.added = re.compile("|".join(map(re.escape, sorted((t.content for t in added), key=len, reverse=True))) or r"(?!)")
        self.pieced = self.normalizer is None and type(self.splitter).__name__ == "ByteLevel" and not self.splitter.add_prefix_space
        self.strings = [t.content for t in added]
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    @classmethod
    def at(cls, path: str) -> "TokenCounter":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merges.count(word)
            if len(word) < 64:
                if len(self.words) >= self.KEPT:
                    self.words.clear()
                self.words[word] = n
        return n

    def _span(self, text: str) -> int:
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        return sum([self._word(w) for w, _ in self.splitter.pre_tokenize_str(text)])

    def _whole(self, text: str) -> int:
        spans = self.added.split(text)
        return len(spans) - 1 + sum([self._span(s) for s in spans if s])

    def _learn(self, pieces: set[str]) -> None:
        """Counts of new pieces, each after a blank. Printed ASCII is cut here; other pieces without white space at
        their ends are cut together by the splitter, and the words dealt back by their places."""
        plain, known, word, others = [], self.pieces, self._word, []
        for p in pieces:
            if PRINTED.fullmatch(p):
                first, *rest = RUNS.findall(p)
                known[p] = word("\u0120" + first) + sum(map(word, rest)) if rest else word("\u0120" + first)
            elif p and p.strip() == p:
                plain.append(p)
            else:
                others.append(p)
        words, k, end = self.splitter.pre_tokenize_str(" " + " ".join(plain)) if plain else [], 0, 0
        for p in plain:
            end, n = end + 1 + len(p), 0
            while k < len(words) and words[k][1][0] < end:
                n += word(words[k][0])
                k += 1
            known[p] = n
        for p in others:
            known[p] = self._span(" " + p)

    def count(self, text: str) -> int:
        if not self.pieced or "  " in text or text[-1:].isspace() or any(x in text for x in self.strings):
            return self._whole(text)
        first, *rest = text.split(" ")
        known = self.pieces
        missing = set(rest).difference(known)
        if missing:
            if len(known) + len(missing) > self.KEPT:
                known.clear()
                missing = set(rest)
            self._learn(missing)
        return self._span(first) + sum(map(known.__getitem__, rest))


def count_tokens(docs: DataFrame, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row for each input row, no shuffle.

    ``tokenizer`` is a byte-pair vocabulary of the tokenizers library (byte-level, or with word ends).

    Defined cases: a null or empty text has no bytes and no tokens; a null doc_id stays null;
    repeated rows are counted each; a text is counted whole, whatever its length; other columns
    are not read; an empty table gives an empty result.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter.at(tokenizer).count
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([count(t.as_py()) for t in batch.column(1)], pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes")).mapInArrow(run, OUTPUT)


@query("op13_heap_token_counts")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
