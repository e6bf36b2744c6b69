"""Token counts by pair merging, against the library."""

import random

import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quantweave.llm.bpe import Merges, TokenCounter, count_tokens

PARTS = ["a", "b", "the", "'s", "'ll", " ", "  ", "\n", "\t", "é", "日本", "😀", "1", "23", ".", "!!", "<|endoftext|>", "<|startoftext|>", " ", " ", " ", "\x0b",
         "A", "İ", "ß", "zzz", "\x85", "　", "é"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts_equal_the_library(name):
    path = public_tokenizers.path(name)
    counter, library = TokenCounter(path), Tokenizer.from_file(path)
    rnd = random.Random(2)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_merges_by_hand():
    m = Merges([("b", "c"), ("a", "b"), ("a", "bc"), ("a", "a")])
    assert [m.count(w) for w in ("", "a", "abc", "aaa", "aaaa", "abab", "xyz", "abcabc")] == [0, 1, 1, 2, 2, 2, 3, 2]


def test_other_vocabularies_are_refused(tmp_path):
    from tokenizers import models
    path = tmp_path / "words.json"
    Tokenizer(models.WordLevel({"a": 0}, unk_token="a")).save(str(path))
    with pytest.raises(ValueError):
        TokenCounter(str(path))


def test_count_tokens_odd_rows(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = plain.odd_rows() + [(20, "ab" * 40_000), (21, "x <|endoftext|> y<|endoftext|>"), (22, " " * 5000)]
    got = sorted(map(tuple, count_tokens(plain.frame(spark, rows, clash=True)).collect()), key=str)
    assert got == sorted([(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in rows], key=str)
    assert count_tokens(plain.frame(spark, [])).collect() == []


def test_query_against_the_library(spark):
    from quantweave.llm.registry import QUERIES
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{plain.DATA}/documents.parquet").collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = QUERIES["op13_heap_token_counts"](spark, plain.DATA).collect()
    assert len(out) == len(docs)
    for r in out:
        n = len(library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 512, len((docs[r["doc_id"]] or "").encode()))
