"""Plain Python forms of the operators, and small tables, for the tests."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names an operator may want to use itself.
CLASH = ["n_words", "kept", "_row", "_text", "row", "rid", "k", "n", "fp", "stratum", "copies", "row_key", "block", "p", "size", "at"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return WORD.findall(text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, clash=False):
    """Documents from (doc_id, text) or longer rows; with ``clash`` columns of awkward names."""
    full = [(*r, *["en", "s", None][len(r) - 2:]) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit(f"x_{c}").alias(c) for c in CLASH]) if clash else df


def odd_rows():
    body = " ".join(f"word{i % 97}x{i % 13}" for i in range(400))
    return [(1, body), (1, body), (2, None), (3, ""), (4, " \n\t "), (None, body), (None, None), (5, "one"), (6, "two words"), (7, "Ünï cödé 😀 " * 30),
            (8, "very " * 30_000), (9, body + " tail"), (10, "a\n\n  b \x0b c  "), (11, "#$%&|<>*" * 20), (12, " ".join(f"u{i}" for i in range(8000)))]


def ngrams(ws, n):
    return [tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)]


class Sets:
    """Union by smallest member."""

    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def strip_repeats(docs, window):
    """(words, removed, kept text) of each document, by counting whole windows."""
    seen = Counter(g for _, t in docs for g in ngrams(words(t), window))
    out = []
    for _, t in docs:
        ws, gone = words(t), set()
        for i, g in enumerate(ngrams(ws, window)):
            if seen[g] > 1:
                gone.update(range(i, i + window))
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def similar_groups(docs, k=5, least=0.8):
    """doc index -> group by Jaccard similarity of k-word shingles, over all pairs that share one."""
    sets = []
    for _, t in docs:
        ws = low(t).encode().split()
        sets.append({tuple(ws)} if 0 < len(ws) <= k else set(ngrams(ws, k)))
    by, groups, texts = defaultdict(list), Sets(), {}
    for i, s in enumerate(sets):
        groups.find(i)
        groups.join(i, texts.setdefault(docs[i][1] or "", i))
        for g in s:
            by[g].append(i)
    done = set()
    for members in by.values():
        for a in members:
            for b in members:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                        groups.join(a, b)
    return [groups.find(i) for i in range(len(docs))]
