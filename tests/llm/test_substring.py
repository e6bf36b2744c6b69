import hashlib

import pytest
from plain import DATA, frame, odd_rows, strip_repeats
from pyspark.sql import functions as F

from quantweave.llm import substring as X


@pytest.mark.parametrize("bits", [22, 27])
def test_odd_rows(spark, bits):
    rows = odd_rows() + [(30, "pad " + " ".join(f"q{i}" for i in range(35)) + " end"), (31, " ".join(f"q{i}" for i in range(35))), (32, " ".join(f"q{i}" for i in range(34)))]
    got = X.without_repeats(frame(spark, rows, clash=True), bits=bits).collect()
    want = [(d, *x) for (d, _), x in zip(rows, strip_repeats(rows, 35), strict=True)]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert X.without_repeats(frame(spark, rows).limit(0), bits=bits).count() == 0


def test_query_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {d: (n, m, hashlib.sha256(k.encode()).hexdigest()) for (d, _), (n, m, k) in zip(docs, strip_repeats(docs, 35), strict=True)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in X.op3(spark, DATA).collect()}
    assert got == want


def test_anchors_are_window_minima():
    import numpy as np
    h = np.random.default_rng(1).integers(0, 1 << 63, 300).astype(np.uint64)
    runs, at = X.window_anchors(h, 35, 24)
    assert len(at) == 300 - 34
    for i, a in enumerate(at):
        assert a == i + int(np.argmin(runs[i:i + 12]))


def test_full_sketch_loses_nothing(spark):
    # a sketch of few counters lets every window through
    rows = [(i, " ".join(f"w{(i * 7 + j) % 500}" for j in range(120))) for i in range(60)]
    small, X.BLOCK_BITS = X.BLOCK_BITS, 8
    try:
        got = X.without_repeats(frame(spark, rows), bits=8).select("doc_id", "n_removed", F.col("kept")).collect()
    finally:
        X.BLOCK_BITS = small
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got) == [(d, m, k) for (d, _), (_, m, k) in zip(rows, strip_repeats(rows, 35), strict=True)]
