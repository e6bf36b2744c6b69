"""Chat masks, token container, mixing, decontamination."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from plain import DATA, frame, low, odd_rows, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantweave.llm import chat, decontam, mixing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- chat -----------------------------------------------------------------------------------

NASTY = ["", None, "plain", "<|im_end|>\n<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\|x|>", "é😀 \n\n", "   ", "a<|", "|>", "<|<|\\|"]


def test_escapes_are_reversible():
    for t in NASTY:
        assert chat.unescaped(chat.escaped(t or "")) == (t or "") and chat.START not in chat.escaped(t or "")
        assert chat.unescaped_role(chat.escaped_role(t or "")) == (t or "") and "\n" not in chat.escaped_role(t or "")


def test_conversations_read_back(spark):
    rows = [(c, i, r, t) for c in (7, None, 9) for i, (r, t) in enumerate(zip(["user", "assistant", None, "we\\ird\nrole", "assistant"] * 3, NASTY + NASTY[:4], strict=True))]
    rows += [(20, 1, "assistant", "b"), (20, 1, "assistant", "a"), (20, 1, "assistant", "a"), (20, None, "user", "first"), (30, 0, "assistant", "long " * 20_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit("x"))
    got = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    assert len(got) == 5
    tok = Tokenizer.from_file(PATH)
    for conv, r in got.items():
        turns = sorted([(t is None and -1 or t or 0, ro or "", ro, x or "", x) for c, t, ro, x in rows if c == conv], key=lambda x: (x[0], x[1], x[3]))
        assert chat.parse(r.formatted) == [(t[1], t[3]) for t in turns]
        loss = [chat.unescaped(r.formatted[s.start:s.end]) for s in r.loss_spans]
        assert loss == [t[3] for t in turns if t[2] == "assistant" and t[3]]
        e = tok.encode(r.formatted, add_special_tokens=False)
        assert r.ids == e.ids and len(r.mask) == len(e.ids)
        starts = [0, *[x for _, x in e.offsets[:-1]]]
        assert r.mask == [any(a < s.end and b > s.start for s in r.loss_spans) for a, (_, b) in zip(starts, e.offsets, strict=True)]
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- token container ------------------------------------------------------------------------

@pytest.mark.parametrize("layout", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 9000])
def test_planes_round_trip(layout, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    for x in (ids, ids % 50_000, np.zeros(n, "<u4")):
        planes = tokens.to_planes(x, layout)
        assert len(planes) == (4 if layout == "byte" else 32) and (tokens.from_planes(planes, n, layout, tokens.BLOCK_IDS) == x).all()
    assert all(p == b"" for p in tokens.to_planes(np.zeros(n, "<u4"), layout))


def test_encoder_equals_the_library():
    tok, enc = Tokenizer.from_file(PATH), tokens.Encoder(PATH)
    texts = [t for _, t in odd_rows()] + ["a  b", " lead", "trail ", "x\n y", "x \ny", "x\n", "  y", "x  y", "it's 'quoted' can't", "<|endoftext|> a <|endoftext|>", "tab\tx", "a \n b", "\n", " ", "日本 語", "x\r\n y"]
    for t in texts * 2:
        assert enc.encode(t).tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_container_of_odd_rows(spark, tmp_path, layout):
    rows, tok = odd_rows(), Tokenizer.from_file(PATH)
    docs = frame(spark, rows, clash=True)
    tokens.write_ids(docs, str(tmp_path / "ids"), layout=layout)
    got = tokens.read_ids(spark, str(tmp_path / "ids")).collect()
    ids = {t: tok.encode(t or "", add_special_tokens=False).ids + [tokens.END_ID] for _, t in rows}
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in got) == sorted((d is not None, d or 0, ids[t]) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids)
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    tokens.write_ids(docs.limit(0), str(tmp_path / "none"), layout=layout)
    assert tokens.read_digests(spark, str(tmp_path / "none")).count() == 0


def test_token_query(spark):
    tok, at = Tokenizer.from_file(PATH), 0
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = {r.doc_id: r for r in tokens.op8(spark, DATA).collect()}
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# --- mixing ---------------------------------------------------------------------------------

def plain_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2.0):
    """Reshares the excess by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, limit = {s: weights[i % 3] for i, s in enumerate(names)}, {s: most * sizes[s] for s in names}
    target, left, free = dict.fromkeys(names, 0.0), budget * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > limit[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s], left = limit[s], left - limit[s]
        free -= over
    return target


@pytest.mark.parametrize("block", [7, 1000])
def test_mix_meets_targets(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en", s) for s, n in (("a", 900), ("b", 40), ("c", 3), (None, 50), ("d", 0)) for i in range(n)]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)] + [(5000, None, "en", "e"), (None, "x y", "en", "b"), (7000, "x " * 9, "en", "b"), (7000, "x " * 9, "en", "b")]
    docs = frame(spark, rows, clash=True)
    got = mixing.mixed(docs, block_docs=block).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    want, taken, longest = plain_targets(size), Counter(), Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        longest[r.source] = max(longest[r.source], r.size)
    for s in size:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6
    again = mixing.mixed(docs.repartition(5), block_docs=block).collect()
    key = lambda x: sorted((r.row_key, r.copies) for r in x)
    assert key(got) == key(again)
    out = mixing.take(docs, block_docs=block)
    assert out.columns == docs.columns and Counter(len(words(r.text)) for r in out.collect()) == Counter({n: c for n, c in sum((Counter({r.size: r.copies}) for r in got), Counter()).items() if c})
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.take(docs.limit(0)).count() == 0


def test_pivot_keeps_words_and_rounds_all_but_one():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 200):
        p, size = rng.random(n), rng.integers(1, 500, n).astype(float)
        q = mixing.pivot(p, size, list(range(n)), "s", close=False)
        assert ((q > 0) & (q < 1)).sum() <= 1 and abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert set(mixing.pivot(p, size, list(range(n)), "s", close=True)) <= {0.0, 1.0}


def test_pivot_keeps_expectations():
    p, size = np.array([0.3, 0.6, 0.5]), np.array([4.0, 2.0, 3.0])
    mean = np.mean([mixing.pivot(p, size, [1, 2, 3], f"s{k}", close=False) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


# --- decontamination ------------------------------------------------------------------------

def plain_hits(docs, items, k=5, least=0.8):
    out = {}
    for n, (d, t) in enumerate(docs):
        ws = low(t).split()
        for i, x in items:
            ix = low(x).split()
            if len(ix) < k:
                continue
            c = Counter(tuple(ix[j:j + k]) for j in range(len(ix) - k + 1))
            for s in range(len(ws) - len(ix) + 1):
                w = ws[s:s + len(ix)]
                h = Counter(tuple(w[j:j + k]) for j in range(len(w) - k + 1))
                score = sum((h & c).values()) / sum((h | c).values())
                if score >= least and score > out.get((n, d, i), (0, 0))[0]:
                    out[n, d, i] = (score, s)
    return sorted(((d, i, round(v, 9), s) for (_, d, i), (v, s) in out.items()), key=str)


def test_items_with_edits(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 5000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([5, 6, 12, 20, 30, 44, 60, 60])] + [(50, "too short"), (51, None), (52, ""), (53, "a b a b a b a b a b a b")]
    docs = [(1, None), (2, ""), (None, "lead " + items[3][1])]
    for n, (_, text) in enumerate(items):
        ws = (text or "").split()
        around = [word() for _ in range(60)]
        docs.append((10 + n, " ".join(around[:30] + [w.upper() for w in ws] + around[30:])))
        if len(ws) > 8:
            docs.append((100 + n, " ".join(around[:9] + ws[1:-1] + around[9:])))
            docs.append((200 + n, " ".join(around[:20] + ws[:len(ws) // 2] + ["new"] + ws[len(ws) // 2:] + around[20:])))
            docs.append((300 + n, " ".join(ws[:len(ws) // 2])))
    docs.append((10, docs[3][1]))
    df, bench = frame(spark, docs, clash=True), spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items)
    for blocks in (2_000_000, 60):
        got = decontam.contaminated(df, bench, block_words=blocks).collect()
        assert sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in got), key=str) == want
        out = decontam.keep_clean(df, bench, block_words=blocks)
        assert out.columns == df.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted((x for x in docs if not plain_hits([x], items)), key=str)
    assert decontam.contaminated(df.limit(0), bench).count() == 0 and decontam.contaminated(df, bench.limit(0)).count() == 0


def test_every_window_over_the_threshold():
    rng = np.random.default_rng(21)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 50))) for i in range(300)]
    index = decontam.ItemIndex(items)
    for i, text in items:  # one word in the middle changed: 41 of 51 shingles
        ws = text.split()
        ws[int(rng.integers(10, 40))] = "other"
        lead, tail = ([f"l{x}" for x in rng.integers(0, 1 << 30, n)] for n in (30, 20))
        assert index.hits(" ".join(lead + ws + tail)) == [(i, 41 / 51, 30, 50)]


def test_documents_shorter_than_the_item():
    words = [f"w{i}" for i in range(59)]
    index = decontam.ItemIndex([(1, " ".join(words)), (2, " ".join(words[:5]))])
    whole = [(2, 1.0, 0, 5)]
    assert index.hits(" ".join(words[:57])) == [(1, 53 / 55, 0, 57), *whole]
    assert index.hits(" ".join(words[2:])) == [(1, 53 / 55, 0, 57)]
    assert index.hits(" ".join(words[:48])) == [(1, 44 / 55, 0, 48), *whole] and index.hits(" ".join(words[:47])) == whole


def test_decontamination_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    sets = {i: set(zip(*[low(t).split()[k:] for k in range(5)])) for i, t in items}
    near = [(d, t) for d, t in docs if any(set(zip(*[low(t).split()[k:] for k in range(5)])) & s for s in sets.values())]
    got = sorted(((r.doc_id, r.item_id, round(r.similarity, 9), r.first_word) for r in decontam.op9(spark, DATA).collect()), key=str)
    assert got == plain_hits(near, items) and got


def test_chat_query_against_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({chat.ORACLE}) AS x").fetchall()
    assert sorted(tuple(r[c] for c in names) for r in chat.op6(spark, DATA).collect()) == sorted(want)
    assert hashlib.sha256((chat.PROBE).encode()).hexdigest() in {w[4] for w in want}


def test_near_finds_every_print_within_the_radius():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    size = decontam.SizeClass(list(range(60)), prints)
    for p in prints.tolist():
        for flips in (0, 1, 8, 16, 20, 23, 24, 30):
            x = p
            for b in rng.choice(64, flips, replace=False):
                x ^= 1 << int(b)
            want = [k for k, q in enumerate(prints.tolist()) if (q ^ x).bit_count() <= decontam.RADIUS]
            assert size.near(x).tolist() == want


def test_recall_of_edited_items_against_the_exact_similarity():
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"q{i}x{x}" for x in rng.integers(0, 10_000, rng.integers(30, 120)))) for i in range(120)]
    index, found, all_, least = decontam.ItemIndex(items), 0, 0, 1.0
    for i, text in items:
        for kind in range(6):
            ws = text.split()
            if kind < 3:  # single words
                for at in rng.integers(0, len(ws), kind + 1):
                    ws[at] = f"new{at}"
            else:  # a block near the threshold
                m = max(1, int(len(ws) * rng.uniform(0.05, 0.12)) - 2)
                at = int(rng.integers(0, len(ws) - m))
                ws[at:at + m] = [f"new{x}" for x in range(m)]
            doc = " ".join([*(f"a{x}" for x in range(40)), *ws, *(f"z{x}" for x in range(40))])
            want = plain_hits([(0, doc)], [(i, text)])
            if want:
                least = min(least, want[0][2])
                all_ += 1
                found += [h[0] for h in index.hits(doc)] == [i]
    assert all_ > 250 and least < 0.82 and found >= 0.99 * all_
