import numpy as np
import pytest
import xxhash
from plain import DATA, Sets, frame, low, odd_rows, similar_groups, words

from quantweave.llm import simhash as S
from quantweave.llm.graph import connected_components


def plain_print(text, k=3):
    ws = words(low(text))
    parts = [" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(docs, radius):
    prints, groups, best = [plain_print(t) for _, t in docs], Sets(), {}
    u = sorted(set(prints))
    for a in u:
        groups.find(a)
        for b in u:
            if a < b and (a ^ b).bit_count() <= radius:
                groups.join(a, b)
    for (d, _), f in zip(docs, prints, strict=True):
        if d is not None:
            g = groups.find(f)
            best[g] = min(best.get(g, d), d)
    return sorted(((d, f"{f:016x}", best.get(groups.find(f))) for (d, _), f in zip(docs, prints, strict=True)), key=str)


def test_odd_rows_and_bit_flips(spark):
    rows = odd_rows()
    got = S.linked_components(frame(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == plain_components(rows, 2)
    assert S.linked_components(frame(spark, rows).limit(0)).count() == 0


def test_query_on_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(map(tuple, S.op2(spark, DATA).collect()), key=str) == plain_components(docs, 2)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_links_are_complete(spark, radius):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 12)] + [0, (1 << 64) - 1]
    prints = set(seeds)
    for s in seeds:  # chains and clouds around every seed
        for _ in range(25):
            f = s
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                f ^= 1 << int(b)
            prints.add(f)
    df = spark.createDataFrame([(S.signed(f),) for f in prints], "fp long")
    got = {tuple(r) for r in S.links_within(df, radius).collect()}
    want = {tuple(sorted((S.signed(a), S.signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= radius}
    assert got == want


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)] + [(5, 5), (None, 3)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, **{2000 + i: 2000 for i in range(50)}}


def test_near_duplicates_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = similar_groups(docs)
    n = {r.doc_id: r.group_n for r in S.near_duplicates(frame(spark, docs)).collect()}
    assert len(set(zip(want, [n[d] for d, _ in docs], strict=True))) == len(set(want)) == len(set(n.values()))


def test_keep_first(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clash=True)
    out = S.keep_first(docs)
    got = [(r.doc_id, r.text) for r in out.collect()]
    body = rows[0][1]
    assert out.columns == docs.columns
    assert [d for d, t in got if t == body] == [1] and 9 not in {d for d, _ in got}  # 9 is body and one word
    assert sorted(d for d, t in got if not t) == [2] and 4 in {d for d, _ in got}
    assert S.keep_first(docs.limit(0)).count() == 0


def same_groups(docs, got):
    want, have = similar_groups(docs), [got[d] for d, _ in docs]
    return len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))


def test_block_edits_near_the_threshold(spark):
    rng, docs = np.random.default_rng(5), []
    for i in range(160):  # pairs with one block replaced, text appended or cut off, similarity from 0.79 up
        ws = [f"w{x}" for x in rng.integers(0, 1 << 40, rng.integers(80, 400))]
        m = len(ws) - 4
        own = [f"o{x}" for x in rng.integers(0, 1 << 40, m)]
        many = int(m * rng.uniform(0.18, 0.255))
        swap = max(1, int(m * rng.uniform(0.08, 0.115)) - 4)
        at = int(rng.integers(4, len(ws) - swap - 4))
        other = [ws + own[:many], ws[:len(ws) - int(m * rng.uniform(0.15, 0.205))], ws[:at] + own[:swap] + ws[at + swap:]][i % 3]
        docs += [(2 * i, " ".join(ws)), (2 * i + 1, " ".join(other))]
    linked = len(docs) - len(set(similar_groups(docs)))
    assert 100 < linked < 160
    assert same_groups(docs, {r.doc_id: r.group_n for r in S.near_duplicates(frame(spark, docs)).collect()})


def test_pairs_that_meet_only_in_hot_entries(spark):
    rng = np.random.default_rng(8)
    base, docs = [f"t{i}" for i in range(300)], []
    for i in range(40):  # one template, own endings: under 0.8 between texts, and over 0.8 inside a pair
        own = [f"p{i}x{j}" for j in range(44)]
        for side in range(2):
            tail = [f"s{i}x{side}x{j}" for j in range(26)]
            docs.append((2 * i + side, " ".join(base + own + tail)))
    rng.shuffle(docs)
    docs = [(int(d), str(t)) for d, t in docs]
    assert 1 < len(set(similar_groups(docs))) < len(docs)
    assert same_groups(docs, {r.doc_id: r.group_n for r in S.near_duplicates(frame(spark, docs)).collect()})


@pytest.mark.parametrize("block", [3, 2048])
def test_every_pair_of_an_entry_is_taken(spark, block):
    sets = {i: np.arange(100 * (i // 2), 100 * (i // 2) + 20, dtype="<u8") for i in range(20)}  # equal sets 2k, 2k + 1
    for i in range(20):
        sets[i] = np.sort(np.append(sets[i], np.uint64(10_000 + i)))
    entries = spark.createDataFrame([(7, i, 21, 0) for i in sets], "key long, n long, size int, pos int")  # all meet in one entry alone
    table = spark.createDataFrame([(i, bytearray(s.tobytes()), bytearray(S.parity_print(s)), 21) for i, s in sets.items()], "n long, s binary, print binary, size int")
    shared = S.shared_entries(entries.union(entries))  # a text that two tasks hold
    assert shared.count() == 20
    got = {r.n: r.label for r in S.linked_groups(shared, table, block).collect()}
    assert got == {i: i // 2 * 2 for i in range(20)}


def test_prints_never_exceed_the_difference_of_the_sets():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3000, rng.integers(0, 900)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        x, y = (np.frombuffer(S.parity_print(s), "<u8") for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
