"""Operators on conversations: prefix trie and structure repair, against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quantweave.llm.repair import damaged, repair, repair_conversations
from quantweave.llm.trie import prefix_trie, rebuilt, turn_chains, with_last_turn

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ["path", "depth", "n_convs", "sizes", "turns", "fault", "lot", "key", "t", "_h", "_base", "audit"]


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH]) if clash else df


def by_conversation(rows, null):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, null if role is None else role, null if text is None else text))
    return out


def plain_trie(rows, rebuild):
    """Digests of a turn sort ties of turn and role by the text's SHA-256."""
    convs = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))]
             for c, v in by_conversation(rows, "").items() if c is not None}
    if rebuild:
        old = convs
        convs = {c: old.get(c - c % 100, [])[:h] + v[h:] for c, v in old.items() for h in [zlib.crc32(str(c).encode()) % 6]}
    members = defaultdict(list)
    for c, v in convs.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = sorted(c for c in m if len(convs[c]) == len(p))
        leaves = sum(not any(len(x) == len(q) + 1 and x[:len(q)] == q for x in members) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in below), leaves, saved,
                 hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def odd_turns():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}") for c in range(0, 40) for t in range(c % 5)]
    rows += [(100 + c, t, "user", f"{c % 3} {t} 😀") for c in range(12) for t in range(7)]
    rows += [(50, None, None, None), (50, 1, "user", ""), (50, 1, "user", ""), (51, 2, None, "x" * 70_000), (51, None, "a", "b"), (51, None, "a", "a"),
             (None, 1, "user", "nobody"), (None, None, None, None), (52, 0, "", ""), (207, 0, "user", "no head"), (1000, 3, "system", "far"), (305, 1, "u", "gone")]
    rows += [(60, t, "user", "the same") for t in range(12)]
    return rows


@pytest.mark.parametrize(("rebuild", "subtree"), [(False, 4096), (True, 4096), (True, 20), (False, 1)])
def test_trie_against_plain_python(spark, rebuild, subtree):
    rows = odd_turns()
    chains = turn_chains(frame(spark, rows, clash=True))
    nodes = prefix_trie(rebuilt(chains) if rebuild else chains, subtree)
    got = [tuple(r) for r in nodes.select(*TRIE).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_trie(rows, rebuild)


def test_trie_ends_of_many_blocks(spark):
    ids = [i * 37 for i in range(2000)]
    rows = [(i, 0, "user", "hello") for i in ids]
    top = prefix_trie(turn_chains(frame(spark, rows))).filter("depth = 1").first()
    assert (top["n_convs"], top["n_children"], top["saved_tokens"]) == (2000, 0, 1999 * 5)
    assert top["ends_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_trie_of_one_very_long_conversation(spark):
    rows = [(1, t, "user", f"line {t}") for t in range(3000)] + [(c, 0, "user", "line 0") for c in range(2, 50)]
    nodes = prefix_trie(turn_chains(frame(spark, rows))).collect()
    assert len(nodes) == 3001 and {r["depth"]: r["n_convs"] for r in nodes} == {0: 49, 1: 49, **dict.fromkeys(range(2, 3001), 1)}


def test_trie_empty_and_texts(spark):
    assert prefix_trie(turn_chains(frame(spark, []))).collect() == []
    turns = frame(spark, [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b")])
    nodes = with_last_turn(prefix_trie(turn_chains(turns)), turns)
    assert {(r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect()} == {(0, None, None, 2), (1, "user", "a", 2), (2, "assistant", "b", 1)}


def plain_repairs(rows):
    """Every edit sequence of a short conversation: the cheapest, then the least audit."""
    best = None
    slots = [["", "u", "a", "ua", "au"]] * (len(rows) + 1)
    for ins in itertools.product(*slots):
        base = 5 * sum(map(len, ins))
        if best and base > best[0]:
            continue
        options = [[("D", 2, "")] + ([] if f in ("blank", "duplicate") else [("K", 5 * (f == "truncated"), i), ("R", 1 + 5 * (f == "truncated"), "u"), ("R", 1 + 5 * (f == "truncated"), "a")])
                   for i, f in rows]
        for pick in itertools.product(*options):
            cost = base + sum(c for _, c, _ in pick)
            letters = "".join("I" * len(ins[k]) + pick[k][0] for k in range(len(rows))) + "I" * len(ins[-1])
            if best and (cost, letters) >= best[:2]:
                continue
            if re.fullmatch("(s?(ua)+)?", "".join(ins[k] + (pick[k][2] if pick[k][0] != "K" else pick[k][2] or " ") for k in range(len(rows))) + ins[-1]):
                best = (cost, letters)
    return best


def test_repair_against_every_edit_sequence():
    rnd = random.Random(5)
    for _ in range(250):
        rows = [(rnd.choice(["u", "a", "s", "x", "", "u", "a"]), rnd.choice(["", "", "", "blank", "duplicate", "truncated"])) for _ in range(rnd.randint(0, 4))]
        cost, audit, kept = repair(rows)
        assert (cost, audit) == plain_repairs(rows), rows
        assert len(kept) == len(audit) - audit.count("D")


def plain_damage(rows):
    out = []
    for c, turn, role, text in rows:
        lot = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 0:
            continue
        out += [(c, turn, "user" if lot == 4 else role, "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text)] * (2 if lot == 3 else 1)
    return out


def test_repair_conversations_against_plain_python(spark):
    rnd = random.Random(8)
    rows = [(c, t if rnd.random() < .9 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", None, ""]),
             rnd.choice(["Fine.", "Fine.", "cut", "what? \n", None, "", " \t", "go!  ", "x " * 5000 + "."])) for c in range(300) for t in range(rnd.randint(1, 6))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (-3, 0, "user", "A."), (-3, 0, "user", "A.")]
    turns = frame(spark, rows, clash=True)
    got = {r["conv_id"]: r for r in repair_conversations(damaged(turns), turns.select("conv_id")).collect()}
    groups = by_conversation(plain_damage(rows), " ")
    assert set(got) == {c for c, *_ in rows}
    for c, r in got.items():
        seen, faults, lines = set(), [], []
        group = sorted(groups.get(c, []))
        for _, _, role, text in group:
            bare = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit, kept = repair([(g[2][:1], f) for g, f in zip(group, faults, strict=True)])
        for i, new in kept:
            lines.append(f"{new}:" if i is None else f"{new or group[i][2]}:{group[i][3]}")
        turn = {g[1] for g in group if g[0]}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(group)]
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == (
            max(turn) - min(turn) + 1 - len(turn) if turn else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in r["repaired"]))


def test_repair_empty_and_long(spark):
    assert repair_conversations(damaged(frame(spark, [])), frame(spark, []).select("conv_id")).collect() == []
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Line {t}.") for t in range(3001)]
    r = repair_conversations(frame(spark, rows)).first()
    assert (r["cost"], len(r["repaired"]), r["audit"]) == (2, 3000, "K" * 3000 + "D")
