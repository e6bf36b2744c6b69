"""Prefix trie of conversations by truncation peeling (operator 11).

A node is a distinct sequence of first turns; its key is a running digest of the turns.
The peeling starts at the longest conversations. At each depth
the conversations that end there are merged with the nodes that survived from one
turn deeper, cut by their last turn: one grouping finds the nodes of that depth and
folds their members, children, leaves and savings, all of which are sums or minima
that Spark combines before the shuffle. The nodes of a depth are written to the shared
folder, so every step starts from files.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read, staged

#: Half a SHA-256 for each turn.
KEY_BYTES = 16
#: Turns that a rebuilt conversation may take from the first one of its hundred are fewer than this.
HEADS, FAMILY = 6, 100
#: Members that end in one node are written by blocks of so many consecutive conversation ids.
ENDS_BLOCK = 4096
#: Turns of a subtree that one task may peel.
SUBTREE = 4096
ROOT = hashlib.sha256(b"").digest()[:KEY_BYTES]
NODE = ("id binary, up binary, last_key binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chain array<binary>, "
        "turns array<struct<key:binary,size:long>>")
NODES = pa.schema([("id", pa.binary()), ("up", pa.binary()), ("last_key", pa.binary()), ("depth", pa.int32()), *[(k, pa.int64()) for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
                   ("chain", pa.list_(pa.binary())), ("turns", pa.list_(pa.struct([("key", pa.binary()), ("size", pa.int64())])))])
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_chains(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the digest and the code points of each turn, in order.

    ``turns`` holds conv_id, turn, role, text. Turns go by (turn, role, text), null first; a null role or
    text is empty; repeated rows are repeated turns; a null conv_id belongs to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 2 * KEY_BYTES))
    marked = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("_tie"), digest.alias("key"), F.char_length(text).cast("long").alias("size")).alias("t"))
    return marked.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(chains: DataFrame) -> DataFrame:
    """Conversation c as the first h turns of the first one of its hundred, then its own turns after its
    first h; h is crc32 of its decimal id modulo 6. At most a hundred conversations meet one head."""
    c = F.col("conv_id")
    heads = chains.filter(c % FAMILY == 0).select(c.alias("_base"), F.slice("turns", 1, HEADS - 1).alias("_head"))
    h = (F.crc32(c.cast("string")) % HEADS).cast("int")
    both = chains.withColumns({"_base": c - c % FAMILY, "_h": h}).join(heads, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), F.col("_h"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def chained(chains: DataFrame) -> DataFrame:
    """(conv_id, chain, turns): entry d of ``chain`` names the sequence of the first d turns; entry 0 is the root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for turns in batch.column(1).to_pylist():
                chain = [ROOT]
                for t in turns:
                    chain.append(hashlib.sha256(chain[-1] + t["key"]).digest()[:KEY_BYTES])
                names.append(chain)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.list_(pa.binary())), batch.column(1)], names=["conv_id", "chain", "turns"])
    kind = "conv_id long, chain array<binary>, turns array<struct<key:binary,size:long>>"
    return chains.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns").cast("array<struct<key:binary,size:long>>").alias("turns")).mapInArrow(run, kind)


def merged(rows: DataFrame, depth: int) -> DataFrame:
    """The nodes of ``depth`` from conversations that end there and from nodes one turn deeper, cut to ``depth``."""
    nodes = rows.groupBy(F.get("chain", F.lit(depth)).alias("id")).agg(
        F.any_value("chain").alias("chain"), F.any_value("turns").alias("turns"), F.min("conv_id").alias("conv_id"),
        *[F.sum(k).alias(k) for k in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    last = F.get("turns", F.lit(depth - 1)).size if depth else F.lit(0)
    return nodes.select("id", "chain", "turns", F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                        (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).cast("long").alias("saved_tokens"))


def cut(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of ``depth + 1`` without their last turn: each is one child of what they merge into."""
    return nodes.select(F.slice("chain", 1, depth + 1).alias("chain"), F.slice("turns", 1, depth).alias("turns"), "conv_id", "n_convs",
                        F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens")


def peeled(rows: DataFrame, bottom: int) -> DataFrame:
    """All nodes of ``bottom`` and deeper. The rows below one node of depth ``bottom`` are few (the caller has
    checked that), so a task peels them turn by turn, one such group at a time."""
    def one(group: list[dict]) -> Iterator[dict]:
        ended: dict[int, list[dict]] = {}
        for r in group:
            ended.setdefault(len(r["turns"]), []).append(r | {"n_children": 0, "n_leaves": 0, "saved_tokens": 0})
        above: list[dict] = []
        for depth in range(max(ended), bottom - 1, -1):
            nodes: dict[bytes, dict] = {}
            for r in [*ended.get(depth, []), *above]:
                n = nodes.get(r["chain"][depth])
                if n is None:
                    nodes[r["chain"][depth]] = dict(r)
                else:
                    n["conv_id"] = min(n["conv_id"], r["conv_id"])
                    for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                        n[k] += r[k]
            above = []
            for name, n in nodes.items():
                n["n_leaves"] = max(1, n["n_leaves"])
                if depth:
                    n["saved_tokens"] += (n["n_convs"] - 1) * n["turns"][depth - 1]["size"]
                yield {"id": name, "up": n["chain"][depth - 1] if depth else None, "last_key": n["turns"][depth - 1]["key"] if depth else None, "depth": depth,
                       **{k: n[k] for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")},
                       "chain": n["chain"][:depth + 1] if depth == bottom else None, "turns": n["turns"][:depth] if depth == bottom else None}
                above.append(n | {"n_children": 1})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (r for b in batches for r in b.to_pylist())
        for _, group in itertools.groupby(cells, key=lambda r: r["chain"][bottom]):
            nodes = one(list(group))
            while part := list(itertools.islice(nodes, 4096)):
                yield pa.RecordBatch.from_pylist(part, schema=NODES)
    stem = F.get("chain", F.lit(bottom))
    return rows.withColumn("_stem", stem).repartition("_stem").sortWithinPartitions("_stem").select("chain", "turns", "conv_id", "n_convs").mapInArrow(run, NODE)


def prefix_trie(chains: DataFrame, subtree: int = SUBTREE) -> DataFrame:
    """Nodes of the trie of ``chains`` (conv_id, turns: array of key and size), one row each:

    id (128 bits), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, the digest of the members that end in the node, and last_key, the key of its last turn.

    Equal conversations fold first. Below some depth every subtree holds at most ``subtree`` turns; there a
    task peels a whole subtree, so one very long conversation needs no job for each of its turns. Above, one job
    for each depth merges nodes of any number of members.

    Defined cases: a conversation without turns ends in the root; a null conv_id is left out; a conv_id that repeats is
    one member for each row; equal turns of one conversation are nodes of different depth; an
    empty table has no nodes, not even a root; other columns are not read.
    """
    convs = staged(chained(chains).withColumn("id", F.element_at("chain", -1)), "conversations")
    rows = staged(convs.groupBy("id").agg(F.any_value("chain").alias("chain"), F.any_value("turns").alias("turns"), F.min("conv_id").alias("conv_id"),
                                          F.count(F.lit(1)).alias("n_convs")).withColumn("depth", F.size("turns")), "distinct")
    # The shallowest depth below which all subtrees are small: a subtree shrinks with its depth, so halving finds it.
    low, high = 0, rows.agg(F.max("depth")).first()[0] or 0
    while low < high:
        middle = (low + high) // 2
        largest = rows.filter(F.col("depth") >= middle).groupBy(F.get("chain", F.lit(middle))).agg(F.sum(F.col("depth") + 1).alias("n")).agg(F.max("n")).first()[0]
        low, high = (low, middle) if (largest or 0) <= subtree else (middle + 1, high)
    below = staged(peeled(rows.filter(F.col("depth") >= low), low), "nodes")
    kept = [f.name for f in below.schema if f.name not in ("chain", "turns")]
    levels, deeper = [below.select(*kept)], below.filter(F.col("depth") == low)
    for depth in range(low - 1, -1, -1):
        here = rows.filter(F.col("depth") == depth).select("chain", "turns", "conv_id", "n_convs", *[F.lit(0).cast("long").alias(k) for k in ("n_children", "n_leaves", "saved_tokens")])
        deeper = staged(merged(here.unionByName(cut(deeper, depth)), depth), "nodes")
        up, last = (F.get("chain", F.lit(depth - 1)), F.get("turns", F.lit(depth - 1)).key) if depth else (F.lit(None).cast("binary"),) * 2
        levels.append(deeper.withColumns({"up": up, "last_key": last}).select(*kept))
    nodes = functools.reduce(DataFrame.unionByName, levels)
    parents = nodes.filter("n_children > 0").select(F.col("id").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(parents, "up", "left").join(_ends(convs), "id", "left")
    return out.select("id", F.col("depth").cast("long").alias("depth"), "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), "last_key")


def _ends(convs: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes where conversations end. Blocks of consecutive ids are sorted and joined
    first, so that only the digest itself goes in sequence, as a stream of blocks that is never held whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != now:
                    if digest is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = name, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["id", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])
    blocks = convs.groupBy("id", F.floor(F.col("conv_id") / ENDS_BLOCK).alias("block")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))).alias("ids"))
    return blocks.repartition("id").sortWithinPartitions("id", "block").select("id", "ids").mapInArrow(run, "id binary, ends_sha256 string")


def with_last_turn(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with the role and the text of each node's last turn (null for the root), from the turn table."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256), 1, 2 * KEY_BYTES))
    said = turns.groupBy(key.alias("last_key")).agg(F.any_value(role).alias("role"), F.any_value(text).alias("text"))
    return nodes.join(said, "last_key", "left")


ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id AS c, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: list_concat([ascii(x)::BIGINT], list_resize([]::BIGINT[], 8, -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM t),
h AS (SELECT c, c - c % 100 AS base, xor(crc, 4294967295) % 6 AS h FROM ids),
r AS (SELECT c, i, role, text FROM h JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT c, i + 1000000, role, text FROM h JOIN t ON t.conv_id = c AND i > h),
k AS (SELECT h.c, coalesce(list({'r': role, 't': text} ORDER BY i) FILTER (r.c IS NOT NULL), []) AS turns FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
p AS (SELECT c, len(turns) AS n, d, turns[1:d] AS path FROM k, unnest(range(len(turns) + 1)) AS u(d)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].t) END AS own,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS up, d - 1 AS ud, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.path AND kids.ud = n.d),
s AS (SELECT path[1:a] AS top, a, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM x, unnest(range(d + 1)) AS v(a) GROUP BY 1, 2)
SELECT x.conv_id, x.d::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN s ON s.top = x.path AND s.a = x.d LEFT JOIN n u ON x.d > 0 AND u.path = x.path[1:x.d - 1] AND u.d = x.d - 1"""


@query("op11_truncation_peeling", ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_chains(read(spark, sf_dir, "conversations")))).drop("id", "last_key")
