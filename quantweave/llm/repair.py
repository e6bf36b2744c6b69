"""Structure repair of conversations by one integer minimum (operator 12).

The edits of a conversation are a path through a graph whose nodes are (row, state of the role
pattern). A path's weight is one big integer: the high digits are its cost, the low digits
its audit letters, ``DIGIT`` bits each, the first letter highest, with zeros
after the last one. So the ordinary minimum of integers is the cheapest path, and among equally
cheap ones the audit that is least in ASCII, a shorter one before its continuations. The graph is walked from the
last row, since the best way to end does not depend on how a node was reached; an edit
moves the digits one place down and puts its letter on top.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantweave.llm.base import query, read

#: Costs of the edits, and of a row that stays although it is cut off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
DIGIT = 3
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
#: The role pattern (s?(ua)+)? as an automaton: state and role initial to state.
STEP = {("start", "s"): "system", ("start", "u"): "user", ("system", "u"): "user", ("answered", "u"): "user", ("user", "a"): "answered"}
STATES, ENDS = ("start", "system", "user", "answered"), ("start", "answered")
ROLES = {"u": "user", "a": "assistant"}
BLANKS, STOP = " \t\n\x0b\f\r", r"[.!?]"
MUST_GO = ("blank", "duplicate")
OUTPUT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
          "repaired array<struct<role:string,text:string>>")
ARROW = pa.schema([("conv_id", pa.int64()), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
                   ("repaired_sha256", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


class Edit(NamedTuple):
    letter: str
    cost: int
    state: str
    role: str | None  # new role of a row that changes or comes in


def edits(state: str, initial: str, fault: str) -> list[Edit]:
    """What may become of a row in ``state`` (insertions apart)."""
    out = [Edit("D", DELETE, state, None)]
    if fault not in MUST_GO:
        stays = TRUNCATED if fault == "truncated" else 0
        if (state, initial) in STEP:
            out.append(Edit("K", stays, STEP[state, initial], None))
        out += [Edit("R", REROLE + stays, STEP[state, i], ROLES[i]) for i in ROLES if (state, i) in STEP]
    return out


INSERTS = {s: [Edit("I", INSERT, STEP[s, i], ROLES[i]) for i in ROLES if (s, i) in STEP] for s in STATES}


def repair(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[int | None, str | None]]]:
    """(cost, audit, repaired) of the rows (role initial, first fault); a repaired row
    is (row number, new role or None), or (None, role) for one that comes in."""
    # Deleting every row costs 2 each, so a cheapest path has at most 2n/5 insertions.
    places = len(rows) + DELETE * len(rows) // INSERT + 1
    high, digits = DIGIT * places, (1 << DIGIT * places) - 1

    def before(edit: Edit, rest: int) -> int:
        return ((rest >> high) + edit.cost << high) | (LETTERS[edit.letter] << high - DIGIT) | ((rest & digits) >> DIGIT)

    def with_inserts(best: dict[str, int], choice: dict) -> None:
        """Insertions lead from state to state without a row; their costs are positive, so rounds end."""
        moved = True
        while moved:
            moved = False
            for s in STATES:
                for e in INSERTS[s]:
                    if e.state in best and (s not in best or before(e, best[e.state]) < best[s]):
                        best[s], choice[s], moved = before(e, best[e.state]), e, True
    best = dict.fromkeys(ENDS, 0)
    steps: list[dict[str, Edit]] = [{}]
    with_inserts(best, steps[-1])
    for initial, fault in reversed(rows):
        now, choice = {}, {}
        for s in STATES:
            for e in edits(s, initial, fault):
                if e.state in best and (s not in now or before(e, best[e.state]) < now[s]):
                    now[s], choice[s] = before(e, best[e.state]), e
        with_inserts(now, choice)
        best = now
        steps.append(choice)
    state, audit, kept, at = "start", [], [], 0
    while True:
        e = steps[len(rows) - at].get(state)
        if e is None:
            break
        audit.append(e.letter)
        if e.letter == "I":
            kept.append((None, e.role))
        else:
            if e.letter != "D":
                kept.append((at, e.role))
            at += 1
        state = e.state
    return best["start"] >> high, "".join(audit), kept


def damaged(turns: DataFrame) -> DataFrame:
    """The rows after damage, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes
    away its stops, 3 repeats it, 4 makes it the user's. Nulls are one blank."""
    lot = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", STOP, "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("_")).drop("_")


def repair_conversations(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Faults and the cheapest repair, one row per conversation of ``turns`` (conv_id, turn, role, text), and per
    other conv_id of ``ids``: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired (role, text).

    Spark deals the rows by conversation, finds faults by windows and sorts; a task streams over them and holds one conversation.

    Defined cases: a null turn comes first and counts in no gap; rows that tie by turn go by role, then text; a null
    or empty role fits no place of the pattern; a null text is one blank; a null conv_id is a conversation of its own; a
    conversation without rows has zeros, an empty audit and nothing repaired; an empty table gives an empty result; other columns are not read.
    """
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    seen = Window.partitionBy("conv_id", F.xxhash64("role", "text"), "role", "text").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = (F.when(F.length(bare) == 0, "blank").when(F.row_number().over(seen) > 1, "duplicate")
             .when(~F.substring(bare, -1, 1).rlike(STOP), "truncated").otherwise(""))
    marked = rows.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == "duplicate")

    def one(conv: int | None, group: list[tuple]) -> dict:
        turn = [t for t, *_ in group if t is not None]
        initials = [r[:1] for _, r, _, _ in group]
        faults = [f for *_, f in group]
        cost, audit, kept = repair(list(zip(initials, faults, strict=True)))
        fixed = [(new or group[i][1], group[i][2]) if i is not None else (new, "") for i, new in kept]
        return {"conv_id": conv, "gaps": max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
                "illegal": sum((a + b) not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit,
                "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(), "repaired": [{"role": r, "text": t} for r, t in fixed]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (x for b in batches for x in zip(*[c.to_pylist() for c in b.columns], strict=True))
        held, size = [], 0
        for conv, group in itertools.groupby(cells, key=lambda x: x[0]):
            group = [x[1:] for x in group]
            held.append(one(conv, group))
            size += len(group)
            if size >= 4096:
                yield pa.RecordBatch.from_pylist(held, schema=ARROW)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)
    out = marked.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, OUTPUT)
    if ids is None:
        return out
    nothing = one(None, [])
    missing = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(rows.select("conv_id").distinct().withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    return out.unionByName(missing.select("conv_id", *[F.lit(nothing[k]).cast("long").alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                                          *[F.lit(nothing[k]).alias(k) for k in ("audit", "repaired_sha256")], F.array().cast(out.schema["repaired"].dataType).alias("repaired")))


ORACLE = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: list_concat([ascii(x)::BIGINT], list_resize([]::BIGINT[], 8, -1::BIGINT))))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
    FROM (SELECT *, xor(crc, 4294967295) % 20 AS lot FROM o), unnest(CASE lot WHEN 0 THEN []::INT[] WHEN 3 THEN [0, 1] ELSE [0] END) AS u(copy)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM d),
f AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(bare, '[.!?]$') THEN 't' ELSE '' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
    count(*) OVER (PARTITION BY conv_id) AS n FROM n),
step AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) AS v(s, ini, z)),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', 'user:' || chr(10)), (1, 2, 5, 'I', 'user:' || chr(10)),
    (3, 2, 5, 'I', 'user:' || chr(10)), (2, 3, 5, 'I', 'assistant:' || chr(10)), (0, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)),
    (1, 3, 10, 'II', 'user:' || chr(10) || 'assistant:' || chr(10))) AS v(s, z, cost, letters, lines)),
e AS (SELECT conv_id, i, n, s, s AS z, 2 AS cost, 'D' AS letter, '' AS line FROM f, unnest([0, 1, 2, 3]) AS u(s)
  UNION ALL SELECT conv_id, i, n, s, z, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', role || ':' || text || chr(10) FROM f JOIN step USING (ini) WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, n, s, z, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', CASE step.ini WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text || chr(10)
    FROM f, step WHERE fault NOT IN ('b', 'd') AND step.ini <> 's'),
w AS (SELECT c.conv_id, c.n + 1 AS i, ins.s, min({'cost': ins.cost, 'audit': letters, 'lines': lines}) AS v
    FROM (SELECT DISTINCT conv_id, n FROM f) c, ins WHERE ins.z IN (0, 3) GROUP BY ALL
  UNION ALL SELECT w.conv_id, e.i, ins.s, min({'cost': ins.cost + e.cost + w.v.cost, 'audit': letters || letter || w.v.audit, 'lines': ins.lines || line || w.v.lines})
    FROM w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i - 1 AND e.z = w.s JOIN ins ON ins.z = e.s GROUP BY ALL),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(w.v.cost, 0)::BIGINT AS cost, coalesce(w.v.audit, '') AS audit, sha256(coalesce(left(w.v.lines, length(w.v.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1 AND w.s = 0"""


@query("op12_big_integer_repair", ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return repair_conversations(damaged(turns), turns.select("conv_id")).drop("repaired")
