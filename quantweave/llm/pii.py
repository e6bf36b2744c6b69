"""Personal data by patterns and by bootstrapped contexts (operator 4), built-in functions only.

Base spans come from four patterns. The method finds identifiers that no pattern
describes: base spans are seed instances, and the words around an instance are its
lexical patterns (the two words to the left; the word on each side). Candidates are other
words with digits or an at sign. Distinct (pattern, value) pairs form a bipartite
graph that Spark scores in turns:

    pattern  = sum of its values' scores / (its number of values + PRIOR), at SUPPORT or more in sum
    value    = 1 - product of (1 - pattern) over its patterns; a seed's score stays 1

A candidate is reported as kind ``context`` if a pattern of its own occurrence
ends at ``CONFIDENCE`` or more. Values count once, so copies of a text add nothing.

The patterns are linear: a match of the leftmost kind can only start where a run starts or
where the last match ended (``\\G``), and repeats are possessive, which changes no match
because what follows a run is never part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import query, read, staged

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole digit runs, single blanks and hyphens inside, of 13 to 19 digits; all other runs fail their check anyway.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A whole word of six characters or more with an at sign or four digits.
WORD = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D@]*+@|(?:[^\x20\x09-\x0D0-9]*+[0-9]){4})[^\x20\x09-\x0D]{6,}+"
OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
EDGE = r"^[^A-Za-z0-9@+]+|[^A-Za-z0-9]+$"

AROUND = 60
TURNS, SUPPORT, PRIOR, CONFIDENCE = 3, 3.0, 1.0, 0.7


def luhn(digits: Column) -> Column:
    """Check digit of a digit string: every second digit from the right doubled, digit sums, total a multiple of ten."""
    steps = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    total = F.aggregate(steps, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0))))
    return total % 10 == 0


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


#: Kind -> (pattern, needed substring or pattern of the text, check of a match).
RULES = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.contains("."), lambda m: m.rlike(OCTETS)),
    "card": (CARD, lambda t: F.lit(True), lambda m: luhn(digits_of(m))),
    "phone": (PHONE, lambda t: t.contains("+"), lambda m: F.length(digits_of(m)).between(9, 15)),
}


def located(df: DataFrame, matches: str, pieces: str, kind: str) -> DataFrame:
    """Adds column ``kind``: spans of the matches, running offsets in code points over the
    pieces of text between them. Running sums are built in blocks of about the square root of the number of
    matches, so a text with very many matches stays cheap."""
    item = "struct<kind:string,start:int,end:int,value:string,left:string,right:string>"

    def step(a, x):
        start = a["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["match"].alias("value"), x["left"].alias("left"), x["right"].alias("right")))).alias("out"))

    def spans(block, at):
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(f"array<{item}>").alias("out")), step, lambda a: a["out"])
    size = F.ceil(F.sqrt(F.size(matches))).cast("int")
    m, p = (lambda i: F.get(matches, i)), (lambda i: F.get(pieces, i))
    df = df.withColumn("_i", F.transform(matches, lambda x, i: F.struct(  # contexts from the pieces next to the match, so no text is searched again
        x.alias("match"), F.length(p(i)).alias("gap"),
        F.right(F.concat_ws("", F.when(i > 1, m(i - 2)), F.when(i > 0, p(i - 1)), F.when(i > 0, m(i - 1)), p(i)), F.lit(AROUND)).alias("left"),
        F.left(F.concat_ws("", p(i + 1), m(i + 1)), F.lit(AROUND)).alias("right"))))
    df = df.withColumn("_b", F.when(F.size("_i") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_i") - 1) / size).cast("int")), lambda b: F.slice("_i", b * size + 1, size)))
                       .otherwise(F.array().cast("array<array<struct<match:string,gap:int,left:string,right:string>>>")))
    totals = F.transform("_b", lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["match"])))
    df = df.withColumn("_o", F.aggregate(totals, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                                         lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]))
    return df.withColumn(kind, F.flatten(F.zip_with("_b", "_o", spans))).drop("_i", "_b", "_o")


def with_spans(df: DataFrame, kind: str, pattern: str, gate, check=None, text: str = "_text") -> DataFrame:
    """Adds array column ``kind`` with the spans of the pattern that pass the check."""
    t = F.col(text)
    df = df.withColumn("_m", F.when(gate(t), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = located(df, "_m", "_p", kind).drop("_m", "_p")
    return df.withColumn(kind, F.filter(kind, lambda s: check(s["value"]))) if check else df


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, base, instances): base spans by kind and start, and what
    bootstrapping needs of them and of the candidate words, contexts included."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("row_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, (pattern, gate, check) in RULES.items():
        df = with_spans(df, kind, pattern, gate, check)
    df = df.withColumn("base", F.concat(*KINDS)).drop(*KINDS)
    df = with_spans(df, "context", WORD, lambda t: t.rlike("[0-9@]"))
    free = F.filter("context", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    around = F.transform(F.concat("base", free), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["value"], EDGE, "").alias("value"),
        s["left"].alias("left"), s["right"].alias("right")))
    return df.withColumn("instances", around).select("doc_id", "row_key", F.transform("base", lambda s: s.dropFields("value", "left", "right")).alias("base"), "instances")


def context_patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of an instance; digits become 0, and a text's edge is a word of its own."""
    def words(c):
        return F.filter(F.split(F.regexp_replace(F.lower(c), "[0-9]", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    before = F.concat(F.array(F.lit("^"), F.lit("^")), words(left))
    after = F.concat(words(right), F.array(F.lit("$")))
    near, far = F.element_at(before, -1), F.element_at(before, -2)
    return F.array(F.concat(F.lit("2 "), far, F.lit(" "), near), F.concat(F.lit("1 "), near, F.lit(" _ "), F.element_at(after, 1)))


def scored_patterns(edges: DataFrame, turns: int = TURNS, support: float = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(pattern, score) from distinct ``edges(pattern, value, seed)``. Every turn is two
    folded aggregates and two joins, written to the shared folder."""
    values = edges.select("value", F.col("seed").cast("double").alias("score")).groupBy("value").agg(F.max("score").alias("score"))
    for turn in range(turns):
        patterns = staged(edges.join(values, "value").groupBy("pattern").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
                          .filter(F.col("s") >= support).select("pattern", (F.col("s") / (F.col("n") + prior)).alias("score")), "patterns")
        if turn + 1 < turns:
            miss = F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999999))))
            reached = edges.join(patterns, "pattern").groupBy("value").agg((1 - F.exp(miss)).alias("p"))
            values = staged(edges.groupBy("value").agg(F.max("seed").alias("seed")).join(reached, "value", "left").select(
                "value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("p", F.lit(0.0))).alias("score")), "values")
    return patterns


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", confidence: float = CONFIDENCE) -> DataFrame:
    """(doc_id, base, added): arrays of spans (kind, start, end) in code points, end exclusive.

    Defined cases: null and empty texts have no spans; repeated rows have the same
    spans; contexts at the edge of a text use a mark; a tie in a pattern's score needs no
    order, because patterns are accepted by score alone; an empty table gives an empty result.
    """
    rows = staged(found(docs, doc_id, text), "entities")
    one = rows.select("row_key", F.explode("instances").alias("i")).select(
        "row_key", "i.kind", "i.start", "i.end", F.lower("i.value").alias("value"), context_patterns(F.col("i.left"), F.col("i.right")).alias("patterns"))
    edges = one.select("value", (F.col("kind") != "context").alias("seed"), F.explode("patterns").alias("pattern"))
    edges = staged(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    good = scored_patterns(edges).filter(F.col("score") >= confidence).select("pattern")
    new = (one.filter("kind = 'context'").select("row_key", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern", "left_semi")
           .groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("added")))
    return rows.join(new, "row_key", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op4_bootstrapped_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(read(spark, sf_dir, "documents"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS],
                      F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))
