"""Quality rules with risk-controlled cutoffs (operator 1), built-in functions only.

Every rule compares one text statistic with a cutoff. For each stratum and rule
a fixed ladder of cutoffs, from lax to strict, is tested on the labelled
documents: a cutoff passes if the exact binomial tail ``P(Bin(n, risk) <= k)``
of its ``k`` false rejections among ``n`` good documents is at most
``delta / (strata * rules)``. The ladder stops at the first failure
(fixed-sequence testing, so the steps of a ladder need no further correction)
and strata and rules share ``delta`` (Bonferroni). With ``risk = alpha / rules``
the rules together reject at most a share ``alpha`` of the good documents of
every stratum, with probability ``1 - delta``. A stratum with too few labels
gets no cutoff and loses nothing.

Defined cases: a null text has no words and fails the base rule; a null stratum
is a stratum of its own (the empty name); null labels and labels without a
document are ignored; a document with several labels is good if all say so; an
empty label table leaves the base rule alone; repeated rows are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.llm.base import packed, query, read, staged, word_array

#: Rule name -> ladder of cutoffs from lax to strict; a document is rejected above the chosen one.
LADDERS = {
    "symbol_share": [1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1],
    "dup_line_share": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5],
    "repeat_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "mean_chars": [14.0, 12.0, 10.0, 9.0, 8.0],
}
ALPHA, DELTA = 0.02, 0.05
MIN_WORDS, MAX_REPEAT = 50, 50
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def with_statistics(df: DataFrame, text: str = "_text") -> DataFrame:
    """Adds the base statistics and the rule statistics of column ``text``.

    Three-word windows are compared by their 64-bit hashes inside the row:
    sorted (hash, position) pairs put equal windows side by side.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"_w": word_array(F.col(text)), "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
                         "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "_n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.transform("_w", lambda w: F.xxhash64(w))}).drop("_w", "_lines")
    df = df.withColumn("_s", F.when(F.size("_h") >= 4, F.sort_array(F.transform(
        F.slice("_h", F.lit(1), F.size("_h") - 2),
        lambda h, i: F.struct(F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i"))))))
    df = df.drop("_h").withColumn("_d", F.filter("_s", lambda x, k: (x.h == F.get("_s", k + 1).h) | ((k > 0) & (x.h == F.get("_s", k - 1).h))))
    covered = F.aggregate(
        F.sort_array(F.transform("_d", lambda x: x.i)), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct((p + 3).alias("end"), (a.n + p + 3 - F.greatest(a.end, p)).alias("n")), lambda a: a.n)
    n = F.nullif(F.col("n_words"), F.lit(0))
    return df.drop("_s").withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_d").withColumns({
        "symbol_share": F.coalesce(F.col("n_symbols") / n, F.lit(0.0)),
        "dup_line_share": F.coalesce(F.col("n_dup_lines") / F.nullif(F.col("_n_lines"), F.lit(0)), F.lit(0.0)),
        "repeat_share": F.coalesce(F.col("n_repeat_words") / n, F.lit(0.0)),
        "mean_chars": F.coalesce(F.col("word_chars") / n, F.lit(0.0)),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))}).drop("_n_lines")


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed exactly in the log domain; k may not exceed n * p."""
    import math
    odds, first = math.log(p / (1 - p)), n * F.lit(math.log1p(-p))

    def step(a, i):
        term = a.term + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(a.total, term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(a.total - top) + F.exp(term - top))).alias("total"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda a: a.total)


def calibrate(labelled: DataFrame, ladders: dict[str, list[float]] = LADDERS, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with the chosen cutoff of each rule (null: rule off).

    ``labelled`` has ``stratum``, the rule statistics and ``good``. The ladder
    counts are one map-side folded aggregate; nothing is gathered.
    """
    risk = alpha / len(ladders)
    good = labelled.filter("good")
    hits = [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, ladder in ladders.items() for i, c in enumerate(ladder)]
    counts = good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits)
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff"), F.col(f"{r}_{i}").alias("k"))
                      for r, ladder in ladders.items() for i, c in enumerate(ladder)])
    strata = good.agg(F.count_distinct("stratum").alias("strata"))  # one row
    tested = (counts.select("stratum", "n", F.explode(steps).alias("x")).select("stratum", "n", "x.*").join(F.broadcast(strata))
              .withColumn("log_p", F.when(F.col("k") > F.col("n") * risk, 0.0).otherwise(log_binomial_tail(F.col("k"), F.col("n"), risk)))
              .withColumn("passes", F.col("log_p") <= F.log(F.lit(delta) / (F.col("strata") * len(ladders)))))
    ladder = (tested.groupBy("stratum", "rule")
              .agg(F.min(F.when(~F.col("passes"), F.col("step"))).alias("stop"), F.sort_array(F.collect_list(F.struct("step", "cutoff"))).alias("c"))
              .withColumn("last", F.coalesce("stop", F.size("c")) - 1)
              .select("stratum", "rule", F.when(F.col("last") >= 0, F.get("c", F.col("last")).cutoff).alias("cutoff")))
    return ladder.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in ladders])


def labelled_good(labels: DataFrame) -> DataFrame:
    """One row per labelled document: good if every label it has says so."""
    return labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def judged(stats: DataFrame, cutoffs: DataFrame, ladders: dict[str, list[float]] = LADDERS) -> DataFrame:
    """Adds ``kept`` to rows with statistics and ``stratum``; the cutoff table
    has one row per stratum, and Spark broadcasts it only below its size limit."""
    rejected = F.lit(False)
    for r in ladders:
        rejected = rejected | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    return stats.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop(*[f"cut_{r}" for r in ladders])


def stratum(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def with_calibration(stats: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Cutoffs from rows with ``doc_id``, ``stratum`` and statistics; documents
    that the base rule drops are no holdouts of the other rules."""
    keep = ["doc_id", "stratum", *LADDERS]
    return calibrate(stats.filter(~F.col("base_failed")).select(*keep).join(labelled_good(labels), "doc_id"), **kw)


def keep_good(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that the base rule and the calibrated rules keep."""
    cutoffs = staged(with_calibration(statistics(docs), labels, **kw), "cutoffs")
    rows = with_statistics(packed(docs, stratum=stratum(F.col("lang")), _text=F.col("text"))).drop("_text")
    # The row number keeps the filter above the statistics: pushed below, it would compute each of them anew for every use.
    rows = rows.withColumn("_number", F.monotonically_increasing_id())
    return judged(rows, cutoffs).filter(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")


def statistics(docs: DataFrame) -> DataFrame:
    """Ids, strata and statistics of all documents, written once."""
    return staged(with_statistics(docs.select("doc_id", stratum(F.col("lang")).alias("stratum"), F.col("text").alias("_text"))).drop("_text"), "quality")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_STEPS = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, ladder in LADDERS.items() for i, c in enumerate(ladder))
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT rid, count(*) AS n_lines, count(DISTINCT x) AS u FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS x FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM g) WHERE c > 1),
p AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, i + o AS j FROM r, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
b AS (SELECT d.rid, doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines - u, 0)::BIGINT AS n_dup_lines,
  coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN l USING (rid) LEFT JOIN p USING (rid)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
  coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_share, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share,
  coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_share, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_chars FROM b),
v AS (SELECT rid, doc_id, stratum, base_failed, unnest([{', '.join(f"'{r}'" for r in LADDERS)}]) AS rule, unnest([{', '.join(LADDERS)}]) AS x FROM s),
a AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
ladder(rule, step, cutoff) AS (VALUES {_STEPS}),
k AS (SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (x > cutoff) AS k
      FROM v JOIN a USING (doc_id) JOIN ladder USING (rule) WHERE NOT base_failed GROUP BY ALL),
z AS (SELECT *, CASE WHEN k > n * {ALPHA / len(LADDERS)!r} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
      exp(lgamma(n + 1) - (CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END) - lgamma(n - i + 1) + i * ln({ALPHA / len(LADDERS)!r}) + (n - i) * ln(1 - {ALPHA / len(LADDERS)!r})))) END AS p,
      (SELECT count(DISTINCT stratum) FROM k) AS strata FROM k),
f AS (SELECT *, coalesce(min(step) FILTER (p > {DELTA} / (strata * {len(LADDERS)})) OVER (PARTITION BY stratum, rule), 1000) AS stop FROM z),
c AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM f WHERE step < stop GROUP BY ALL),
j AS (SELECT rid, bool_or(x > cutoff) AS rejected FROM v JOIN c USING (stratum, rule) GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM s LEFT JOIN j USING (rid)"""


@query("op1_quality_rules", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = statistics(read(spark, sf_dir, "documents"))
    return judged(stats, with_calibration(stats, read(spark, sf_dir, "labels"))).select("doc_id", *STATS, "base_failed", "kept")
