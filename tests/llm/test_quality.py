import math

from plain import frame, odd_rows, words
from pyspark.sql import functions as F

from quantweave.llm import quality as Q


def base(text):
    ws, lines, seen = words(text), [x for x in (text or "").split("\n") if words(x)], {}
    for i in range(len(ws) - 2):
        seen.setdefault(tuple(ws[i:i + 3]), []).append(i)
    covered = {j + o for at in seen.values() if len(at) > 1 for j in at for o in range(3)}
    return (len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_statistics_of_odd_rows(spark):
    rows = odd_rows() + [(20, "a a a a a"), (21, "x y z x y z\nx y z\nx y z\n\n"), (22, "a b\na b\n a b")]
    df = Q.with_statistics(frame(spark, rows).select("doc_id", F.col("text").alias("_text")))
    got = sorted((tuple(r[c] for c in Q.STATS) for r in df.collect()), key=str)
    assert got == sorted((base(t) for _, t in rows), key=str)


def test_binomial_tail(spark):
    cases = [(0, 100, 0.01), (3, 500, 0.02), (20, 4000, 0.01), (500, 200_000, 0.005)]
    for k, n, p in cases:
        got = spark.range(1).select(Q.log_binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(terms)
        assert abs(got - (top + math.log(sum(math.exp(t - top) for t in terms)))) < 1e-6


def test_ladder_stops_at_the_risk(spark):
    # 4000 good documents; 0.2 % lie above 0.5, 10 % above 0.2
    good = [("en", 0.6 if i < 8 else 0.3 if i < 400 else 0.05, True) for i in range(4000)]
    bad = [("en", 0.9, False)] * 100 + [("xx", 0.9, True)] * 20
    df = spark.createDataFrame(good + bad, "stratum string, symbol_share double, good boolean")
    got = {r.stratum: r.cut_symbol_share for r in Q.calibrate(df, {"symbol_share": [1.0, 0.7, 0.5, 0.2, 0.1]}, alpha=0.01, delta=0.05).collect()}
    assert got == {"en": 0.5, "xx": None}


def test_few_labels_reject_nothing_and_rows_survive_whole(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (9, None, 0), (None, 1, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = Q.keep_good(docs, labels)
    want = [t for _, t in rows if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0]]
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == sorted(want)
    assert Q.keep_good(docs.limit(0), labels).count() == 0
    assert Q.keep_good(docs, labels.limit(0)).count() == len(want)


def test_no_python_in_the_plan(spark):
    df = Q.with_statistics(frame(spark, odd_rows()).select("doc_id", F.col("text").alias("_text")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
