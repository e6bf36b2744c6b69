"""Data-quality audits and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions import ranks


def _months(a: Column, b: Column) -> Column:
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def statement_gaps(table: DataFrame, name: str) -> DataFrame:
    """One row per gap of more than five months between consecutive statements."""
    prev = F.lag("stat_date").over(Window.partitionBy("code").orderBy("stat_date"))
    df = table.select("code", "stat_date", prev.alias("gap_start")).withColumn("months_gap", _months(F.col("gap_start"), F.col("stat_date")))
    return df.where(F.col("months_gap") > 5).select(
        "code", F.lit(name).alias("table_name"), "gap_start", F.col("stat_date").alias("gap_end"), "months_gap",
        F.greatest(F.lit(1), F.floor(F.col("months_gap") / 3) - 1).cast("int").alias("missing_periods"))


def continuity(table: DataFrame, name: str, threshold: float = 80.0) -> DataFrame:
    """Instruments with gaps or low completeness, with their gap list (bounded by the statement calendar)."""
    base = table.groupBy("code").agg(F.count(F.lit(1)).alias("total_periods"), F.min("stat_date").alias("first_report_date"),
                                     F.max("stat_date").alias("last_report_date"))
    months = _months(F.col("first_report_date"), F.col("last_report_date"))
    base = base.withColumn("expected_periods", (F.greatest(F.lit(1), F.floor(months / 3)) + 1).cast("long"))
    base = base.withColumn("completeness_pct", F.col("total_periods") / F.col("expected_periods") * 100)
    gaps = statement_gaps(table, name).groupBy("code").agg(
        F.count(F.lit(1)).alias("gap_count"), F.array_sort(F.collect_list(F.struct("gap_start", "gap_end", "missing_periods"))).alias("gaps"))
    df = base.join(gaps, "code", "left").withColumns({"gap_count": F.coalesce("gap_count", F.lit(0)), "table_name": F.lit(name)})
    return df.where((F.col("gap_count") > 0) | (F.col("completeness_pct") < threshold))


def all_gaps(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = continuity(df, name)
        out = one if out is None else out.unionByName(one)
    return out


# Severity levels in order.
SEVERITY = ["severe", "medium", "light", "normal"]


def gap_summary(report: DataFrame) -> DataFrame:
    df = report.groupBy("code").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("table_name"))).alias("affected_tables"), F.sum("total_periods").alias("total_periods"),
        F.sum("expected_periods").alias("expected_periods"), F.sum("gap_count").alias("total_gaps"), F.round(F.avg("completeness_pct"), 6).alias("avg_completeness"))
    g, c = F.col("total_gaps"), F.col("avg_completeness")
    return df.withColumn("severity", F.when((g == 0) & (c >= 90), "normal").when((g <= 2) & (c >= 70), "light")
                         .when((g <= 5) & (c >= 50), "medium").otherwise("severe"))


def by_severity(summary: DataFrame, n: int = 20) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.col("severity"))
    return summary.withColumn("severity_rank", place - 1).orderBy("severity_rank", F.round("avg_completeness", 4), "code").limit(n)


def center_status(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    a = instruments.agg(F.countDistinct("code").alias("total_codes"))
    b = bars.agg(F.countDistinct("code").alias("synced_codes"), F.max("date").alias("last_update"))
    return a.join(b)  # one row each


def top_industries(instruments: DataFrame, n: int = 5) -> DataFrame:
    return instruments.groupBy("industry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "industry").limit(n)


def feature_presence(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(code, feature) for every feature with at least one value."""
    one = df.groupBy("code").agg(*[F.count(f).alias(f) for f in features])
    return one.unpivot(["code"], list(features), "feature", "n").where(F.col("n") > 0).select("code", "feature")


def feature_audit(present: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Per instrument: missing and extra features, missing counts by name pattern."""
    want = F.array(*[F.lit(t) for t in targets])
    have = present.groupBy("code").agg(F.collect_set("feature").alias("have"))
    missing = F.array_except(want, F.col("have"))

    def n(pattern):
        return F.size(F.filter(missing, lambda x: x.contains(pattern)))
    return have.select("code", F.size(missing).alias("n_missing"), F.size(F.array_except(F.col("have"), want)).alias("n_extra"),
                       n("_div_").alias("n_div"), n("_mul_").alias("n_mul"), n("_sub_").alias("n_sub"), n("_x_").alias("n_cross"))


def family_audit(df: DataFrame, families: dict[str, Sequence[str]]) -> DataFrame:
    """Features and filled values per family."""
    cols = [c for f in families.values() for c in f]
    one = df.agg(*[F.count(c).alias(c) for c in cols]).unpivot([], cols, "feature", "n")
    fam = F.create_map(*[x for k, v in families.items() for c in v for x in (F.lit(c), F.lit(k))])
    return one.withColumn("family", fam[F.col("feature")]).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum("n").alias("n_values"))


def column_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    long = df.select(*cols).unpivot([], list(cols), "feature", "value")
    mean = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return mean.join(ranks.quantiles(long, ["feature"], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, few_groups=True), "feature")


def replace_outliers(df: DataFrame, cols: Sequence[str], method: str, k: float = 3.0) -> DataFrame:
    """IQR fence -> median, or z-score -> mean. The statistics are one row per column."""
    st = column_stats(df, cols)
    wide = st.agg(*[F.max(F.when(F.col("feature") == c, F.struct("mean", "std", "q1", "median", "q3"))).alias(f"_s_{c}") for c in cols])
    df = df.join(F.broadcast(wide))  # one row

    def fixed(c):
        s, x = F.col(f"_s_{c}"), F.col(c)
        if method == "iqr":
            width = s["q3"] - s["q1"]
            return F.when((x < s["q1"] - k * width) | (x > s["q3"] + k * width), s["median"]).otherwise(x)
        return F.when((s["std"] > 0) & (F.abs(x - s["mean"]) > k * s["std"]), s["mean"]).otherwise(x)
    return df.withColumns({c: fixed(c) for c in cols}).drop(*[f"_s_{c}" for c in cols])


def sessions_between(trades: DataFrame, calendar: DataFrame, start: str, end: str) -> DataFrame:
    a = calendar.select(F.col("date").alias(start), F.col("session").alias("_a"))
    b = calendar.select(F.col("date").alias(end), F.col("session").alias("_b"))
    return trades.join(a, start).join(b, end).withColumn("n_sessions", F.col("_b") - F.col("_a"))
