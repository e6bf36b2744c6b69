"""Audit and statistics rows: D17-D23, D29-D33, A23, I01, I05, I07-I11."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.features import featf
from quantweave.catalog.signals import trades
from quantweave.catalog.sqlkit import NUM, W, cte, g
from quantweave.operators import quality as qa, scans
from quantweave.operators import features as x
from quantweave.sources.market import code_number
from quantweave.session import work_dir

TABLES = ["profit_ability", "growth_ability", "balance_ability", "dupont"]
MONTHS = "(EXTRACT(YEAR FROM {b}) - EXTRACT(YEAR FROM {a})) * 12 + EXTRACT(MONTH FROM {b}) - EXTRACT(MONTH FROM {a})"


def gap_sql(name):
    return f"""SELECT code, '{name}' AS table_name, p AS gap_start, stat_date AS gap_end, mg AS months_gap, GREATEST(1, mg // 3 - 1) AS missing_periods FROM (
  SELECT *, {MONTHS.format(a='p', b='stat_date')} AS mg FROM (SELECT code, stat_date, LAG(stat_date) OVER (PARTITION BY code ORDER BY stat_date) AS p FROM {name}) AS a) AS b WHERE mg > 5"""


def cont_sql(name):
    return f"""SELECT * FROM (SELECT t.*, '{name}' AS table_name, total_periods * 100.0 / expected_periods AS completeness_pct, COALESCE(gp.n, 0) AS gap_count FROM (
  SELECT code, COUNT(*) AS total_periods, MIN(stat_date) AS first_report_date, MAX(stat_date) AS last_report_date,
    GREATEST(1, ({MONTHS.format(a='MIN(stat_date)', b='MAX(stat_date)')}) // 3) + 1 AS expected_periods FROM {name} GROUP BY code) AS t
  LEFT JOIN (SELECT code, COUNT(*) AS n FROM ({gap_sql(name)}) AS gs GROUP BY code) AS gp ON gp.code = t.code) AS z WHERE gap_count > 0 OR completeness_pct < 80"""


cte("gaps_all", " UNION ALL ".join(cont_sql(n) for n in TABLES), " ".join(TABLES))
cte("gaps_sum", """SELECT *, CASE WHEN total_gaps = 0 AND avg_completeness >= 90 THEN 'normal' WHEN total_gaps <= 2 AND avg_completeness >= 70 THEN 'light'
  WHEN total_gaps <= 5 AND avg_completeness >= 50 THEN 'medium' ELSE 'severe' END AS severity FROM (SELECT code, STRING_AGG(table_name, ',' ORDER BY table_name) AS affected_tables,
  CAST(SUM(total_periods) AS BIGINT) AS total_periods, CAST(SUM(expected_periods) AS BIGINT) AS expected_periods, CAST(SUM(gap_count) AS BIGINT) AS total_gaps, AVG(completeness_pct) AS avg_completeness FROM gaps_all GROUP BY code) AS x""", "gaps_all")


def tables(m):
    return {n: getattr(m, n)() for n in TABLES}


q("d17_statement_gaps", "code table_name gap_start gap_end months_gap missing_periods", gap_sql("balance_ability"), "balance_ability")(
    lambda m: qa.statement_gaps(m.balance_ability(), "balance_ability"))
q("d18_completeness", "code table_name total_periods expected_periods completeness_pct:4 gap_count first_report_date last_report_date", cont_sql("balance_ability"), "balance_ability")(
    lambda m: qa.continuity(m.balance_ability(), "balance_ability"))
q("i08_union_gap_reports", "code table_name total_periods expected_periods completeness_pct:4 gap_count", "SELECT * FROM gaps_all", "gaps_all")(lambda m: qa.all_gaps(tables(m)))
q("d19_gap_summary", "code affected_tables total_periods expected_periods total_gaps avg_completeness:4 severity", "SELECT * FROM gaps_sum", "gaps_sum")(
    lambda m: qa.gap_summary(qa.all_gaps(tables(m))))
q("i05_severity_sort", "code severity severity_rank avg_completeness:4 total_gaps", """SELECT * FROM (SELECT *, CAST(CASE severity WHEN 'severe' THEN 0 WHEN 'medium' THEN 1 WHEN 'light' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank FROM gaps_sum) AS x
  ORDER BY severity_rank, ROUND(avg_completeness, 4), code LIMIT 20""", "gaps_sum")(lambda m: qa.by_severity(qa.gap_summary(qa.all_gaps(tables(m)))))
q("d20_center_status", "total_codes synced_codes last_update", "SELECT (SELECT COUNT(DISTINCT code) FROM stock_basic) AS total_codes, COUNT(DISTINCT code) AS synced_codes, MAX(date) AS last_update FROM bars",
  "bars stock_basic")(lambda m: qa.center_status(m.stock_basic(), m.bars()))
q("d21_industry_counts", "industry n", "SELECT industry, COUNT(*) AS n FROM stock_basic GROUP BY industry ORDER BY n DESC, industry LIMIT 5", "stock_basic")(lambda m: qa.top_industries(m.stock_basic()))
q("d22_sessions_between", "strategy code date n_sessions", """SELECT t.strategy, t.code, t.date, z.session - a.session AS n_sessions FROM trades t JOIN cal a ON a.date = t.entry_date
  JOIN cal z ON z.date = t.exit_date""", "trades cal")(lambda m: qa.sessions_between(trades(m), scans.calendar(m.bars()), "entry_date", "exit_date"))
q("d23_date_range", "code first_date last_date first_year last_year", """SELECT code, MIN(date) AS first_date, MAX(date) AS last_date, CAST(MIN(EXTRACT(YEAR FROM date)) AS INT) AS first_year,
  CAST(MAX(EXTRACT(YEAR FROM date)) AS INT) AS last_year FROM bars GROUP BY code""")(lambda m: m.bars().groupBy("code").agg(
      F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min(F.year("date")).alias("first_year"), F.max(F.year("date")).alias("last_year")))
TARGETS = ["roc", "bias", "roc_div_bias", "roc_mul_bias", "epsTTM"]


def sparse(m):
    n = code_number()
    return featf(m).withColumns({
        "roc_div_bias": F.when(n % 3 != 0, F.try_divide("roc", "bias")), "roc_mul_bias": F.when(n % 4 != 0, F.col("roc") * F.col("bias")),
        "extra": F.when(n % 2 == 0, F.col("close"))}).select("code", "date", "roc", "bias", "roc_div_bias", "roc_mul_bias", "epsTTM", "extra")


PRESENT = f"""SELECT code, 'roc' AS feature FROM feat GROUP BY code UNION ALL SELECT code, 'bias' FROM feat GROUP BY code UNION ALL SELECT code, 'roc_div_bias' FROM feat WHERE {NUM} % 3 <> 0 GROUP BY code
  UNION ALL SELECT code, 'roc_mul_bias' FROM feat WHERE {NUM} % 4 <> 0 GROUP BY code UNION ALL SELECT code, 'epsTTM' FROM featf WHERE epsTTM IS NOT NULL GROUP BY code
  UNION ALL SELECT code, 'extra' FROM feat WHERE {NUM} % 2 = 0 GROUP BY code"""
q("d29_feature_audit", "code n_missing n_extra n_div n_mul n_sub n_cross", f"""SELECT code, CAST(5 - COUNT(CASE WHEN feature <> 'extra' THEN 1 END) AS INT) AS n_missing, CAST(COUNT(CASE WHEN feature = 'extra' THEN 1 END) AS INT) AS n_extra,
  CAST(1 - COUNT(CASE WHEN feature = 'roc_div_bias' THEN 1 END) AS INT) AS n_div, CAST(1 - COUNT(CASE WHEN feature = 'roc_mul_bias' THEN 1 END) AS INT) AS n_mul, 0 AS n_sub, 0 AS n_cross FROM ({PRESENT}) AS p GROUP BY code""",
  "feat featf")(lambda m: qa.feature_audit(qa.feature_presence(sparse(m), TARGETS + ["extra"]), TARGETS))
q("i09_feature_sets", "feature side", f"""SELECT feature, CASE WHEN lo = 1 AND hi = 1 THEN 'both' WHEN lo = 1 THEN 'only_low' ELSE 'only_high' END AS side FROM (
  SELECT feature, MAX(CASE WHEN {NUM} = 0 THEN 1 ELSE 0 END) AS lo, MAX(CASE WHEN {NUM} = 1 THEN 1 ELSE 0 END) AS hi FROM ({PRESENT}) AS p WHERE {NUM} <= 1 GROUP BY feature) AS z""", "feat featf")(
    lambda m: (lambda a, b: a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("only_low")))
               .unionByName(b.exceptAll(a).withColumn("side", F.lit("only_high"))))(*[
                   qa.feature_presence(sparse(m), TARGETS + ["extra"]).where(code_number() == k).select("feature").distinct() for k in (0, 1)]))
FAM = {"technical": ["roc", "bias"], "volume": ["vol_ma", "volume"], "fundamental": ["epsTTM", "roeAvg", "YOYPNI", "totalShare"]}
FAMQ = " UNION ALL ".join(f"SELECT '{k}' AS family, CAST({len(v)} AS BIGINT) AS n_features, CAST({' + '.join(f'COUNT({c})' for c in v)} AS BIGINT) AS n_values FROM featf" for k, v in FAM.items())
q("d30_family_audit", "family n_features n_values", FAMQ, "featf")(lambda m: qa.family_audit(featf(m), FAM))


def json_sink(m):
    path = work_dir(m.spark, "factor-summary")
    qa.family_audit(featf(m), FAM).write.json(path)
    return m.spark.read.schema("family string, n_features long, n_values long").json(path)


q("a23_summary_sink", "family n_features n_values", FAMQ, "featf")(json_sink)
q("d31_group_sizes", "date n", "SELECT date, COUNT(*) AS n FROM bars GROUP BY date")(lambda m: m.bars().groupBy("date").agg(F.count(F.lit(1)).alias("n")))
COLS = ["roc", "bias", "volume"]
STATS = " UNION ALL ".join(f"SELECT '{c}' AS feature, AVG({c}) AS mean, STDDEV_SAMP({c}) AS std, QUANTILE_CONT({c}, 0.25) AS q1, MEDIAN({c}) AS median, QUANTILE_CONT({c}, 0.75) AS q3 FROM feat" for c in COLS)
q("d32_column_stats", "feature mean:5 std:5 q1:5 median:5 q3:5", STATS, "feat")(lambda m: qa.column_stats(featf(m), COLS))
for method in ("iqr", "zscore"):
    def out_sql(c, method=method):
        if method == "iqr":
            return f"CASE WHEN f.{c} < {c}s.q1 - 1.5 * ({c}s.q3 - {c}s.q1) OR f.{c} > {c}s.q3 + 1.5 * ({c}s.q3 - {c}s.q1) THEN {c}s.median ELSE f.{c} END AS {c}"
        return f"CASE WHEN ABS(f.{c} - {c}s.mean) > 2 * {c}s.std THEN {c}s.mean ELSE f.{c} END AS {c}"
    q(f"d33_outliers_{method}", "code date roc:5 volume:5", f"SELECT code, date, {out_sql('roc')}, {out_sql('volume')} FROM feat f CROSS JOIN (SELECT * FROM st WHERE feature = 'roc') AS rocs CROSS JOIN (SELECT * FROM st WHERE feature = 'volume') AS volumes",
      "feat", f"st AS MATERIALIZED ({STATS})")(lambda m, method=method: qa.replace_outliers(featf(m), ["roc", "volume"], method, 1.5 if method == "iqr" else 2.0))

# --- sorts and set operations -----------------------------------------------
q("i01_date_sort", "date code close", "SELECT date, code, close FROM bars ORDER BY date, code")(lambda m: m.bars().orderBy("date", "code"))
q("i07_union_blocks", "code date close block", """SELECT code, date, close, 'old' AS block FROM bars WHERE date < DATE '1998-01-01'
  UNION ALL SELECT code, date, close, 'new' AS block FROM bars WHERE date >= DATE '1998-01-01'""")(
    lambda m: m.bars().where("date < DATE '1998-01-01'").withColumn("block", F.lit("old")).unionByName(m.bars().where("date >= DATE '1998-01-01'").withColumn("block", F.lit("new"))))
q("i10_distinct", "code year", "SELECT DISTINCT code, CAST(EXTRACT(YEAR FROM date) AS INT) AS year FROM bars")(lambda m: m.bars().select("code", F.year("date").alias("year")).distinct())
q("i11_keep_last", "code year date close", "SELECT code, CAST(EXTRACT(YEAR FROM date) AS INT) AS year, date, close FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code, EXTRACT(YEAR FROM date) ORDER BY date DESC) AS k FROM bars) AS x WHERE k = 1")(
    lambda m: m.bars().groupBy("code", F.year("date").alias("year")).agg(F.max_by(F.struct("date", "close"), "date").alias("r")).select("code", "year", "r.*"))
