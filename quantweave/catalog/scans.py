"""A-rows and P-rows: scans, upserts, payload clean-up, price adjustment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import NUM, W, cte, g, lagx
from quantweave.operators import adjust, filters, scans
from quantweave.operators import technical as t
from quantweave.sources import payload, upsert
from quantweave.sources.market import code_number

CD = "code date "
D = dt.date
OHLC = "open high low close volume amount"

q("a01_bar_scan", CD + OHLC + " is_st", """SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'
  AND code IN (SELECT code FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY code HAVING COUNT(*) >= 80)""")(
    lambda m: scans.bar_scan(m.bars(), D(1997, 1, 1), D(1998, 12, 31), None, 80))
cte("bf", "SELECT b.*, f.fore_adjust_factor AS f FROM bars b LEFT JOIN adjust_factor f ON f.code = b.code AND f.date = b.date",
    "bars adjust_factor")
FF = f"COALESCE(LAST_VALUE(f IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 1.0)"
q("a02_scan_with_factor", CD + "close fore_adjust_factor:8", f"""SELECT code, date, close, {FF} AS fore_adjust_factor FROM bf
  WHERE date >= DATE '1996-06-01'""", "bf")(
    lambda m: scans.scan_with_factor(m.bars(), m.adjust_factor(), D(1996, 6, 1), None))
cte("adj", f"""SELECT code, date, open * r AS open, high * r AS high, low * r AS low, close * r AS close, volume, amount, is_st FROM (
  SELECT *, {FF} / COALESCE(LAST_VALUE(f IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1.0) AS r
  FROM bf) AS s""", "bf")
q("a03_training_scan", CD + "open:6 high:6 low:6 close:6 volume", "SELECT * FROM adj", "adj")(
    lambda m: scans.training_scan(m.bars(), m.adjust_factor()))
q("a04_codes_in_range", "code", "SELECT DISTINCT code FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-01-31'")(
    lambda m: scans.codes_in_range(m.bars(), D(1999, 1, 1), D(1999, 1, 31)))
CAL = "SELECT date, ROW_NUMBER() OVER (ORDER BY date) AS session, LEAD(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars) AS d"
cte("cal", CAL, "bars")
q("a05_calendar", "date session next_date", "SELECT * FROM cal", "cal")(lambda m: scans.calendar(m.bars()))
q("a06_codes_by_market", "code", "SELECT DISTINCT code FROM bars WHERE code LIKE '68%' OR code LIKE '8%' OR code LIKE '4%' OR code LIKE '9%'")(
    lambda m: filters.codes_by_market(m.bars(), ["star", "bj"]))


def _new_bars(m):
    return m.bars().where(F.col("date") >= F.lit(D(1999, 10, 4))).withColumn("close", F.col("close") + 1)


def _old_bars(m):
    return m.bars().where(F.col("date") < F.lit(D(2000, 1, 3)))


q("a07_bar_upsert", CD + "open high low close volume amount is_st", """SELECT code, date, open, high, low,
  CASE WHEN date >= DATE '1999-10-04' THEN close + 1 ELSE close END AS close, volume, amount, is_st FROM bars""")(
    lambda m: upsert.merge_latest(_old_bars(m), _new_bars(m), ["code", "date"]))
q("a08_factor_upsert", CD + "fore_adjust_factor:8", """SELECT code, date, CASE WHEN date >= DATE '1999-01-01' THEN fore_adjust_factor * 2
  ELSE fore_adjust_factor END AS fore_adjust_factor FROM adjust_factor""", "adjust_factor")(
    lambda m: upsert.merge_latest(
        m.adjust_factor().where(F.col("date") < F.lit(D(2000, 6, 1))),
        m.adjust_factor().where(F.col("date") >= F.lit(D(1999, 1, 1))).withColumn("fore_adjust_factor", F.col("fore_adjust_factor") * 2),
        ["code", "date"]))
q("a09_finance_upsert", "code stat_date pub_date epsTTM:6", """SELECT code, stat_date, pub_date,
  CASE WHEN stat_date >= DATE '1999-01-01' THEN epsTTM + 1 ELSE epsTTM END AS epsTTM FROM profit_ability""", "profit_ability")(
    lambda m: upsert.merge_latest(
        m.profit_ability().where(F.col("stat_date") < F.lit(D(2000, 6, 1))),
        m.profit_ability().where(F.col("stat_date") >= F.lit(D(1999, 1, 1))).withColumn("epsTTM", F.col("epsTTM") + 1)
        .withColumn("unknown_column", F.lit(1)), ["code", "pub_date", "stat_date"]))


def _status(m):
    old = m.bars().where(code_number() % 2 == 0).groupBy("code").agg(
        F.min("date").alias("last_daily_sync"), F.min("date").alias("last_finance_sync"))
    new = m.bars().where(code_number() % 3 == 0).groupBy("code").agg(F.max("date").alias("last_daily_sync"))
    return upsert.merge_columns(old, new, "code")


q("a10_partial_upsert", "code last_daily_sync last_finance_sync", f"""SELECT code,
  CASE WHEN {NUM} % 3 = 0 THEN MAX(date) ELSE MIN(date) END AS last_daily_sync, CASE WHEN {NUM} % 2 = 0 THEN MIN(date) END AS last_finance_sync
  FROM bars WHERE {NUM} % 2 = 0 OR {NUM} % 3 = 0 GROUP BY code""")(_status)
q("a11_dimension_upsert", "code code_name industry", f"""SELECT code, CASE WHEN {NUM} % 3 = 0 THEN code_name || ' *' ELSE code_name END AS code_name,
  industry FROM stock_basic""", "stock_basic")(
    lambda m: upsert.merge_latest(m.stock_basic().where(code_number() % 2 == 1), m.stock_basic().where(code_number() % 2 == 0).unionByName(
        m.stock_basic().where(code_number() % 3 == 0).withColumn("code_name", F.concat("code_name", F.lit(" *")))), ["code"], order="code_name"))
q("a12_schema_evolution", CD + "turnover_rate:6 peTTM:6", """SELECT code, date,
  CASE WHEN date < DATE '1998-01-01' THEN volume / 1000 ELSE volume / 500 END AS turnover_rate,
  CASE WHEN date >= DATE '1998-01-01' THEN close / 2 END AS peTTM FROM bars""")(
    lambda m: upsert.evolve(
        m.bars().where(F.col("date") < F.lit(D(1998, 1, 1))).select("code", "date", (F.col("volume") / 1000).alias("turn")),
        m.bars().where(F.col("date") >= F.lit(D(1998, 1, 1))).select(
            "code", "date", (F.col("volume") / 500).alias("turnover_rate"), (F.col("close") / 2).alias("peTTM")),
        {"turn": "turnover_rate"}))


def _vendor(m):
    b = m.bars()
    bad = F.col("volume") % 7 == 0
    return b.select(F.concat(F.lit("sh."), "code").alias("code"), F.col("date").cast("string").alias("date"),
                    F.col("open").cast("string").alias("open"), F.col("close").cast("string").alias("close"),
                    F.when(bad, F.lit("")).otherwise(F.col("volume").cast("string")).alias("volume"),
                    F.when(F.col("volume") % 5 == 0, F.lit("n/a")).otherwise(F.lit("NaN")).alias("amount"),
                    F.when(bad, F.lit("0.5")).otherwise((F.col("volume") / 8).cast("string")).alias("turn"),
                    F.when(bad, F.lit(None).cast("string")).otherwise(F.col("is_st").cast("string")).alias("isST"))


q("a13_bar_payload", CD + "open close volume amount turnover_rate is_st", """SELECT code, date, open, close,
  CASE WHEN volume % 7 <> 0 THEN volume END AS volume, CAST(NULL AS DOUBLE) AS amount,
  CASE WHEN volume % 7 = 0 THEN 0.5 ELSE volume / 8 END AS turnover_rate, CASE WHEN volume % 7 = 0 THEN 0 ELSE is_st END AS is_st FROM bars""")(
    lambda m: payload.bar_payload(_vendor(m)))
q("a14_factor_payload", CD + "fore_adjust_factor:8 back_adjust_factor", """SELECT code, date, fore_adjust_factor,
  CAST(NULL AS DOUBLE) AS back_adjust_factor FROM adjust_factor""", "adjust_factor")(
    lambda m: payload.factor_payload(m.adjust_factor().select(
        F.concat(F.lit("sz."), "code").alias("code"), F.col("date").cast("string").alias("dividOperateDate"),
        F.col("fore_adjust_factor").cast("string").alias("foreAdjustFactor"))))
q("a15_finance_payload", "code stat_date pub_date epsTTM:6 roeAvg:6", "SELECT * FROM profit_ability", "profit_ability")(
    lambda m: payload.finance_payload(m.profit_ability().select(
        F.concat(F.lit("sz."), "code").alias("code"), F.col("pub_date").cast("string").alias("pubDate"),
        F.col("stat_date").cast("string").alias("statDate"), F.col("epsTTM").cast("string").alias("epsTTM"),
        F.col("roeAvg").cast("string").alias("roeAvg"))))
RN = "ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC)"
q("a16_last_n", CD + "close", f"SELECT code, date, close FROM (SELECT *, {RN} AS r FROM bars) AS s WHERE r <= 60")(
    lambda m: scans.last_n(m.bars(), 60))
q("a17_lookback", CD + "close", f"""SELECT code, date, close FROM (SELECT *, {RN} AS r FROM bars WHERE date <= DATE '1999-06-30') AS s
  WHERE r <= 30""")(lambda m: scans.last_n(m.bars(), 30, D(1999, 6, 30)))
q("a19_latest_close", CD + "close", f"SELECT code, date, close FROM (SELECT *, {RN} AS r FROM bars) AS s WHERE r = 1")(
    lambda m: scans.latest_close(m.bars()))


def two_factors(df):
    return t.bias(t.roc(t.base(df))).select(*df.columns, "roc", "bias")


TWO = f"(close / {lagx('close', 60)} - 1) * 100 AS roc, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias"


def _store(m):
    until = F.when(code_number() % 3 == 0, F.lit(D(1999, 6, 30))).otherwise(F.lit(D(2000, 6, 30)))
    return two_factors(m.bars()).where((F.col("date") <= until) & (code_number() % 4 != 0)).select("code", "date", "roc", "bias")


q("a20_incremental_append", CD + "roc:6 bias:6", f"SELECT code, date, {TWO} FROM bars")(
    lambda m: scans.refreshed_store(_store(m), m.bars(), two_factors, 60))
q("a21_batch_refresh", CD + "roc:6 bias:6 willr:6 psy:6", f"""SELECT code, date, {TWO}, CASE WHEN rn >= 35 THEN
  COALESCE(-100 * ({g('MAX', 'high', 35)} - close) / NULLIF({g('MAX', 'high', 35)} - {g('MIN', 'low', 35)}, 0), 0) END AS willr,
  COALESCE({g('SUM', 'CASE WHEN d > 0 THEN 1 ELSE 0 END', 30)} / 30.0 * 100, 0) AS psy FROM b""", "b")(
    lambda m: t.window_block(t.base(m.bars())))
q("a22_factor_as_of", CD + "roc:6 bias:6 absent", f"""SELECT code, date, COALESCE(roc, 0) AS roc, bias, CAST(0 AS DOUBLE) AS absent FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS r FROM (SELECT code, date, {TWO} FROM bars) AS s
  WHERE date <= DATE '1999-08-18') AS z WHERE r = 1""")(
    lambda m: scans.factor_as_of(two_factors(m.bars()), D(1999, 8, 18), ["roc", "bias", "absent"]))
q("a26_active_sample", "code n_bars", """SELECT code, COUNT(*) AS n_bars FROM bars WHERE date >= DATE '1997-01-01' GROUP BY code
  HAVING COUNT(*) > 200 ORDER BY md5(code), code LIMIT 25""")(lambda m: scans.active_sample(m.bars(), D(1997, 1, 1), 200, 25))
q("a27_cache_statistics", "n_codes n_rows first_date last_date", """SELECT COUNT(DISTINCT code) AS n_codes, COUNT(*) AS n_rows,
  MIN(date) AS first_date, MAX(date) AS last_date FROM bars""")(
    lambda m: two_factors(m.bars()).agg(F.countDistinct("code").alias("n_codes"), F.count(F.lit(1)).alias("n_rows"),
                                        F.min("date").alias("first_date"), F.max("date").alias("last_date")))

# --- price adjustment -------------------------------------------------------
q("p01_adjust_to_base", CD + "adj_open:6 adj_high:6 adj_low:6 adj_close:6", """SELECT b.code, b.date, b.open * r AS adj_open, b.high * r AS adj_high,
  b.low * r AS adj_low, b.close * r AS adj_close FROM (SELECT bf.*, CASE WHEN base.v IS NULL THEN 1 ELSE COALESCE(bf.f, 1) / base.v END AS r
    FROM bf LEFT JOIN (SELECT code, ARG_MAX(fore_adjust_factor, date) AS v FROM adjust_factor WHERE date <= DATE '1999-12-31' GROUP BY code) AS base
      ON base.code = bf.code) AS b""", "bf")(lambda m: adjust.to_base_date(m.bars(), m.adjust_factor(), D(1999, 12, 31)))
q("p02_adjust_as_of", CD + "adj_open:6 adj_high:6 adj_low:6 adj_close:6", f"""SELECT code, date, open * f2 / l AS adj_open, high * f2 / l AS adj_high,
  low * f2 / l AS adj_low, close * f2 / l AS adj_close FROM (SELECT *, LAST_VALUE(f2) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l
    FROM (SELECT *, {FF} AS f2 FROM bf WHERE date <= DATE '2000-03-31') AS s) AS z""", "bf")(
    lambda m: adjust.to_as_of(m.bars(), m.adjust_factor(), D(2000, 3, 31)))
q("p03_adjust_to_sample_end", CD + "open:6 high:6 low:6 close:6", "SELECT * FROM adj", "adj")(
    lambda m: adjust.to_sample_end(m.bars(), m.adjust_factor()))
q("p04_adjust_for_screening", CD + "close:6", f"""SELECT code, date, close FROM (SELECT *, {RN} AS r FROM adj) AS s WHERE r <= 120""", "adj")(
    lambda m: scans.last_n(adjust.to_sample_end(m.bars(), m.adjust_factor()), 120))
