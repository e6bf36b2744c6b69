"""C-rows: joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import NUM, W, cte, g, lagx
from quantweave.operators import adjust, breadth, fundamentals as fu, joins, scans
from quantweave.operators import technical as t
from quantweave.operators.labels import forward_returns
from quantweave.sources.market import code_number

D = dt.date
CD = "code date "


def reports(m):
    return fu.statements(m.profit_ability(), m.growth_ability(), m.balance_ability(), m.dupont())


ANN = """COALESCE(pub_date, CASE EXTRACT(MONTH FROM stat_date) WHEN 3 THEN MAKE_DATE(EXTRACT(YEAR FROM stat_date), 4, 25)
  WHEN 6 THEN MAKE_DATE(EXTRACT(YEAR FROM stat_date), 8, 25) WHEN 9 THEN MAKE_DATE(EXTRACT(YEAR FROM stat_date), 10, 25)
  WHEN 12 THEN MAKE_DATE(EXTRACT(YEAR FROM stat_date) + 1, 4, 20) END)"""
cte("reports", f"""SELECT p.code, p.stat_date, p.pub_date, roeAvg, netProfit, epsTTM, totalShare, YOYPNI, assetToEquity, liabilityToAsset,
  dupontROE, {ANN.replace('pub_date', 'p.pub_date').replace('stat_date', 'p.stat_date')} AS announced_date FROM profit_ability p
  LEFT JOIN growth_ability gr ON gr.code = p.code AND gr.stat_date = p.stat_date
  LEFT JOIN balance_ability ba ON ba.code = p.code AND ba.stat_date = p.stat_date
  LEFT JOIN dupont du ON du.code = p.code AND du.stat_date = p.stat_date""", "profit_ability growth_ability balance_ability dupont")
cte("pit", """SELECT b.*, r.stat_date, r.roeAvg, r.netProfit, r.epsTTM, r.totalShare, r.YOYPNI, r.assetToEquity, r.liabilityToAsset, r.dupontROE
  FROM bars b LEFT JOIN (SELECT *, LEAD(announced_date) OVER (PARTITION BY code ORDER BY announced_date, stat_date) AS until FROM reports) r
    ON r.code = b.code AND r.announced_date <= b.date AND (r.until IS NULL OR b.date < r.until)""", "bars reports")

q("c01_bars_factor", CD + "close fore_adjust_factor:8", "SELECT code, date, close, f AS fore_adjust_factor FROM bf", "bf")(
    lambda m: adjust.with_factor(m.bars(), m.adjust_factor()))
q("c02_four_way_finance", "code stat_date pub_date epsTTM:6 YOYPNI:5 liabilityToAsset:6 assetToEquity:6 dupontROE:5", "SELECT * FROM reports", "reports")(
    reports)
q("c03_as_of_series", CD + "stat_date epsTTM:6 YOYPNI:5 liabilityToAsset:6", "SELECT * FROM pit", "pit")(
    lambda m: fu.pit_series(m.bars(), reports(m)))
SNAP = """SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY announced_date DESC, stat_date DESC) AS r FROM reports
  WHERE announced_date <= DATE '1999-05-31') AS s WHERE r = 1"""
q("c04_as_of_snapshot", "code stat_date announced_date epsTTM:6 YOYPNI:5", SNAP, "reports")(
    lambda m: fu.pit_snapshot(reports(m), D(1999, 5, 31)))
PUB = """SELECT p.*, ba.liabilityToAsset AS debt FROM profit_ability p JOIN (SELECT code, MAX(pub_date) AS mp FROM profit_ability {w} GROUP BY code) AS x
  ON x.code = p.code AND x.mp = p.pub_date LEFT JOIN balance_ability ba ON ba.code = p.code AND ba.stat_date = p.stat_date"""
q("c05_latest_report", "code stat_date pub_date epsTTM:6 liabilityToAsset:6",
  f"SELECT code, stat_date, pub_date, epsTTM, debt AS liabilityToAsset FROM ({PUB.format(w='')}) AS z", "profit_ability balance_ability")(
    lambda m: fu.latest_published(m.profit_ability(), m.balance_ability()))
q("c06_latest_price", CD + "close", "SELECT code, date, close FROM bars WHERE (code, date) IN (SELECT code, MAX(date) FROM bars WHERE date <= DATE '2000-02-15' GROUP BY code)")(
    lambda m: scans.latest_close(m.bars(), D(2000, 2, 15)))


def info_sql(limit):
    w = f"WHERE date <= DATE '{limit}'" if limit else ""
    p = PUB.format(w=f"WHERE pub_date <= DATE '{limit}'" if limit else "")
    return f"""SELECT b.code, b.close AS current_price, b.is_st, f.epsTTM, f.totalShare, f.debt AS debt_ratio, n.code_name,
  CASE WHEN f.epsTTM > 0 THEN b.close / f.epsTTM END AS pe_ratio, b.close * f.totalShare / 1e8 AS market_cap
  FROM (SELECT * FROM bars WHERE (code, date) IN (SELECT code, MAX(date) FROM bars {w} GROUP BY code)) AS b
  LEFT JOIN ({p}) AS f ON f.code = b.code LEFT JOIN stock_basic n ON n.code = b.code"""


INFO_DEPS = "bars profit_ability balance_ability stock_basic"
cte("info", info_sql(None), INFO_DEPS)
cte("info_pit", info_sql("1999-09-30"), INFO_DEPS)


def info(m, as_of=None):
    return fu.info_map(m.bars(), m.profit_ability(), m.balance_ability(), m.stock_basic(), as_of)


q("c07_info_map", "code code_name current_price is_st pe_ratio:8 market_cap:8 debt_ratio:6", "SELECT * FROM info", "info")(info)
q("c08_info_map_pit", "code code_name current_price is_st pe_ratio:8 market_cap:8 debt_ratio:6", "SELECT * FROM info_pit", "info_pit")(
    lambda m: info(m, D(1999, 9, 30)))


def sparse_store(m):
    return t.bias(m.bars()).where((F.weekofyear("date") + code_number()) % 3 == 0).select("code", F.col("date").alias("fdate"), "bias")


q("c09_nearest_past_factor", CD + "fdate bias:6", f"""SELECT b.code, b.date, s.fdate, s.bias FROM bars b ASOF LEFT JOIN (
  SELECT * FROM (SELECT code, date AS fdate, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias FROM bars) AS u
  WHERE (EXTRACT(WEEK FROM fdate) + {NUM}) % 3 = 0) AS s ON s.code = b.code AND s.fdate <= b.date""")(
    lambda m: fu.as_of_join(m.bars(), sparse_store(m), "date", "fdate", ["fdate", "bias"]))
q("c10_next_session", CD + "next_date next_open", """SELECT b.code, b.date, c.next_date, n.open AS next_open FROM bars b JOIN cal c ON c.date = b.date
  LEFT JOIN bars n ON n.code = b.code AND n.date = c.next_date""", "cal")(lambda m: joins.next_session_bar(m.bars()))
cte("breadth", f"""SELECT date, AVG(CASE WHEN close > open * 1.0001::DOUBLE THEN 1 ELSE 0 END) AS up_ratio,
  AVG(CASE WHEN close / open - 1 > 0.05::DOUBLE THEN 1 ELSE 0 END) AS strong_up_ratio, AVG(CASE WHEN close < open * 0.9999::DOUBLE THEN 1 ELSE 0 END) AS down_ratio,
  AVG(CASE WHEN close >= high * 0.9999::DOUBLE AND ret > 0.093::DOUBLE THEN 1 ELSE 0 END) AS limit_up_ratio,
  AVG(CASE WHEN close <= low * 1.0001::DOUBLE AND ret < -0.093::DOUBLE THEN 1 ELSE 0 END) AS limit_down_ratio,
  AVG(close / open - 1) AS mean_return, SUM(volume) AS total_volume,
  SUM(CASE WHEN close > open THEN volume ELSE 0 END) / SUM(volume) AS adv_vol_ratio,
  AVG(CASE WHEN close > ma20 THEN 1 ELSE 0 END) AS breadth_ma20
  FROM (SELECT *, {g('AVG', 'close', 20)} AS ma20 FROM b) AS s GROUP BY date""", "b")
q("c11_attach_breadth", CD + "up_ratio:6 breadth_ma20:6", f"""SELECT b.code, b.date,
  COALESCE(LAST_VALUE(x.up_ratio IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS UNBOUNDED PRECEDING), 0) AS up_ratio,
  COALESCE(LAST_VALUE(x.breadth_ma20 IGNORE NULLS) OVER (PARTITION BY b.code ORDER BY b.date ROWS UNBOUNDED PRECEDING), 0) AS breadth_ma20
  FROM bars b LEFT JOIN (SELECT * FROM breadth WHERE EXTRACT(MONTH FROM date) <> 7) AS x ON x.date = b.date""", "breadth")(
    lambda m: joins.attach_breadth(m.bars(), breadth.breadth(m.bars()).where(F.month("date") != 7), ["up_ratio", "breadth_ma20"]))
q("c12_industry_lookup", CD + "close industry", "SELECT b.code, b.date, b.close, s.industry FROM bars b LEFT JOIN stock_basic s ON s.code = b.code",
  "bars stock_basic")(lambda m: joins.lookup(m.bars(), m.stock_basic(), "industry"))
q("c13_calendar_gaps", CD, """SELECT r.code, c.date FROM (SELECT code, MIN(date) AS a, MAX(date) AS z FROM bars GROUP BY code) AS r
  JOIN cal c ON c.date BETWEEN r.a AND r.z WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.code = r.code AND b.date = c.date)""", "cal")(
    lambda m: joins.missing_sessions(m.bars()))
q("c14_missing_dates", "date", "SELECT DISTINCT date FROM bars WHERE EXTRACT(MONTH FROM date) = 7 AND date > DATE '1998-01-01'")(
    lambda m: joins.missing_dates(m.bars(), m.bars().where((F.month("date") != 7) | (F.col("date") <= F.lit(D(1998, 1, 1))))))
GRID = """SELECT c.code, y.y AS year, q.q AS quarter, LAST_DAY(MAKE_DATE(y.y, q.q * 3, 1)) AS stat_date FROM ({c}) AS c
  JOIN (SELECT UNNEST(RANGE(1990, 2010)) AS y) AS y ON y.y BETWEEN c.a AND c.z CROSS JOIN (SELECT UNNEST([1, 2, 3, 4]) AS q) AS q"""
q("c15_missing_periods", "code year quarter stat_date", "SELECT * FROM (" + GRID.format(c="SELECT DISTINCT code, 1995 AS a, 2001 AS z FROM bars")
  + ") AS g WHERE NOT EXISTS (SELECT 1 FROM balance_ability b WHERE b.code = g.code AND b.stat_date = g.stat_date)", "bars balance_ability")(
    lambda m: joins.missing_periods(joins.quarter_grid(m.bars().select("code").distinct(), F.lit(1995), F.lit(2001)), m.balance_ability()))
PLAN = f"""SELECT code, GREATEST({{b}}, MIN(EXTRACT(YEAR FROM date))) AS a, LEAST(2001, CASE WHEN {NUM} % 2 = 0 THEN 1999 ELSE 9999 END) AS z FROM bars GROUP BY code"""


def plan(m, incremental):
    inst = m.bars().groupBy("code").agg(F.min(F.year("date")).alias("ipo_year")).withColumn(
        "out_year", F.when(code_number() % 2 == 0, 1999))
    return joins.fetch_plan(inst, m.balance_ability(), 2002, 5, incremental)


q("c25_fetch_plan", "code year quarter stat_date", "SELECT * FROM (" + GRID.format(c=PLAN.format(b=1998))
  + ") AS g WHERE NOT EXISTS (SELECT 1 FROM balance_ability b WHERE b.code = g.code AND b.stat_date = g.stat_date)", "bars balance_ability")(
    lambda m: plan(m, False))
q("c25_fetch_plan_incremental", "code year quarter stat_date", "SELECT * FROM (" + GRID.format(
    c=f"SELECT code, GREATEST(a, z - 1) AS a, z FROM ({PLAN.format(b=1998)}) AS p")
  + ") AS g WHERE NOT EXISTS (SELECT 1 FROM balance_ability b WHERE b.code = g.code AND b.stat_date = g.stat_date)", "bars balance_ability")(
    lambda m: plan(m, True))
q("c16_factor_target", CD + "psy:6 target:6", f"""SELECT code, date, COALESCE({g('SUM', 'CASE WHEN d > 0 THEN 1 ELSE 0 END', 30)} / 30.0 * 100, 0) AS psy,
  LEAD(close, 5) OVER ({W}) / close - 1 AS target FROM b QUALIFY LEAD(close, 5) OVER ({W}) IS NOT NULL""", "b")(
    lambda m: t.psy(t.base(m.bars())).select("code", "date", "psy").join(
        forward_returns(m.bars()).select("code", "date", F.col("f_return").alias("target")).where("target is not null"), ["code", "date"]))
q("c17_bars_align_factors", CD + "close bias:6", f"""SELECT b.code, b.date, b.close, s.bias FROM bars b LEFT JOIN (
  SELECT code, date AS fdate, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias FROM bars) AS s
  ON s.code = b.code AND s.fdate = b.date AND (EXTRACT(WEEK FROM s.fdate) + CAST(SUBSTR(s.code, 4) AS BIGINT)) % 3 = 0""")(
    lambda m: m.bars().join(sparse_store(m).withColumnRenamed("fdate", "date"), ["code", "date"], "left"))
q("c23_return_consistency", "code max_return_diff:6 n_returns", f"""SELECT a.code, MAX(ABS(a.r - b.r)) AS max_return_diff, COUNT(a.r) AS n_returns
  FROM (SELECT code, date, c / {lagx('c')} - 1 AS r FROM ra) AS a JOIN (SELECT code, date, c / {lagx('c')} - 1 AS r FROM rb) AS b
    ON a.code = b.code AND a.date = b.date GROUP BY a.code""", "bf", ",\n".join(
      f"""{n} AS (SELECT bf.code, bf.date, close * CASE WHEN base.v IS NULL THEN 1 ELSE COALESCE(f, 1) / base.v END AS c FROM bf LEFT JOIN
  (SELECT code, ARG_MAX(fore_adjust_factor, date) AS v FROM adjust_factor WHERE date <= DATE '{d}' GROUP BY code) AS base ON base.code = bf.code)"""
      for n, d in (("ra", "1997-12-31"), ("rb", "2000-12-31"))))(
    lambda m: adjust.base_dependence(m.bars(), m.adjust_factor(), D(1997, 12, 31), D(2000, 12, 31)))
