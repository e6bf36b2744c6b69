"""U-rows: point-in-time fundamentals."""

from __future__ import annotations

import datetime as dt

from quantweave.catalog.core import q
from quantweave.catalog.joins import SNAP, reports
from quantweave.catalog.sqlkit import cte, g, lagx
from quantweave.operators import fundamentals as fu
from quantweave.operators import scans

D = dt.date
CD = "code date "
cte("val", """SELECT *, close / NULLIF(epsTTM, 0) AS dynamic_pe, CASE WHEN volume % 3 <> 0 THEN close / 10 END AS pbMRQ,
  CASE WHEN volume % 2 = 0 THEN close / 3 ELSE close / NULLIF(epsTTM, 0) END AS pe_vendor FROM pit""", "pit")


def pit(m):
    return fu.pit_series(m.bars(), reports(m))


def with_vendor(m):
    from pyspark.sql import functions as F
    return pit(m).withColumns({"pbMRQ": F.when(F.col("volume") % 3 != 0, F.col("close") / 10),
                               "peTTM": F.when(F.col("volume") % 2 == 0, F.col("close") / 3)})


q("u01_announcement_date", "code stat_date pub_date announced_date", "SELECT * FROM reports", "reports")(reports)
q("u02_pit_series", CD + "stat_date roeAvg:6 netProfit:4 epsTTM:6 totalShare YOYPNI:5 assetToEquity:6 liabilityToAsset:6 dupontROE:5", "SELECT * FROM pit", "pit")(pit)
q("u03_valuation", CD + "dynamic_pe:8 dynamic_pb:6 inv_pe:6 inv_pb:6", """SELECT code, date, pe_vendor AS dynamic_pe, pbMRQ AS dynamic_pb, 1 / NULLIF(pe_vendor, 0) AS inv_pe,
  1 / NULLIF(pbMRQ, 0) AS inv_pb FROM val""", "val")(lambda m: fu.valuation(with_vendor(m)))
q("u04_market_cap", CD + "market_cap:9", "SELECT code, date, close * totalShare / 1e8 AS market_cap FROM pit", "pit")(lambda m: fu.valuation(pit(m)))
q("u05_quality", CD + "roe_x_np_growth:6 roe_to_pb:6", """SELECT code, date, CASE WHEN YOYPNI IS NOT NULL THEN roeAvg * GREATEST(LEAST(YOYPNI / 100, 10), -10) END AS roe_x_np_growth,
  CASE WHEN pbMRQ > 0 THEN roeAvg / pbMRQ END AS roe_to_pb FROM val""", "val")(lambda m: fu.quality(fu.valuation(with_vendor(m))))
q("u06_peg", CD + "peg:8", "SELECT code, date, CASE WHEN dynamic_pe > 0 AND YOYPNI > 0 THEN dynamic_pe / YOYPNI END AS peg FROM val", "val")(
    lambda m: fu.peg(fu.valuation(pit(m))))
q("u07_sue", CD + "sue:4", f"SELECT code, date, (YOYPNI - {g('AVG', 'YOYPNI', 250)}) / NULLIF({g('STDDEV_SAMP', 'YOYPNI', 250)}, 0) AS sue FROM pit", "pit")(
    lambda m: fu.surprise(pit(m)))
q("u08_eav", CD + "eav:5", f"SELECT code, date, YOYPNI - {lagx('YOYPNI', 20)} AS eav FROM pit", "pit")(lambda m: fu.acceleration(pit(m)))
q("u09_snapshot_with_price", "code stat_date dynamic_pe:8 inv_pe:6 peg:8", f"""SELECT s.code, s.stat_date, CASE WHEN p.close > 0 AND epsTTM > 0 THEN p.close / epsTTM END AS dynamic_pe,
  CASE WHEN p.close > 0 AND epsTTM > 0 THEN epsTTM / p.close END AS inv_pe, CASE WHEN epsTTM > 0 AND YOYPNI > 0 THEN p.close / epsTTM / YOYPNI END AS peg
  FROM ({SNAP}) AS s LEFT JOIN (SELECT * FROM bars WHERE (code, date) IN (SELECT code, MAX(date) FROM bars WHERE date <= DATE '1999-05-31' GROUP BY code)) AS p
    ON p.code = s.code""", "reports bars")(
    lambda m: fu.snapshot_with_price(reports(m), scans.latest_close(m.bars(), D(1999, 5, 31)), D(1999, 5, 31)))
HIST = "(SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY stat_date DESC) AS slot FROM reports) AS h"
q("u10_statement_history", "code stat_date slot epsTTM:6 YOYPNI:5", f"SELECT * FROM {HIST} WHERE slot <= 12", "reports")(
    lambda m: fu.statement_history(reports(m)))
q("u10_history_lists", "code periods report_date current_eps:6 previous_eps:6", f"""SELECT code, COUNT(*) AS periods, MAX(stat_date) AS report_date,
  MAX(CASE WHEN slot = 1 THEN epsTTM END) AS current_eps, MAX(CASE WHEN slot = 2 THEN epsTTM END) AS previous_eps FROM {HIST} WHERE slot <= 12 GROUP BY code""",
  "reports")(lambda m: fu.history_lists(reports(m)))
q("u11_valuation_now", "code date close pe:5", f"""SELECT b.code, b.date, b.close, CASE WHEN h.epsTTM > 0 THEN b.close / h.epsTTM END AS pe FROM bars b
  LEFT JOIN (SELECT * FROM {HIST} WHERE slot = 1) AS h ON h.code = b.code WHERE (b.code, b.date) IN (SELECT code, MAX(date) FROM bars GROUP BY code)""", "reports bars")(
    lambda m: fu.valuation_now(m.bars(), reports(m)))
