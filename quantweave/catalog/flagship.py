"""Flagship screen and the breadth rows D01-D03."""

from __future__ import annotations

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import g, lagx
from quantweave.operators import breadth
from quantweave.plans.screen import flagship

FEATS = {
    "mtm": f"COALESCE(close - {lagx('close', 40)}, 0)",
    "bias": f"COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0)",
    "ma_ratio": f"COALESCE({g('AVG', 'close', 120)} / close, 0)",
    "willr": f"COALESCE(-100 * ({g('MAX', 'high', 35)} - close) / NULLIF({g('MAX', 'high', 35)} - {g('MIN', 'low', 35)}, 0), 0)",
    "vol_ma": f"COALESCE({g('AVG', 'volume', 5)} / {g('AVG', 'volume', 25)}, 0)",
    "low_position": f"COALESCE((close - {g('MIN', 'low', 20)}) / NULLIF({g('MAX', 'high', 20)} - {g('MIN', 'low', 20)}, 0), 0)",
}
RANK = "(RANK() OVER (PARTITION BY date ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / (COUNT(*) OVER (PARTITION BY date) + 1)"
SCORE = " + ".join(RANK.format(x=f"ROUND({x}, 6)") for x in FEATS)
q("flagship_screen", "date code score:6 place", f"""SELECT * FROM (SELECT date, code, score, ROW_NUMBER() OVER (PARTITION BY date ORDER BY ROUND(score, 9) DESC, code) AS place
  FROM (SELECT date, code, ({SCORE}) / 6 AS score FROM f) AS s) AS z WHERE place <= 5""", "adj",
  "f AS MATERIALIZED (SELECT code, date, " + ", ".join(f"{v} AS {k}" for k, v in FEATS.items()) + " FROM adj)")(flagship)

ST = """SELECT date, COUNT(*) AS n, CAST(SUM(CASE WHEN close > open * 1.0001::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS up_count,
  CAST(SUM(CASE WHEN close / open - 1 > 0.05::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS strong_up_count,
  CAST(SUM(CASE WHEN close < open * 0.9999::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS down_count,
  CAST(SUM(CASE WHEN close >= high * 0.9999::DOUBLE AND ret > 0.093::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS limit_up_count,
  CAST(SUM(CASE WHEN close <= low * 1.0001::DOUBLE AND ret < -0.093::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS limit_down_count,
  AVG(close / open - 1) AS mean_return, SUM(volume) AS total_volume, SUM(CASE WHEN close > open THEN volume ELSE 0 END) AS adv_volume
  FROM b GROUP BY date"""
q("d01_breadth_stats", "date n up_count strong_up_count down_count limit_up_count limit_down_count mean_return:7 total_volume adv_volume", ST, "b")(
    lambda m: breadth.stats(m.bars()))
q("d02_ma20_breadth", "date breadth_ma20:6", f"""SELECT date, AVG(CASE WHEN close > ma THEN 1 ELSE 0 END) AS breadth_ma20 FROM (
  SELECT date, close, {g('AVG', 'close', 20)} AS ma FROM bars) AS s GROUP BY date""")(lambda m: breadth.above_ma20(m.bars()))
q("d03_breadth_ratios", "date up_ratio:6 strong_up_ratio:6 down_ratio:6 limit_up_ratio:6 limit_down_ratio:6 mean_return:7 total_volume adv_vol_ratio:6 breadth_ma20:6",
  "SELECT * FROM breadth", "breadth")(lambda m: breadth.breadth(m.bars()))
