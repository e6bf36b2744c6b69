"""R-rows: rolling statistics and risk."""

from __future__ import annotations

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import W, fr, g, lagx
from quantweave.operators import rolling as r
from quantweave.operators import technical as t

CD = "code date "


def b(m):
    return t.base(m.bars())


def sel(*exprs, src="b"):
    return f"SELECT code, date, {', '.join(exprs)} FROM {src}"


q("r01_hl_range", CD + "hl_range_mean:6 hl_range_std:6", sel(
    g("AVG", "(high - low) / close", 20) + " AS hl_range_mean", g("STDDEV_SAMP", "(high - low) / close", 20) + " AS hl_range_std"),
  "b")(lambda m: r.range_stats(b(m)))
q("r02_oc_ratio", CD + "oc_ratio_mean:6 oc_ratio_std:6", sel(
    g("AVG", "(close - open) / open", 20) + " AS oc_ratio_mean", g("STDDEV_SAMP", "(close - open) / open", 20) + " AS oc_ratio_std"),
  "b")(lambda m: r.open_close_stats(b(m)))
q("r03_volatility", CD + "price_volatility_20:6 price_volatility_60:6", sel(
    g("STDDEV_SAMP", "ret", 20) + " AS price_volatility_20", g("STDDEV_SAMP", "ret", 60) + " AS price_volatility_60"), "b")(
    lambda m: r.volatility(b(m)))
q("r04_skew_kurt", CD + "price_skewness:5 price_kurtosis:5 return_skewness:5 return_kurtosis:5", sel(
    g("SKEWNESS", "ret", 20) + " AS price_skewness", g("KURTOSIS", "ret", 20) + " AS price_kurtosis",
    g("SKEWNESS", "ret", 60) + " AS return_skewness", g("KURTOSIS", "ret", 60) + " AS return_kurtosis"), "b")(
    lambda m: r.moments(r.moments(b(m), 20, "price_skewness", "price_kurtosis"), 60, "return_skewness", "return_kurtosis"))
q("r05_range_position", CD + "high_position:6 low_position:6", f"""SELECT code, date, (high - l) / NULLIF(h - l, 0) AS high_position,
  (close - l) / NULLIF(h - l, 0) AS low_position FROM (SELECT *, {g('MAX', 'high', 20)} AS h, {g('MIN', 'low', 20)} AS l FROM b) AS s""",
  "b")(lambda m: r.range_position(b(m)))
q("r06_volume_change", CD + "volume_change_rate:6", sel("volume / " + g("AVG", "volume", 20) + " AS volume_change_rate"), "b")(
    lambda m: r.volume_change(b(m)))
q("r07_volume_volatility", CD + "volume_volatility:6", sel(g("STDDEV_SAMP", "vret", 20) + " AS volume_volatility"), "b")(
    lambda m: r.volume_volatility(b(m)))
q("r08_price_volume_corr", CD + "price_volume_corr:6", sel(
    f"CASE WHEN rn > 20 THEN CORR(ret, vret) OVER {fr(20)} END AS price_volume_corr"), "b")(lambda m: r.price_volume_corr(b(m)))
q("r09_amount_ratios", CD + "amount_per_volume:4 amount_change_rate:6", sel(
    g("AVG", "amount", 20) + " / " + g("AVG", "volume", 20) + " AS amount_per_volume",
    "amount / " + g("AVG", "amount", 20) + " AS amount_change_rate"), "b")(lambda m: r.amount_ratios(b(m)))
q("r10_returns", CD + "return_5d:6 return_10d:6 return_20d:6 return_60d:6", sel(
    *[f"close / {lagx('close', k)} - 1 AS return_{k}d" for k in (5, 10, 20, 60)]), "b")(lambda m: r.returns_k(b(m)))
q("r11_momentum", CD + "momentum_5d:6 momentum_10d:6 momentum_20d:6 acceleration:6",
  f"""SELECT *, momentum_10d - LAG(momentum_20d, 10) OVER ({W}) AS acceleration FROM (""" + sel(
      *[g("SUM", "ret", k) + f" AS momentum_{k}d" for k in (5, 10, 20)]) + ") AS s", "b")(lambda m: r.momentum_sums(b(m)))
NEG = "CASE WHEN ret <= 0 THEN ret END"
q("r12_downside_risk", CD + "downside_risk:6 downside_risk_partial:6", sel(
    g("STDDEV_SAMP", NEG, 20) + " AS downside_risk",
    f"CASE WHEN COUNT({NEG}) OVER {fr(20)} >= 2 THEN STDDEV_SAMP({NEG}) OVER {fr(20)} END AS downside_risk_partial"), "b")(
    lambda m: r.downside_risk(r.downside_risk(b(m)), min_periods=2))
q("r13_drawdown", CD + "drawdown:6 max_drawdown_20:6", f"""SELECT code, date, dd AS drawdown, {g('MIN', 'dd', 20)} AS max_drawdown_20 FROM (
  SELECT code, date, c / MAX(c) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM (
    SELECT code, date, EXP(SUM(LN(1 + COALESCE(ret, 0))) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS c FROM b) AS s) AS z""", "b")(
    lambda m: r.drawdown(b(m)))
q("r14_sharpe", CD + "sharpe_ratio:5", sel(g("AVG", "ret", 20) + " / NULLIF(" + g("STDDEV_SAMP", "ret", 20) + ", 0) * SQRT(252) AS sharpe_ratio"),
  "b")(lambda m: r.rolling_sharpe(b(m)))
q("r15_clean_block", CD + "price_volatility_20:6 sharpe_ratio:5 return_60d:6 downside_risk:6 low_position:6", sel(
    f"COALESCE({g('STDDEV_SAMP', 'ret', 20)}, 0) AS price_volatility_20",
    "COALESCE(" + g("AVG", "ret", 20) + " / NULLIF(" + g("STDDEV_SAMP", "ret", 20) + ", 0) * SQRT(252), 0) AS sharpe_ratio",
    f"COALESCE(close / {lagx('close', 60)} - 1, 0) AS return_60d", f"COALESCE({g('STDDEV_SAMP', NEG, 20)}, 0) AS downside_risk",
    f"COALESCE((close - {g('MIN', 'low', 20)}) / NULLIF({g('MAX', 'high', 20)} - {g('MIN', 'low', 20)}, 0), 0) AS low_position"), "b")(
    lambda m: r.rolling_block(t.warm(b(m))))
