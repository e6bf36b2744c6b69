"""E-rows: indicators expressible with windows."""

from __future__ import annotations

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import W, fr, g, lagx
from quantweave.operators import technical as t

CD = "code date "


def b(m):
    return t.base(m.bars())


def nz(x, d="0"):
    return f"COALESCE({x}, {d})"


def dv(a, c):
    return f"({a}) / NULLIF({c}, 0)"


q("e02_roc", CD + "roc:6", f"SELECT code, date, (close / {lagx('close', 60)} - 1) * 100 AS roc FROM bars")(
    lambda m: t.roc(b(m)))
q("e03_mtm", CD + "mtm", f"SELECT code, date, {nz('close - ' + lagx('close', 40))} AS mtm FROM bars")(
    lambda m: t.mtm(b(m)))


def _rvi(guard):
    up, dn = "CASE WHEN d > 0 THEN high - low END", "CASE WHEN d < 0 THEN high - low END"

    def sd(x):
        return f"CASE WHEN COUNT({x}) OVER {fr(14)} >= {guard} THEN STDDEV_SAMP({x}) OVER {fr(14)} END"
    return f"SELECT code, date, {sd(up)} AS u, {sd(dn)} AS w FROM b"


q("e06_rvi", CD + "rvi:6 rvi_partial:5", f"""SELECT x.code, x.date, COALESCE(100 * x.u / NULLIF(x.u + x.w, 0), 50) AS rvi,
  COALESCE(100 * y.u / NULLIF(y.u + y.w, 0), 50) AS rvi_partial
  FROM ({_rvi(14)}) x JOIN ({_rvi(2)}) y ON x.code = y.code AND x.date = y.date""", "b")(
    lambda m: t.rvi(t.rvi(b(m)), min_periods=2))
q("e07_ulcer", CD + "ulcer:6", f"""SELECT code, date, {nz('SQRT(' + g('AVG', 'sq', 35) + ')')} AS ulcer
  FROM (SELECT code, date, POW((close - top) / top, 2) AS sq
        FROM (SELECT code, date, close, {g('MAX', 'close', 35)} AS top FROM bars) AS s1) AS s2""")(
    lambda m: t.ulcer(b(m)))
q("e12_aroon", CD + "aroon_up:6 aroon_down:6", """SELECT a.code, a.date,
  CASE WHEN a.rn > 50 THEN 100.0 * (50 - (a.rn - MAX(CASE WHEN z.high = h.hi THEN z.rn END))) / 50 END AS aroon_up,
  CASE WHEN a.rn > 50 THEN 100.0 * (50 - (a.rn - MAX(CASE WHEN z.low = h.lo THEN z.rn END))) / 50 END AS aroon_down
  FROM b a JOIN h ON a.code = h.code AND a.rn = h.rn JOIN b z ON a.code = z.code AND z.rn BETWEEN a.rn - 50 AND a.rn
  GROUP BY a.code, a.date, a.rn""", "b",
  f"h AS (SELECT code, rn, MAX(high) OVER {fr(51)} AS hi, MIN(low) OVER {fr(51)} AS lo FROM b)")(
    lambda m: t.aroon(b(m)))
q("e14_ma_ratio", CD + "ma_ratio:6", f"SELECT code, date, {g('AVG', 'close', 120)} / close AS ma_ratio FROM bars")(
    lambda m: t.ma_ratio(b(m)))
q("e15_ma_slope", CD + "ma_slope:5", f"""SELECT code, date, {nz(f"CASE WHEN COUNT(ma) OVER {fr(30)} = 30 THEN REGR_SLOPE(ma, rn) OVER {fr(30)} END")} AS ma_slope
  FROM (SELECT code, date, rn, {g('AVG', 'close', 30)} AS ma FROM b) AS s""", "b")(lambda m: t.ma_slope(b(m)))
q("e16_price_slope", CD + "price_slope:5", f"""SELECT code, date,
  {nz(f"CASE WHEN rn >= 20 THEN REGR_SLOPE(close, rn) OVER {fr(20)} END")} AS price_slope FROM b""", "b")(
    lambda m: t.price_slope(b(m)))
q("e19_bollinger", CD + "bb_width:6 bb_position:6", f"""SELECT code, date, {nz(dv('3 * s', 'a'))} AS bb_width,
  {nz(dv('close - (a - 1.5 * s)', '3 * s'), '0.5')} AS bb_position
  FROM (SELECT code, date, close, {g('AVG', 'close', 100)} AS a, {g('STDDEV_POP', 'close', 100)} AS s FROM bars) AS z""")(
    lambda m: t.bollinger(b(m)))
q("e20_cci", CD + "cci:5", """SELECT a.code, a.date, CASE WHEN a.rn >= 35 THEN
  COALESCE((a.tp - a.m) / NULLIF(0.015 * AVG(ABS(z.tp - a.m)), 0), 0) END AS cci
  FROM a JOIN b z ON a.code = z.code AND z.rn BETWEEN a.rn - 34 AND a.rn GROUP BY a.code, a.date, a.rn, a.tp, a.m""", "b",
  f"a AS (SELECT code, date, rn, tp, {g('AVG', 'tp', 35)} AS m FROM b)")(lambda m: t.cci(b(m)))
q("e21_price_var", CD + "price_var:6", f"""SELECT code, date, {nz(g('VAR_SAMP', 'COALESCE(ret, 0)', 30))} AS price_var FROM b""",
  "b")(lambda m: t.price_var(b(m)))
REL = "({x} - {a}) / NULLIF({v}, 0)"
q("e22_obv", CD + "obv:6", f"""SELECT code, date, {nz(dv('o - ' + g('AVG', 'o', 20), g('AVG', 'volume', 20)))} AS obv
  FROM (SELECT code, date, volume, SUM(CASE WHEN rn = 1 THEN volume ELSE SIGN(d) * volume END)
    OVER ({W} ROWS UNBOUNDED PRECEDING) AS o FROM b) AS s""", "b")(lambda m: t.obv(b(m)))
AD = f"""ad AS (SELECT *, SUM(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END)
    OVER ({W} ROWS UNBOUNDED PRECEDING) AS adl FROM b)"""
q("e23_ad", CD + "ad:6", f"""SELECT code, date, {nz(dv('adl - ' + g('AVG', 'adl', 20), g('AVG', 'volume', 20)))} AS ad FROM ad""",
  "b", AD)(lambda m: t.ad(b(m)))
q("e25_mfi", CD + "mfi:6", """SELECT code, date, CASE WHEN p + n < 1 THEN 0 ELSE 100 * p / (p + n) END AS mfi FROM (
  SELECT code, date, """ + g("SUM", "CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp > ptp THEN tp * volume ELSE 0 END END", 35)
  + " AS p, " + g("SUM", "CASE WHEN ptp IS NOT NULL THEN CASE WHEN tp < ptp THEN tp * volume ELSE 0 END END", 35)
  + " AS n FROM b) AS s", "b")(lambda m: t.mfi(b(m)))
q("e26_vroc", CD + "vroc:6", f"SELECT code, date, (volume / {lagx('volume', 36)} - 1) * 100 AS vroc FROM bars")(
    lambda m: t.roc(b(m), 36, "volume", "vroc"))


def _pair(x, out):
    return f"SELECT code, date, {nz(dv(g('AVG', x, 5), g('AVG', x, 25)))} AS {out} FROM bars"


def _std(x, out):
    return f"SELECT code, date, {nz(dv(g('STDDEV_SAMP', x, 10), g('AVG', x, 10)))} AS {out} FROM bars"


q("e29_vol_ma", CD + "vol_ma:6", _pair("volume", "vol_ma"))(lambda m: t.ma_pair(b(m), "volume", 5, "vol_ma"))
q("e30_vol_std", CD + "vol_std:6", _std("volume", "vol_std"))(lambda m: t.std_ratio(b(m), "volume", 10, "vol_std"))
q("e31_amount_ma", CD + "amount_ma:6", _pair("amount", "amount_ma"))(lambda m: t.ma_pair(b(m), "amount", 5, "amount_ma"))
q("e32_amount_std", CD + "amount_std:6", _std("amount", "amount_std"))(
    lambda m: t.std_ratio(b(m), "amount", 10, "amount_std"))
q("e33_willr", CD + "willr:6", f"""SELECT code, date, CASE WHEN h IS NOT NULL THEN COALESCE(-100 * (h - close) / NULLIF(h - l, 0), 0) END AS willr
  FROM (SELECT code, date, close, {g('MAX', 'high', 35)} AS h, {g('MIN', 'low', 35)} AS l FROM bars) AS s""")(
    lambda m: t.willr(b(m)))
q("e34_bias", CD + "bias:6", f"SELECT code, date, {nz('100 * (close / ' + g('AVG', 'close', 36) + ' - 1)')} AS bias FROM bars")(
    lambda m: t.bias(b(m)))
q("e35_vr", CD + "vr:6", "SELECT code, date, " + nz(dv(g("SUM", "CASE WHEN d > 0 THEN volume ELSE 0 END", 52),
                                                      g("SUM", "CASE WHEN d < 0 THEN volume ELSE 0 END", 52)))
  + " AS vr FROM b", "b")(lambda m: t.vr(b(m)))
q("e36_psy", CD + "psy:6", "SELECT code, date, " + nz(g("SUM", "CASE WHEN d > 0 THEN 1 ELSE 0 END", 30) + " / 30.0 * 100")
  + " AS psy FROM b", "b")(lambda m: t.psy(b(m)))
q("e37_ar_br", CD + "ar:5 br:5", "SELECT code, date, " + nz("100 * " + dv(g("SUM", "(high - open)", 52), g("SUM", "(open - low)", 52)))
  + " AS ar, " + nz("100 * " + dv(g("SUM", "(high - pc)", 52), g("SUM", "(pc - low)", 52))) + " AS br FROM b", "b")(
    lambda m: t.ar_br(b(m)))
q("e38_cr", CD + "cr:5", "SELECT code, date, " + nz("100 * " + dv(
    g("SUM", "CASE WHEN ptp IS NULL THEN NULL WHEN high > ptp THEN high - ptp ELSE 0 END", 52),
    g("SUM", "CASE WHEN ptp IS NULL THEN NULL WHEN ptp > low THEN ptp - low ELSE 0 END", 52))) + " AS cr FROM b", "b")(
    lambda m: t.cr(b(m)))
q("e39_fill", CD + "roc:6 willr:6 mfi:6", f"""SELECT code, date,
  COALESCE(LAST_VALUE(r IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS roc,
  COALESCE(LAST_VALUE(wr IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS willr,
  COALESCE(LAST_VALUE(mf IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0) AS mfi
  FROM (SELECT code, date, (close / {lagx('close', 60)} - 1) * 100 AS r,
    CASE WHEN rn >= 35 THEN COALESCE(-100 * (MAX(high) OVER {fr(35)} - close) / NULLIF(MAX(high) OVER {fr(35)} - MIN(low) OVER {fr(35)}, 0), 0) END AS wr,
    CASE WHEN rn > 35 THEN 100 * SUM(CASE WHEN tp > ptp THEN tp * volume ELSE 0 END) OVER {fr(35)}
      / NULLIF(SUM(CASE WHEN tp <> ptp THEN tp * volume ELSE 0 END) OVER {fr(35)}, 0) END AS mf FROM b) AS s""", "b")(
    lambda m: t.fill_block(t.mfi(t.willr(t.roc(t.warm(b(m))))), ["roc", "willr", "mfi"]))
q("e40_simple_atr", CD + "atr_simple:6", f"""SELECT code, date, CASE WHEN rn > 30 THEN
  AVG(CASE WHEN pc IS NULL THEN high - low ELSE GREATEST(high - low, ABS(high - pc), ABS(low - pc)) END) OVER {fr(30)} END AS atr_simple
  FROM b""", "b")(lambda m: t.simple_atr(b(m)))
