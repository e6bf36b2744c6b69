"""E-rows that smooth recursively; the checks use recursive CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import W, fr, g
from quantweave.operators.recursive import recursive
from quantweave.plans import exits

CD = "code date "


def smooth(name, src, x, start, n, alpha):
    """Recursive CTE: mean of rows start..start+n-1 as seed, then v += alpha * (x - v)."""
    return f"""{name} AS (/*rec*/ SELECT code, start_rn AS rn, v FROM (SELECT code, MAX(rn) AS start_rn, AVG({x}) AS v FROM {src}
    WHERE rn BETWEEN {start} AND {start + n - 1} GROUP BY code) AS seed
  UNION ALL SELECT t.code, t.rn, e.v + {alpha} * (t.{x} - e.v) FROM {name} e JOIN {src} t ON t.code = e.code AND t.rn = e.rn + 1)"""


def ema(name, src, x, start, n):
    return smooth(name, src, x, start, n, f"(2.0 / {n + 1})")


def wild(name, src, x, start, n):
    return smooth(name, src, x, start, n, f"(1.0 / {n})")


def moves(x):
    return f"""mv AS MATERIALIZED (SELECT code, date, rn, GREATEST(dx, 0) AS up, GREATEST(-dx, 0) AS dn FROM
  (SELECT code, date, rn, {x} - LAG({x}) OVER ({W}) AS dx FROM b) AS s WHERE dx IS NOT NULL)"""


def rsi_sql(x, n):
    return ",\n".join([moves(x), wild("u", "mv", "up", 2, n), wild("w", "mv", "dn", 2, n)])


UW = "SELECT b.code, b.date, {e} FROM b LEFT JOIN u ON u.code = b.code AND u.rn = b.rn LEFT JOIN w ON w.code = b.code AND w.rn = b.rn"
RSI = "CASE WHEN u.v + w.v = 0 THEN 0 ELSE 100 * u.v / (u.v + w.v) END"

q("e01_rsi", CD + "rsi:5", UW.format(e=RSI + " AS rsi"), "b", rsi_sql("close", 42))(lambda m: recursive(m.bars(), ["rsi"]))
q("e01_rsi_12", CD + "rsi_12:5", UW.format(e=RSI + " AS rsi_12"), "b", rsi_sql("close", 12))(
    lambda m: recursive(m.bars(), ["rsi_12"]))
q("e04_cmo", CD + "cmo:5", UW.format(e="CASE WHEN u.v + w.v = 0 THEN 0 ELSE 100 * (u.v - w.v) / (u.v + w.v) END AS cmo"), "b",
  rsi_sql("close", 42))(lambda m: recursive(m.bars(), ["cmo"]))
q("e05_stochrsi", CD + "stochrsi_k:4 stochrsi_d:4", f"""SELECT code, date, CASE WHEN sd IS NOT NULL THEN k END AS stochrsi_k, sd AS stochrsi_d
  FROM (SELECT code, date, k, {g('AVG', 'k', 3)} AS sd FROM (
   SELECT code, date, CASE WHEN hi > lo THEN 100 * (r - lo) / (hi - lo) WHEN hi = lo THEN 0 END AS k FROM (
    SELECT code, date, r, {g('MAX', 'r', 5)} AS hi, {g('MIN', 'r', 5)} AS lo FROM ({UW.format(e=RSI + ' AS r')}) AS a) AS c) AS d) AS e""",
  "b", rsi_sql("close", 28))(lambda m: recursive(m.bars(), ["stochrsi"]))
KDJ = f"""rs AS MATERIALIZED (SELECT code, date, rn, COALESCE(100 * (close - lo) / NULLIF(hi - lo, 0), 50) AS rsv FROM (
  SELECT code, date, rn, close, {g('MAX', 'high', 28)} AS hi, {g('MIN', 'low', 28)} AS lo FROM b) AS s),
kd AS (/*rec*/ SELECT code, date, rn, rsv AS k, rsv AS d FROM rs WHERE rn = 1
  UNION ALL SELECT r.code, r.date, r.rn, p.k * 2 / 3 + r.rsv / 3, p.d * 2 / 3 + (p.k * 2 / 3 + r.rsv / 3) / 3
  FROM kd p JOIN rs r ON r.code = p.code AND r.rn = p.rn + 1)"""
q("e08_kdj", CD + "kdj_k:5 kdj_d:5 kdj_j:5", "SELECT code, date, k AS kdj_k, d AS kdj_d, 3 * k - 2 * d AS kdj_j FROM kd", "b", KDJ)(
    lambda m: recursive(m.bars(), ["kdj"]))


def macd_sql(x, f, s, sig):
    return ",\n".join([
        ema("ef", "b", x, s - f + 1, f), ema("es", "b", x, 1, s),
        "ln AS MATERIALIZED (SELECT ef.code, ef.rn, ef.v - es.v AS x FROM ef JOIN es ON ef.code = es.code AND ef.rn = es.rn)",
        ema("sg", "ln", "x", s, sig)])


MACD = """FROM b LEFT JOIN sg ON sg.code = b.code AND sg.rn = b.rn LEFT JOIN ln ON ln.code = sg.code AND ln.rn = sg.rn"""
q("e09_macd", CD + "macd:7 macd_signal:7 macd_hist:7", "SELECT b.code, b.date, ln.x / b.close AS macd, sg.v / b.close AS macd_signal, "
  "(ln.x - sg.v) / b.close AS macd_hist " + MACD, "b", macd_sql("close", 25, 90, 20))(lambda m: recursive(m.bars(), ["macd"]))
q("e28_vmacd", CD + "vmacd:5 vmacd_signal:5", "SELECT b.code, b.date, ln.x AS vmacd, sg.v AS vmacd_signal " + MACD, "b",
  macd_sql("volume", 25, 60, 20))(lambda m: recursive(m.bars(), ["vmacd"]))
TR = "GREATEST(high - low, ABS(high - pc), ABS(low - pc))"


def dmi_sql(n):
    dec = []
    for name, x in (("sp", "pdm"), ("sm", "mdm"), ("st", "tr")):
        dec.append(f"""{name} AS (/*rec*/ SELECT code, CAST({n} AS BIGINT) AS rn, SUM({x}) AS v FROM dm WHERE rn BETWEEN 2 AND {n} GROUP BY code
  UNION ALL SELECT t.code, t.rn, e.v - e.v / {n} + t.{x} FROM {name} e JOIN dm t ON t.code = e.code AND t.rn = e.rn + 1)""")
    return f"""dm AS MATERIALIZED (SELECT code, date, rn, CASE WHEN up > 0 AND up > dn THEN up ELSE 0 END AS pdm,
  CASE WHEN dn > 0 AND dn > up THEN dn ELSE 0 END AS mdm, tr FROM (SELECT code, date, rn, high - LAG(high) OVER ({W}) AS up,
    LAG(low) OVER ({W}) - low AS dn, {TR} AS tr FROM b) AS s WHERE rn > 1),
""" + ",\n".join(dec) + f""",
di AS MATERIALIZED (SELECT st.code, st.rn, CASE WHEN st.v = 0 THEN 0 ELSE 100 * sp.v / st.v END AS p,
  CASE WHEN st.v = 0 THEN 0 ELSE 100 * sm.v / st.v END AS m FROM st JOIN sp ON sp.code = st.code AND sp.rn = st.rn
  JOIN sm ON sm.code = st.code AND sm.rn = st.rn WHERE st.rn > {n})"""


q("e10_adx", CD + "adx:5", "SELECT b.code, b.date, ax.v AS adx FROM b LEFT JOIN ax ON ax.code = b.code AND ax.rn = b.rn", "b",
  dmi_sql(35) + """,
dx AS MATERIALIZED (SELECT code, rn, COALESCE(LAST_VALUE(CASE WHEN p + m <> 0 THEN 100 * ABS(p - m) / (p + m) END IGNORE NULLS)
  OVER (PARTITION BY code ORDER BY rn ROWS UNBOUNDED PRECEDING), 0) AS x FROM di),
""" + wild("ax", "dx", "x", 36, 35))(lambda m: recursive(m.bars(), ["adx"]))
q("e11_dmi", CD + "plus_di:5 minus_di:5", """SELECT b.code, b.date, di.p AS plus_di, di.m AS minus_di
  FROM b LEFT JOIN di ON di.code = b.code AND di.rn = b.rn""", "b", dmi_sql(35))(lambda m: recursive(m.bars(), ["dmi"]))
q("e13_trix", CD + "trix:6", """SELECT b.code, b.date, 100 * (e3.v / p.v - 1) AS trix FROM b LEFT JOIN e3 ON e3.code = b.code AND e3.rn = b.rn
  LEFT JOIN e3 AS p ON p.code = b.code AND p.rn = b.rn - 1""", "b", ",\n".join([
      ema("e1", "b", "close", 1, 30), "s1 AS MATERIALIZED (SELECT code, rn, v AS x FROM e1)", ema("e2", "s1", "x", 30, 30),
      "s2 AS MATERIALIZED (SELECT code, rn, v AS x FROM e2)", ema("e3", "s2", "x", 59, 30)]))(
    lambda m: recursive(m.bars(), ["trix"]))
TRC = f"tr AS MATERIALIZED (SELECT code, rn, {TR} AS x FROM b WHERE rn > 1)"
q("e17_atr", CD + "atr:7", "SELECT b.code, b.date, a.v / b.close AS atr FROM b LEFT JOIN a ON a.code = b.code AND a.rn = b.rn", "b",
  TRC + ",\n" + wild("a", "tr", "x", 2, 30))(lambda m: recursive(m.bars(), ["atr"]))
q("e18_natr", CD + "natr:5", "SELECT b.code, b.date, 100 * a.v / b.close AS natr FROM b LEFT JOIN a ON a.code = b.code AND a.rn = b.rn",
  "b", TRC + ",\n" + wild("a", "tr", "x", 2, 28))(lambda m: recursive(m.bars(), ["natr"]))
ADO = f"""al AS MATERIALIZED (SELECT code, date, rn, volume, SUM(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END)
    OVER ({W} ROWS UNBOUNDED PRECEDING) AS x FROM b),
ao AS (/*rec*/ SELECT code, rn, x AS f, x AS s FROM al WHERE rn = 1
  UNION ALL SELECT t.code, t.rn, p.f + 0.5 * (t.x - p.f), p.s + 0.25 * (t.x - p.s) FROM ao p JOIN al t ON t.code = p.code AND t.rn = p.rn + 1)"""
q("e24_adosc", CD + "adosc:6", f"""SELECT a.code, a.date, COALESCE(CASE WHEN a.rn >= 7 THEN (o.f - o.s) / a.vm END, 0) AS adosc
  FROM (SELECT code, date, rn, {g('AVG', 'volume', 20)} AS vm FROM al) AS a JOIN ao o ON o.code = a.code AND o.rn = a.rn""", "b", ADO)(
    lambda m: recursive(m.bars(), ["adosc"]))
q("e27_vrsi", CD + "vrsi:5", UW.format(e=RSI + " AS vrsi"), "b", rsi_sql("volume", 21))(lambda m: recursive(m.bars(), ["vrsi"]))
q("e41_atr_exits", "code date close atr:5 stop_loss:5 take_profit:5", """SELECT b.code, b.date, b.close, COALESCE(a.v, 0) AS atr,
  b.close - COALESCE(a.v, 0) AS stop_loss, b.close + 4 * COALESCE(a.v, 0) AS take_profit
  FROM b LEFT JOIN a ON a.code = b.code AND a.rn = b.rn WHERE b.rn = b.n_rows""", "b", TRC + ",\n" + wild("a", "tr", "x", 2, 30))(
    lambda m: exits.wilder_stops(m.bars()))
