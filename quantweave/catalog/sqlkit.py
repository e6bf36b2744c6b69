"""Common table expressions and text helpers of the DuckDB checks.

Written on their own from the definition of each measure; nothing here is
used by the Spark operators.
"""

from __future__ import annotations


def code_sql(k: str) -> str:
    return (f"(CASE {k} % 8 WHEN 0 THEN '600' WHEN 1 THEN '000' WHEN 2 THEN '300' WHEN 3 THEN '688' "
            f"WHEN 4 THEN '430' WHEN 5 THEN '830' WHEN 6 THEN '870' ELSE '920' END || "
            f"CASE WHEN LENGTH(CAST({k} // 8 AS VARCHAR)) < 3 THEN LPAD(CAST({k} // 8 AS VARCHAR), 3, '0') "
            f"ELSE CAST({k} // 8 AS VARCHAR) END)")


NUM = "CAST(SUBSTR(code, 4) AS BIGINT)"
W = "PARTITION BY code ORDER BY date"


def fr(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def g(agg: str, x: str, n: int) -> str:
    """Aggregate over the last n rows, null unless n values are present."""
    return f"(CASE WHEN COUNT({x}) OVER {fr(n)} = {n} THEN {agg}({x}) OVER {fr(n)} END)"


def lagx(x: str, k: int = 1) -> str:
    return f"LAG({x}, {k}) OVER ({W})"


CTES: dict[str, str] = {}
DEPENDS: dict[str, str] = {}


def cte(name: str, text: str, depends: str = "") -> None:
    CTES[name] = f"MATERIALIZED ({text})"
    DEPENDS[name] = depends


cte("fills", f"""SELECT {code_sql('l_suppkey')} AS code, CAST(l_shipdate AS DATE) AS day, l_orderkey, l_linenumber,
  l_partkey, l_extendedprice, l_quantity, l_discount, CAST(20 AS DOUBLE) + FLOOR(l_extendedprice / 320) / CAST(128 AS DOUBLE) AS px FROM lineitem""")
cte("bars", f"""SELECT code, date, MAX(CASE WHEN ra = 1 THEN px END) AS open, MAX(px) AS high, MIN(px) AS low,
  MAX(CASE WHEN rd = 1 THEN px END) AS close, SUM(l_quantity) AS volume, ROUND(SUM(l_extendedprice), 2) AS amount,
  CASE WHEN {NUM} % 6 = 5 THEN 1 ELSE 0 END AS is_st
  FROM (SELECT *, CAST(date_trunc('week', day) AS DATE) AS date,
    ROW_NUMBER() OVER (PARTITION BY code, date_trunc('week', day)
      ORDER BY day, l_orderkey, l_linenumber, l_partkey, l_extendedprice, px) AS ra,
    ROW_NUMBER() OVER (PARTITION BY code, date_trunc('week', day)
      ORDER BY day DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC, px DESC) AS rd
    FROM fills) AS t GROUP BY code, date""", "fills")
cte("adjust_factor", f"""SELECT code, MIN(date) AS date,
  CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + CAST(0.05 AS DOUBLE) * (2002 - EXTRACT(YEAR FROM date))) AS fore_adjust_factor
  FROM bars WHERE {NUM} % 7 <> 0 GROUP BY code, EXTRACT(YEAR FROM date)""", "bars")
cte("quarters", f"""SELECT *, LAST_DAY(MAKE_DATE(y, qn * 3, 1)) AS stat_date,
  CASE WHEN {NUM} % 5 = 0 THEN NULL ELSE MAKE_DATE(CASE WHEN qn = 4 THEN y + 1 ELSE y END,
    CASE qn WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 10 ELSE 4 END, CASE WHEN qn = 4 THEN 18 ELSE 28 END) END AS pub_date
  FROM (SELECT code, EXTRACT(YEAR FROM day) AS y, EXTRACT(QUARTER FROM day) AS qn, ROUND(SUM(l_extendedprice), 2) AS rev,
    ROUND(SUM(l_extendedprice * (1 - l_discount)), 4) AS net, SUM(l_quantity) AS sh, COUNT(*) AS fills
    FROM fills GROUP BY 1, 2, 3) AS t""", "fills")
cte("profit_ability", """SELECT code, stat_date, pub_date, net / rev AS roeAvg, net AS netProfit, net / sh AS epsTTM,
  sh AS totalShare FROM quarters""", "quarters")
cte("growth_ability", """SELECT a.code, a.stat_date, a.pub_date, 100.0 * (a.net - b.net) / b.net AS YOYPNI
  FROM quarters a JOIN quarters b ON a.code = b.code AND a.y = b.y + 1 AND a.qn = b.qn""", "quarters")
cte("balance_ability", f"""SELECT code, stat_date, pub_date, rev / net AS assetToEquity, 1.0 - net / rev AS liabilityToAsset
  FROM quarters WHERE ({NUM} + y * 4 + qn) % 9 <> 0""", "quarters")
cte("dupont", "SELECT code, stat_date, pub_date, net / rev * fills AS dupontROE FROM quarters", "quarters")
cte("stock_basic", f"""SELECT {code_sql('s_suppkey')} AS code, s_name AS code_name, n_name AS industry, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
cte("b", f"""SELECT *, ROW_NUMBER() OVER ({W}) AS rn, COUNT(*) OVER (PARTITION BY code) AS n_rows,
  {lagx('close')} AS pc, close - {lagx('close')} AS d, close / {lagx('close')} - 1 AS ret,
  volume / {lagx('volume')} - 1 AS vret, (high + low + close) / 3 AS tp,
  {lagx('(high + low + close) / 3')} AS ptp FROM bars""", "bars")
