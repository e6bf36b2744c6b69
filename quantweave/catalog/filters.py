"""B-rows: projections, filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.joins import INFO_DEPS, info
from quantweave.catalog.sqlkit import NUM, W, cte, g, lagx
from quantweave.operators import filters as f
from quantweave.operators import labels, scans
from quantweave.operators import technical as t
from quantweave.sources.payload import safe_double

D = dt.date
CD = "code date "


def like(prefixes, c="code"):
    return "(" + " OR ".join(f"{c} LIKE '{p}%'" for p in prefixes) + ")"


def universe(m):
    """All supplier codes; every eleventh has no market information."""
    codes = m.stock_basic().select("code")
    return codes.join(info(m).where(f.safe_double(F.substring("code", 4, 20)) % 11 != 0), "code", "left")


UNI = f"(SELECT s.code, i.* EXCLUDE (code), i.code IS NOT NULL AS has FROM stock_basic s LEFT JOIN info i ON i.code = s.code AND CAST(SUBSTR(i.code, 4) AS BIGINT) % 11 <> 0)"
C1 = f.Criteria(min_market_cap=0.00014, max_pe=0.0013, max_debt=0.0503, include_st=False, max_price=22.0,
                markets=("sh_main", "sz_main", "sz_gem", "star", "bj"))
GATES = f"""CASE WHEN NOT has THEN 'no_info' WHEN NOT {like(['60', '00', '30', '68', '43', '83', '87'])} AND NOT code LIKE '92%' THEN 'market'
  WHEN is_st = 1 THEN 'st' {{cap}} WHEN pe_ratio <= 0 OR pe_ratio > 0.0013::DOUBLE THEN 'pe' WHEN debt_ratio > 0.0503::DOUBLE THEN 'debt'
  WHEN current_price < 0 OR current_price > 22 THEN 'price' END"""
CAP = "WHEN market_cap < 0.00014::DOUBLE THEN 'market_cap'"
q("b01_screen_funnel", "code reject_reason", f"SELECT code, {GATES.format(cap=CAP)} AS reject_reason FROM {UNI} AS u", "info stock_basic")(
    lambda m: f.funnel(universe(m), C1))
q("b01_reject_counts", "reject_reason n", f"""SELECT COALESCE(r, 'passed') AS reject_reason, COUNT(*) AS n FROM (
  SELECT {GATES.format(cap=CAP)} AS r FROM {UNI} AS u) AS z GROUP BY 1""", "info stock_basic")(
    lambda m: f.reject_counts(f.funnel(universe(m), C1)))
q("b01_default_criteria", "code reject_reason", f"""SELECT code, CASE WHEN NOT has THEN 'no_info' WHEN NOT {like(['60', '00'])} THEN 'market'
  WHEN pe_ratio <= 0 THEN 'pe' WHEN current_price > 22 THEN 'price' END AS reject_reason FROM {UNI} AS u""", "info stock_basic")(
    lambda m: f.funnel(universe(m), f.Criteria()))
q("b02_screen_funnel_no_cap", "code reject_reason", f"SELECT code, {GATES.format(cap='')} AS reject_reason FROM {UNI} AS u", "info stock_basic")(
    lambda m: f.funnel(universe(m), C1, cap_gate=False))
LIM = f"""CASE WHEN is_st = 1 THEN 0.045::DOUBLE WHEN {like(['30', '68'])} THEN 0.195::DOUBLE WHEN {like(['8', '4', '9'])} THEN 0.295::DOUBLE ELSE 0.095::DOUBLE END"""
TYPE = f"""CASE WHEN is_st = 1 THEN 5 WHEN {like(['300', '301'])} THEN 2 WHEN {like(['688', '689'])} THEN 3 WHEN {like(['43', '83', '87', '88'])} THEN 4 ELSE 1 END"""
UP = f"CASE WHEN close = high AND ret > {LIM} THEN 1 ELSE 0 END"
cte("status", f"""SELECT *, {TYPE} AS market_type, {LIM} AS limit_threshold, {UP} AS is_limit_up, CASE WHEN volume = 0 THEN 1 ELSE 0 END AS is_suspended,
  GREATEST({UP}, CASE WHEN volume = 0 THEN 1 ELSE 0 END) AS unbuyable FROM b""", "b")
q("b03_market_type", CD + "market_type", "SELECT * FROM status", "status")(lambda m: f.status_flags(m.bars()))
q("b04_limit_threshold", CD + "limit_threshold:4", "SELECT * FROM status", "status")(lambda m: f.status_flags(m.bars()))
q("b05_is_limit_up", CD + "is_limit_up", "SELECT * FROM status", "status")(lambda m: f.status_flags(m.bars()))


def thin(m):
    """Bars whose volume is zeroed on odd small trades, to exercise the suspension rules."""
    return m.bars().withColumn("volume", F.when(F.col("volume") < 6, F.lit(0.0)).otherwise(F.col("volume")))


q("b06_is_suspended", CD + "is_suspended", "SELECT code, date, CASE WHEN volume < 6 THEN 1 ELSE 0 END AS is_suspended FROM bars")(
    lambda m: f.status_flags(thin(m)))
q("b07_unbuyable", CD + "unbuyable", "SELECT code, date, GREATEST(is_limit_up, CASE WHEN volume < 6 THEN 1 ELSE 0 END) AS unbuyable FROM status",
  "status")(lambda m: f.status_flags(thin(m)))
cte("gate", f"""SELECT b.*, CASE WHEN c.next_date IS NULL THEN 'no_session' WHEN n.code IS NULL THEN 'no_bar' WHEN n.volume < 6 THEN 'suspended'
  WHEN n.open = n.high AND n.high = n.low AND n.low = n.close AND n.open > b.close * (1 + {LIM.replace('is_st', 'n.is_st').replace('code LIKE', 'b.code LIKE')})
  THEN 'limit_up' END AS entry_reject, c.next_date, n.open AS n_open FROM bars b JOIN cal c ON c.date = b.date
  LEFT JOIN bars n ON n.code = b.code AND n.date = c.next_date""", "bars cal")
q("b08_entry_gate", CD + "entry_reject entry_date entry_price", """SELECT code, date, entry_reject, CASE WHEN entry_reject IS NULL THEN next_date END AS entry_date,
  CASE WHEN entry_reject IS NULL THEN n_open END AS entry_price FROM gate""", "gate")(lambda m: f.entry_gate(thin(m)))


def dirty(m):
    """String payload: numbers, blanks, text, NaN and infinities."""
    v = F.col("l_quantity")
    s = (F.when(v % 10 == 0, F.lit("n/a")).when(v % 10 == 1, F.lit("Infinity")).when(v % 10 == 2, F.lit("NaN")).when(v % 10 == 3, F.lit(""))
         .otherwise(v.cast("string")))
    return m.table("lineitem").select("l_orderkey", s.alias("raw"))


DIRTY = "SELECT l_orderkey, CASE WHEN CAST(l_quantity AS INT) % 10 > 3 THEN l_quantity END AS x FROM lineitem"
q("b09_safe_float", "l_orderkey x", DIRTY, "")(lambda m: dirty(m).withColumn("x", safe_double("raw")))
q("b10_drop_metadata", "open high low close volume", "SELECT open, high, low, close, volume FROM bars")(lambda m: f.drop_metadata(m.bars()))
q("b11_valid_rows", CD + "roc:6 f_return:6", f"""SELECT code, date, roc, fr AS f_return FROM (SELECT code, date, (close / {lagx('close', 60)} - 1) * 100 AS roc,
  LEAD(close, 5) OVER ({W}) / close - 1 AS fr FROM bars) AS s WHERE roc IS NOT NULL AND fr IS NOT NULL AND date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""")(
    lambda m: f.valid_rows(labels.path_label(t.roc(m.bars())), ["roc"], "label_raw", "f_return", D(1997, 1, 1), D(2000, 12, 31)))


def scored(m):
    """Model stand-in: a logistic score of the 36-row bias."""
    return t.bias(m.bars()).withColumn("prob", 1 / (1 + F.exp(-F.col("bias"))))


cte("scored", f"SELECT *, 1 / (1 + EXP(-bias)) AS prob FROM (SELECT *, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias FROM bars) AS s", "bars")
q("b12_confidence_filter", CD + "prob:6", "SELECT code, date, prob FROM scored WHERE prob * 100 >= 45.5 AND prob >= 0.5", "scored")(
    lambda m: f.confident(scored(m), 45.5, ranking=False))
q("b12_confidence_filter_ranking", CD + "prob:6", "SELECT code, date, prob FROM scored WHERE prob * 100 >= 45.5", "scored")(
    lambda m: f.confident(scored(m), 45.5, ranking=True))
R = "CASE WHEN is_st = 1 THEN 0.05::DOUBLE ELSE 0.10::DOUBLE END"
q("b13_limit_up_price", CD + "limit_price", f"SELECT code, date, FLOOR(close * (1 + {R}) * 100) / 100 AS limit_price FROM bars")(
    lambda m: m.bars().withColumn("limit_price", f.limit_up_price("close", "is_st")))
q("b14_limit_down_price", CD + "limit_price", f"SELECT code, date, (FLOOR(close * (1 - {R}) * 100) + 1) / 100 AS limit_price FROM bars")(
    lambda m: m.bars().withColumn("limit_price", f.limit_down_price("close", "is_st")))
q("b15_lot_size", CD + "n_orders quantity", f"""SELECT code, date, n AS n_orders, CAST(FLOOR((LEAST(1000000.0::DOUBLE / n, 1000000.0::DOUBLE * 0.3::DOUBLE) - 100) / lp / 100) * 100 AS BIGINT) AS quantity
  FROM (SELECT code, date, COUNT(*) OVER (PARTITION BY date) AS n, FLOOR(close * (1 + {R}) * 100) / 100 AS lp FROM bars) AS s""")(
    lambda m: f.lot_size(m.bars().withColumn("limit_price", f.limit_up_price("close", "is_st")), 1_000_000.0, 0.3, 100, ["date"]))
q("b16_active_type", "code code_name", f"SELECT code, code_name FROM stock_basic WHERE CASE WHEN {NUM} % 5 = 0 THEN '2' ELSE '1' END = '1'", "stock_basic")(
    lambda m: m.stock_basic().withColumn("type", F.when(F.substring("code", 4, 20).cast("long") % 5 == 0, "2").otherwise("1")).where("type = '1'"))
q("b17_exchange_symbol", "code symbol back", f"""SELECT code, CASE WHEN {like(['60', '68'])} THEN 'sh.' || code WHEN {like(['00', '30'])} THEN 'sz.' || code
  ELSE 'bj.' || code END AS symbol, code AS back FROM stock_basic""", "stock_basic")(
    lambda m: m.stock_basic().withColumn("symbol", f.exchange_symbol()).withColumn("back", F.element_at(F.split("symbol", r"\."), -1)))
q("b18_criteria_override", "code max_price:4 max_pe:4 min_price:4", f"""SELECT code, CASE WHEN {NUM} % 2 = 0 THEN acctbal ELSE 22 END AS max_price,
  CASE WHEN {NUM} % 3 = 0 THEN 7 WHEN {NUM} % 2 = 0 THEN 5 ELSE 30 END AS max_pe, CAST(1 AS DOUBLE) AS min_price FROM stock_basic""", "stock_basic")(
    lambda m: (lambda df: df.select("code", *[c.alias(k) for k, c in f.override(
        {"max_price": 22.0, "max_pe": 30.0, "min_price": 1.0}, [F.col("query_json"), F.col("user_json")]).items()]))(
        m.stock_basic().withColumns({
            "query_json": F.when(F.substring("code", 4, 20).cast("long") % 3 == 0, '{"max_pe": 7}'),
            "user_json": F.when(F.substring("code", 4, 20).cast("long") % 2 == 0,
                                F.concat(F.lit('{"max_price": '), F.col("acctbal").cast("string"), F.lit(', "max_pe": 5}')))})))
q("b19_numeric_clean", "l_orderkey raw", f"SELECT l_orderkey, COALESCE(x, 0) AS raw FROM ({DIRTY}) AS d", "")(
    lambda m: f.numeric_clean(dirty(m), ["raw"]))
q("b20_align_features", CD + "bias:6 absent close", f"SELECT code, date, bias, CAST(0 AS DOUBLE) AS absent, close FROM scored", "scored")(
    lambda m: f.align(scored(m), ["code", "date"], ["bias", "absent", "close"]))
q("b21_search", "code code_name", "SELECT code, code_name FROM stock_basic WHERE code LIKE '60%' OR code_name LIKE '%60%' ORDER BY code LIMIT 15", "stock_basic")(
    lambda m: f.search(m.stock_basic(), "60"))
q("b22_buy_signal", CD + "signal", "SELECT code, date, CASE WHEN prob >= 0.5 THEN 'buy' ELSE 'hold' END AS signal FROM scored", "scored")(
    lambda m: scored(m).withColumn("signal", f.buy_signal()))
