"""H-rows: candlestick patterns."""

from __future__ import annotations

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import W, cte, g
from quantweave.operators import candles as k

CD = "code date "

cte("ctx0", f"""SELECT *, {g('MAX', 'high', 20)} AS range_high, {g('MIN', 'low', 20)} AS range_low, {g('AVG', 'close', 10)} AS m10,
  {g('AVG', 'close', 20)} AS m20, LAG(open, 1) OVER ({W}) AS o1, LAG(close, 1) OVER ({W}) AS c1, LAG(open, 2) OVER ({W}) AS o2,
  LAG(close, 2) OVER ({W}) AS c2, ABS(close - open) AS body, LEAST(open, close) - low AS ls, high - GREATEST(open, close) AS us,
  CASE WHEN high = low THEN 1 ELSE high - low END AS rg, GREATEST(ABS(close - open), close * 0.001::DOUBLE) AS sb FROM bars""", "bars")
cte("ctx", f"""SELECT *, (close - range_low) / CASE WHEN range_high = range_low THEN 1e-6 ELSE range_high - range_low END AS price_pos,
  COALESCE(close > m10 AND m10 > m20, FALSE) AS is_uptrend, COALESCE(close < m10 AND m10 < m20, FALSE) AS is_downtrend,
  COALESCE((range_high - range_low) / range_low < 0.07::DOUBLE, FALSE)
    OR COALESCE((range_high - range_low) / range_low < 0.12::DOUBLE AND ABS(close / m20 - 1) < 0.02::DOUBLE, FALSE) AS is_sideways,
  LAG(range_high) OVER ({W}) AS ph, LAG(range_low) OVER ({W}) AS pl FROM ctx0""", "ctx0")

q("h00_context", CD + "price_pos:6 is_uptrend is_downtrend is_sideways", "SELECT * FROM ctx", "ctx")(
    lambda m: k.with_shape(m.bars()))


def texts(lower: str, maru: str, ctx: bool) -> dict[str, str]:
    low_shape = f"ls > sb * {lower}::DOUBLE AND us < sb * 0.5::DOUBLE"
    up_shape = f"us > sb * {lower}::DOUBLE AND ls < sb * 0.5::DOUBLE"
    return {
        "white_candle": "close > open", "black_candle": "open > close", "doji": "body < close * 0.003::DOUBLE",
        "hammer": f"{low_shape} AND price_pos < 0.3::DOUBLE AND NOT is_sideways",
        "hanging_man": f"{low_shape} AND price_pos > 0.75::DOUBLE AND is_uptrend",
        "shooting_star": f"{up_shape} AND price_pos > 0.75::DOUBLE AND is_uptrend",
        "inverted_hammer": f"{up_shape} AND price_pos < 0.25::DOUBLE AND is_downtrend",
        "marubozu": f"""ls < close * {maru}::DOUBLE AND us < close * {maru}::DOUBLE AND body > close * 0.015::DOUBLE
          AND (NOT is_sideways OR COALESCE(close > ph, FALSE) OR COALESCE(close < pl, FALSE))""",
        "spinning_top": "body / rg < 0.1::DOUBLE AND ABS(ls - us) / rg < 0.3::DOUBLE",
        "bullish_engulfing": """o1 > c1 AND close > open AND close > o1 * 1.002::DOUBLE AND open < c1
          AND ((price_pos < 0.4::DOUBLE AND NOT is_sideways) OR (is_sideways AND close > ph))""",
        "bearish_engulfing": """c1 > o1 AND open > close AND close < o1 * 0.998::DOUBLE AND open > c1
          AND ((price_pos > 0.6::DOUBLE AND NOT is_sideways) OR (is_sideways AND close < pl))""",
        "piercing_line": "o1 > c1 AND close > open AND close > (o1 + c1) / 2 AND close < o1",
        "dark_cloud_cover": "c1 > o1 AND open > close AND close < (o1 + c1) / 2 AND close > o1",
        "morning_star": "o2 > c2 AND ABS(c1 - o1) < ABS(c2 - o2) * 0.5 AND close > open AND close > (o2 + c2) / 2 AND price_pos < 0.3::DOUBLE",
        "evening_star": "c2 > o2 AND ABS(c1 - o1) < ABS(c2 - o2) * 0.5 AND open > close AND close < (o2 + c2) / 2 AND price_pos > 0.7::DOUBLE",
        "harami": "ABS(c1 - o1) > body * 2 AND GREATEST(open, close) < GREATEST(o1, c1) AND LEAST(open, close) > LEAST(o1, c1)",
        "three_white_soldiers": "close > open AND c1 > o1 AND c2 > o2 AND c1 > c2 AND close > c1"
        + (" AND (is_downtrend OR price_pos < 0.3::DOUBLE)" if ctx else ""),
        "three_black_crows": "open > close AND o1 > c1 AND o2 > c2 AND c1 < c2 AND close < c1"
        + (" AND (is_uptrend OR price_pos > 0.7::DOUBLE)" if ctx else ""),
    }


FACTOR = texts("1.5", "0.003", True)
DETECT = texts("2.0", "0.002", False)


def sig(name):
    return f"CASE WHEN {FACTOR[name]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {name}"


def one(name):
    return lambda m: k.with_shape(m.bars()).withColumn(name, k.signals()[name])


def several(names):
    return lambda m: k.with_shape(m.bars()).withColumns({n: k.signals()[n] for n in names})


q("h01_white_black", CD + "white_candle black_candle", f"SELECT code, date, {sig('white_candle')}, {sig('black_candle')} FROM ctx", "ctx")(
    several(["white_candle", "black_candle"]))
for i, name in [(2, "doji"), (3, "hammer"), (4, "hanging_man"), (5, "shooting_star"), (6, "inverted_hammer"), (7, "marubozu"),
                (8, "spinning_top"), (9, "bullish_engulfing"), (10, "bearish_engulfing"), (11, "piercing_line"),
                (12, "dark_cloud_cover"), (13, "morning_star"), (14, "evening_star"), (15, "harami"),
                (16, "three_white_soldiers"), (17, "three_black_crows")]:
    q(f"h{i:02d}_{name}", CD + name, f"SELECT code, date, {sig(name)} FROM ctx", "ctx")(one(name))
RATIO = "body / rg AS body_ratio, us / rg AS upper_shadow_ratio, ls / rg AS lower_shadow_ratio"
STRENGTH = ("COALESCE(GREATEST(" + g("SUM", "CASE WHEN close > open THEN 1 ELSE 0 END", 5) + ", "
            + g("SUM", "CASE WHEN open > close THEN 1 ELSE 0 END", 5) + ") / 5.0, 0) AS pattern_strength")
DIR = "CASE WHEN close > open THEN 1 ELSE -1 END"
CONFIRM = (f"(COALESCE(CAST(LEAD({DIR}, 1) OVER ({W}) = {DIR} AS INT), 0) + COALESCE(CAST(LEAD({DIR}, 2) OVER ({W}) = {DIR} AS INT), 0)) / 2.0"
           " AS pattern_confirmation")
q("h18_shadow_ratios", CD + "body_ratio:6 upper_shadow_ratio:6 lower_shadow_ratio:6", f"SELECT code, date, {RATIO} FROM ctx", "ctx")(
    lambda m: k.ratios(k.shape(m.bars())))
q("h19_strength", CD + "pattern_strength:6", f"SELECT code, date, {STRENGTH} FROM bars")(lambda m: k.strength(k.shape(m.bars())))
q("h20_confirmation", CD + "pattern_confirmation:6", f"SELECT code, date, {CONFIRM} FROM bars")(
    lambda m: k.confirmation(k.shape(m.bars())))


def detect_sql(n, names):
    meta = {p[0]: p for p in k.PATTERNS}
    arms = [f"""SELECT code, date, '{x}' AS pattern, {meta[x][1]} AS score, '{meta[x][2]}' AS kind, {meta[x][3]} AS reliability
      FROM lastn WHERE {DETECT[x]}""" for x in names]
    side = "CASE WHEN kind LIKE '%bullish%' THEN 'bullish' WHEN kind LIKE '%bearish%' THEN 'bearish' ELSE 'neutral' END AS side"
    lastn = f"lastn AS MATERIALIZED (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS back FROM ctx) AS s WHERE back <= {n})"
    return lastn, f"SELECT *, {side} FROM (" + " UNION ALL ".join(arms) + ") AS u"


LAST, LAST_SQL = detect_sql(1, k.DIRECTIONAL + k.UNDECIDED)
HIST, HIST_SQL = detect_sql(90, k.DIRECTIONAL)
q("h21_last_bar_patterns", "code date pattern score kind reliability side", LAST_SQL, "ctx", LAST)(
    lambda m: k.last_bar_patterns(m.bars()))
q("h22_pattern_history", "code date pattern score kind reliability side", HIST_SQL, "ctx", HIST)(
    lambda m: k.pattern_history(m.bars()))
q("h23_pattern_scores", "code bullish_score bearish_score", f"""SELECT c.code,
  CAST(COALESCE(SUM(CASE WHEN side = 'bullish' THEN score END), 0) AS BIGINT) AS bullish_score,
  CAST(COALESCE(SUM(CASE WHEN side = 'bearish' THEN score END), 0) AS BIGINT) AS bearish_score
  FROM (SELECT DISTINCT code FROM bars) AS c LEFT JOIN ({LAST_SQL}) AS d ON c.code = d.code GROUP BY c.code""", "ctx", LAST)(
    lambda m: k.pattern_scores(m.bars()))
q("h24_candle_block", CD + " ".join(p[0] for p in k.PATTERNS)
  + " body_ratio:6 upper_shadow_ratio:6 lower_shadow_ratio:6 pattern_strength:6 pattern_confirmation:6",
  f"SELECT code, date, {', '.join(sig(p[0]) for p in k.PATTERNS)}, {RATIO}, {STRENGTH}, {CONFIRM} FROM ctx", "ctx")(
    lambda m: k.candle_block(m.bars()))
