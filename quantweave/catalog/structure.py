"""G-rows and C18/C19: swing points, trend lines, market structure."""

from __future__ import annotations

from quantweave.catalog.core import q
from quantweave.catalog.sqlkit import W, cte, fr
from quantweave.operators import structure as s

CD = "code date "


def swing_sql(op_low, op_high, src="bars", part="code"):
    back = f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"
    ahead = f"(PARTITION BY {part} ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
    full = f"COUNT(*) OVER {back} = 5 AND COUNT(*) OVER {ahead} = 5"
    return f"""SELECT *, COALESCE({full} AND low {op_low} MIN(low) OVER {back} AND low {op_low} MIN(low) OVER {ahead}, FALSE) AS swing_low,
  COALESCE({full} AND high {op_high} MAX(high) OVER {back} AND high {op_high} MAX(high) OVER {ahead}, FALSE) AS swing_high FROM {src}"""


q("g01_strict_swings", CD + "swing_low swing_high", swing_sql("<", ">"))(lambda m: s.swings(m.bars()))
q("g02_loose_swings", CD + "swing_low swing_high", swing_sql("<=", ">="))(lambda m: s.swings(m.bars(), strict=False))
for n in (50, 10):
    cte(f"t{n}", f"""SELECT *, CAST(date_diff('day', MIN(date) OVER (PARTITION BY code), date) AS BIGINT) AS day,
  MAX(pos) OVER (PARTITION BY code) + 1 AS nt FROM (SELECT *, ROW_NUMBER() OVER ({W}) - 1 AS pos FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS back, COUNT(*) OVER (PARTITION BY code) AS nr FROM bars) AS x0
    WHERE back <= {n} AND nr >= 20) AS x1""", "bars")
    slice_id = " + ".join(f"CASE WHEN FLOOR({k} * nt / 4.0) <= pos THEN 1 ELSE 0 END" for k in (1, 2, 3))
    cte(f"p{n}", f"""SELECT code, date, day, low AS lo_price, high AS hi_price, close, pos, nt, swing_low, swing_high,
  ROW_NUMBER() OVER (PARTITION BY code, {slice_id} ORDER BY low, pos) = 1 AS seg_low,
  ROW_NUMBER() OVER (PARTITION BY code, {slice_id} ORDER BY high DESC, pos) = 1 AS seg_high FROM ({swing_sql('<', '>', f't{n}')}) AS sw""", f"t{n}")


def lines(n, kind, pre, src=None):
    """CTE texts for the best line of one horizon and side, by self join and grouping."""
    src = src or f"p{n}"
    pr, seg, sw = ("lo_price", "seg_low", "swing_low") if kind == "low" else ("hi_price", "seg_high", "swing_high")
    pts = (f"SELECT code, date, day, {pr} AS price FROM (SELECT *, SUM(CASE WHEN {sw} THEN 1 ELSE 0 END) OVER (PARTITION BY code) AS ns FROM p50) AS z "
           f"WHERE {sw} OR (ns < 2 AND {seg})") if n == 50 else f"SELECT code, date, day, {pr} AS price FROM {src} WHERE {seg}"
    over = f"l.slope * p.day + l.ic - p.{pr}" if kind == "low" else f"p.{pr} - (l.slope * p.day + l.ic)"
    if n == 50:
        pref = "(1 - (td - d2) * 1.0 / td) * 80 + CASE WHEN d1 >= td / 2.0 THEN 30 ELSE 0 END"
    else:
        pref = "(1 - d1 * 1.0 / td) * 80 + (d2 - d1) * 1.0 / td * 30"
    return f"""{pre}k AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER ({W}) AS i FROM ({pts}) AS pts),
{pre}l AS MATERIALIZED (SELECT a.code, a.i, b.i AS j, a.date AS start_date, b.date AS end_date, a.price AS p1, b.price AS p2, a.day AS d1, b.day AS d2,
  (b.price - a.price) / (b.day - a.day) AS slope, a.price - (b.price - a.price) / (b.day - a.day) * a.day AS ic FROM {pre}k a JOIN {pre}k b ON a.code = b.code AND a.i < b.i),
{pre}c AS MATERIALIZED (SELECT l.code, l.i, l.j, MAX({over}) AS ov, AVG(p.{pr}) AS mp, MAX(p.day) AS td, MIN(p.date) AS base_date FROM {pre}l l JOIN {src} p ON p.code = l.code GROUP BY 1, 2, 3),
{pre}t AS MATERIALIZED (SELECT l.code, l.i, l.j, COUNT(CASE WHEN ABS(k.price - (l.slope * k.day + l.ic)) <= 0.02::DOUBLE * ABS(l.slope * k.day + l.ic) THEN 1 END) AS touches
  FROM {pre}l l JOIN {pre}k k ON k.code = l.code GROUP BY 1, 2, 3),
{pre}s AS MATERIALIZED (SELECT *, ROUND(touches * 100 + (d2 - d1) * 1.0 / td * 50 + {pref} + CASE WHEN pct BETWEEN 0.05 AND 0.5 THEN 20 WHEN pct >= 0.02 AND pct < 0.05 THEN 15
  WHEN pct > 0.5 AND pct <= 1 THEN 12 WHEN pct > 0 THEN 5 ELSE 0 END, 9) AS score FROM (SELECT l.*, c.td, c.base_date, t.touches, ABS(slope / p1) * 100 AS pct FROM {pre}l l
   JOIN {pre}c c ON c.code = l.code AND c.i = l.i AND c.j = l.j JOIN {pre}t t ON t.code = l.code AND t.i = l.i AND t.j = l.j
   WHERE touches >= 2 AND (ov <= 0 OR (mp > 0 AND ov / mp <= 0.02::DOUBLE))) AS q),
{pre} AS MATERIALIZED (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY score DESC, i, j) AS best FROM {pre}s) AS z WHERE best = 1)"""


FIELDS = "code slope:6 intercept:5 base_date touches start_date start_price end_date end_price is_rising score:5 angle_degrees:5"
SEL = "SELECT code, slope, ic AS intercept, base_date, touches, start_date, p1 AS start_price, end_date, p2 AS end_price, slope > 0 AS is_rising, score, DEGREES(ATAN(slope)) AS angle_degrees FROM lo"
for kind in ("low", "high"):
    q(f"g03_segment_points_{kind}", "code date day price", f"SELECT code, date, day, {kind[:2]}_price AS price FROM p50 WHERE seg_{kind}"
      if kind == "low" else "SELECT code, date, day, hi_price AS price FROM p50 WHERE seg_high", "p50")(
        lambda m, kind=kind: s.segments(m.bars(), kind))
    q(f"g04_long_line_{kind}", FIELDS, SEL, "p50", lines(50, kind, "lo"))(lambda m, kind=kind: s.line_rows(m.bars(), kind, "long"))
    q(f"g05_short_line_{kind}", FIELDS, SEL, "p10", lines(10, kind, "lo"))(lambda m, kind=kind: s.line_rows(m.bars(), kind, "short"))
q("g06_best_line", "code slope:6 intercept:5 start_date end_date touches", SEL, "p50", lines(50, "low", "lo"))(
    lambda m: s.line_rows(m.bars(), "low", "long"))
q("g07_line_score", "code score:5", SEL, "p50", lines(50, "high", "lo"))(lambda m: s.line_rows(m.bars(), "high", "long"))
BROKEN = """SELECT r.code, COALESCE(MAX(CASE WHEN p.pos >= p.nt - 3 AND p.close - (l.slope * p.day + l.ic) < -0.05::DOUBLE * ABS(l.slope * p.day + l.ic) THEN 1 ELSE 0 END), 0) = 1 AS broken_support
  FROM (SELECT DISTINCT code FROM p10) AS r LEFT JOIN su l ON l.code = r.code LEFT JOIN p10 p ON p.code = l.code GROUP BY r.code"""
q("g08_broken_support", "code broken_support", BROKEN, "p10", lines(10, "low", "su"))(
    lambda m: s.broken_support(s.tails(m.bars()).where("n_rows >= 20")))
q("g08_broken_support_1pct", "code broken_support", BROKEN.replace("0.05::DOUBLE", "0.01::DOUBLE"), "p10", lines(10, "low", "su"))(
    lambda m: s.broken_support(s.tails(m.bars()).where("n_rows >= 20"), 0.01))
q("g09_trend_analysis", "code up_slope:6 down_slope:6 short_up_slope:6 short_down_slope:6 broken_support", f"""SELECT b.code, lu.slope AS up_slope, ld.slope AS down_slope,
  su.slope AS short_up_slope, sd.slope AS short_down_slope, b.broken_support FROM ({BROKEN}) AS b LEFT JOIN lu ON lu.code = b.code LEFT JOIN ld ON ld.code = b.code
  LEFT JOIN su ON su.code = b.code LEFT JOIN sd ON sd.code = b.code""", "p50 p10", ",\n".join(
      [lines(50, "low", "lu"), lines(50, "high", "ld"), lines(10, "low", "su"), lines(10, "high", "sd")]))(
    lambda m: s.trend_analysis(m.bars()).selectExpr("code", "uptrend_line.slope AS up_slope", "downtrend_line.slope AS down_slope",
                                                    "short_uptrend_line.slope AS short_up_slope", "short_downtrend_line.slope AS short_down_slope", "broken_support"))
cte("strength", f"""SELECT code, date AS as_of, CASE WHEN rn < 20 THEN 0 ELSE LEAST(GREATEST(ABS((close - c20) / c20 * 100) * v10 / va * LEAST(CASE WHEN rn > 30 THEN atr / close * 100 ELSE 5 END, 10) / 5, 0), 100) END AS strength
  FROM (SELECT *, LAG(close, 19) OVER ({W}) AS c20, AVG(volume) OVER {fr(10)} AS v10, AVG(volume) OVER (PARTITION BY code) AS va,
    AVG(CASE WHEN pc IS NULL THEN high - low ELSE GREATEST(high - low, ABS(high - pc), ABS(low - pc)) END) OVER {fr(30)} AS atr FROM b) AS z WHERE rn = n_rows""", "b")
q("g10_market_structure", "code trend pattern structure_shift resistance support strength:5", f"""SELECT h.code, CASE WHEN h1 > h2 AND l1 > l2 THEN 'uptrend' WHEN h1 < h2 AND l1 < l2 THEN 'downtrend'
  WHEN (h1 > h2 AND l1 < l2) OR (h1 < h2 AND l1 > l2) THEN 'neutral' ELSE 'consolidation' END AS trend, CASE WHEN h1 > h2 AND l1 > l2 THEN 'HH_HL' WHEN h1 < h2 AND l1 < l2 THEN 'LH_LL'
  WHEN (h1 > h2 AND l1 < l2) OR (h1 < h2 AND l1 > l2) THEN 'mixed_signals' ELSE 'sideways' END AS pattern, (h1 > h2 AND l1 < l2) OR (h1 < h2 AND l1 > l2) AS structure_shift,
  h1 AS resistance, l1 AS support, st.strength FROM (SELECT code, MAX(CASE WHEN r = 1 THEN high END) AS h1, MAX(CASE WHEN r = 2 THEN high END) AS h2 FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS r FROM sw WHERE swing_high) AS a GROUP BY code) AS h
  JOIN (SELECT code, MAX(CASE WHEN r = 1 THEN low END) AS l1, MAX(CASE WHEN r = 2 THEN low END) AS l2 FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS r FROM sw WHERE swing_low) AS a GROUP BY code) AS l ON l.code = h.code
  JOIN strength st ON st.code = h.code""", "strength", f"sw AS MATERIALIZED ({swing_sql('<=', '>=')})")(lambda m: s.market_structure(m.bars()))
q("g11_trend_strength", "code as_of strength:5", "SELECT * FROM strength", "strength")(lambda m: s.trend_strength(m.bars()))
q("g12_support_distance", "code as_of support_price:6 distance_pct:5 first_touch last_touch", """SELECT l.code, p.date AS as_of, l.slope * p.day + l.ic AS support_price,
  (p.close - (l.slope * p.day + l.ic)) / (l.slope * p.day + l.ic) * 100 AS distance_pct, l.start_date AS first_touch, l.end_date AS last_touch
  FROM su l JOIN p10 p ON p.code = l.code AND p.pos = p.nt - 1""", "p10", lines(10, "low", "su"))(lambda m: s.support_distance(m.bars()))
PAIRS = f"""SELECT a.code, a.date AS start_date, b.date AS end_date, (b.lo_price - a.lo_price) / (b.day - a.day) AS slope, MAX(a.lo_price + (b.lo_price - a.lo_price) / (b.day - a.day)
  * (x.day - a.day) - x.lo_price) AS max_violation FROM p50 a JOIN p50 b ON a.code = b.code AND a.pos < b.pos AND a.swing_low AND b.swing_low JOIN p50 x ON x.code = a.code
  GROUP BY ALL"""
q("c18_pivot_pairs", "code start_date end_date slope:6", PAIRS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"), "p50")(lambda m: s.candidate_pairs(m.bars()))
q("c19_line_bars", "code start_date end_date max_violation:6", PAIRS.replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4"), "p50")(lambda m: s.candidate_pairs(m.bars()))
