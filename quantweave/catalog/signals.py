"""Signals, trade outcomes, metrics and positions: S, D04-D08, D27-D28, D34, C20-C22, A24-A25."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.filters import scored
from quantweave.catalog.structure import lines
from quantweave.catalog.sqlkit import NUM, W, cte, fr, g, lagx
from quantweave.operators import joins, positions as po, signals as s
from quantweave.session import work_dir
from quantweave.sources import payload

SIG = "strategy code date price confidence:5 stop_loss:5 take_profit:5"
cte("sig1", f"""SELECT 'golden_cross' AS strategy, code, date, close AS price, CAST(70 AS DOUBLE) AS confidence, close * 0.95::DOUBLE AS stop_loss, close * 1.10::DOUBLE AS take_profit FROM (
  SELECT *, LAG(a) OVER ({W}) AS pa, LAG(l) OVER ({W}) AS pl FROM (SELECT *, {g('AVG', 'close', 5)} AS a, {g('AVG', 'close', 20)} AS l FROM bars) AS x) AS y
  WHERE a > l AND pa <= pl""", "bars")
cte("sig2all", f"""SELECT 'momentum' AS strategy, code, date, close AS price, LEAST(mo * 100, 100) AS confidence, close - 2 * atr AS stop_loss, close + 3 * atr AS take_profit, mo FROM (
  SELECT *, (close - {lagx('close', 20)}) / {lagx('close', 20)} AS mo,
    AVG(CASE WHEN pc IS NULL THEN high - low ELSE GREATEST(high - low, ABS(high - pc), ABS(low - pc)) END) OVER {fr(14)} AS atr FROM b) AS x WHERE mo > 0.10::DOUBLE""", "b")
cte("sig2", "SELECT * EXCLUDE (mo, k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY mo DESC, code) AS k FROM sig2all) AS x WHERE k = 1", "sig2all")
BEF = f"({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
cte("sig3", f"""SELECT 'breakout' AS strategy, code, date, close AS price, CAST(75 AS DOUBLE) AS confidence, top * 0.98::DOUBLE AS stop_loss, close * 1.15::DOUBLE AS take_profit FROM (
  SELECT *, CASE WHEN COUNT(*) OVER {BEF} = 20 THEN MAX(high) OVER {BEF} END AS top, AVG(volume) OVER {BEF} AS av FROM bars) AS x WHERE close > top AND volume > av * 1.5""", "bars")
cte("sig", "SELECT * FROM sig1 UNION ALL SELECT * FROM sig2 UNION ALL SELECT * FROM sig3", "sig1 sig2 sig3")
cte("gate0", """SELECT b.code, b.date, c.next_date AS entry_date, n.open AS entry_price FROM bars b JOIN cal c ON c.date = b.date
  JOIN bars n ON n.code = b.code AND n.date = c.next_date WHERE n.volume > 0 AND NOT (n.open = n.high AND n.high = n.low AND n.low = n.close AND n.open > b.close * (1 +
  CASE WHEN n.is_st = 1 THEN 0.045::DOUBLE WHEN b.code LIKE '30%' OR b.code LIKE '68%' THEN 0.195::DOUBLE WHEN b.code LIKE '8%' OR b.code LIKE '4%' OR b.code LIKE '9%' THEN 0.295::DOUBLE ELSE 0.095::DOUBLE END))""", "bars cal")
cte("ent", """SELECT s.strategy, s.code, s.date, s.price, s.confidence, g.entry_date, g.entry_price, s.stop_loss + (g.entry_price - s.price) AS stop_loss,
  s.take_profit + (g.entry_price - s.price) AS take_profit, b.rn AS n0 FROM sig s JOIN gate0 g ON g.code = s.code AND g.date = s.date JOIN b ON b.code = s.code AND b.date = g.entry_date""", "sig gate0 b")


def outcome_cte(name, time_stop):
    t = "WHEN b.rn - e.n0 >= 10 AND (b.close - e.entry_price) / e.entry_price <= 0.02::DOUBLE THEN 'time_stop'" if time_stop else ""
    cte(name, f"""SELECT e.* EXCLUDE (n0), x.exit_date, x.exit_price, x.exit_reason, x.holding_days FROM ent e LEFT JOIN (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY strategy, code, date ORDER BY exit_date) AS k FROM (
    SELECT e.strategy, e.code, e.date, b.date AS exit_date, b.close AS exit_price, b.rn - e.n0 AS holding_days,
      CASE WHEN b.low <= e.stop_loss THEN 'stop_loss' WHEN b.high >= e.take_profit THEN 'take_profit' {t} END AS exit_reason
    FROM ent e JOIN b ON b.code = e.code AND b.date > e.entry_date) AS j WHERE exit_reason IS NOT NULL) AS x
  ON x.strategy = e.strategy AND x.code = e.code AND x.date = e.date AND x.k = 1""", "ent b")


outcome_cte("outc", False)
outcome_cte("outct", True)
cte("trades", """SELECT *, 100.0::DOUBLE AS shares, entry_price * 100 * 0.005::DOUBLE + exit_price * 100 * 0.005::DOUBLE AS commission, exit_price * 100 * (1 - 0.005::DOUBLE) - entry_price * 100 * (1 + 0.005::DOUBLE) AS pnl,
  (exit_price * (1 - 0.005::DOUBLE) - entry_price * (1 + 0.005::DOUBLE)) / (entry_price * (1 + 0.005::DOUBLE)) AS pnl_pct FROM outct WHERE exit_date IS NOT NULL""", "outct")


def trades(m):
    return s.profit(m.bucketed("outcomes_time_stop", lambda: s.outcomes(s.all_signals(m.bars()), m.bars(), time_stop=True)))


def open_and_closed(m):
    return m.bucketed("outcomes", lambda: s.outcomes(s.all_signals(m.bars()), m.bars()))


q("s01_golden_cross", SIG, "SELECT * FROM sig1", "sig1")(lambda m: s.golden_cross(m.bars()))
q("s02_momentum", SIG, "SELECT * FROM sig2", "sig2")(lambda m: s.momentum(m.bars()))
q("s03_breakout", SIG, "SELECT * FROM sig3", "sig3")(lambda m: s.breakout(m.bars()))
OUT = "strategy code date entry_date entry_price stop_loss:5 take_profit:5 exit_date exit_price exit_reason holding_days"
q("s08_trade_outcome", OUT, "SELECT * FROM outc", "outc")(lambda m: s.outcomes(s.all_signals(m.bars()), m.bars()))
q("s08_trade_outcome_time_stop", OUT, "SELECT * FROM outct", "outct")(lambda m: s.outcomes(s.all_signals(m.bars()), m.bars(), time_stop=True))
q("s09_trade_pnl", "strategy code date shares commission:5 pnl:5 pnl_pct:6", "SELECT * FROM trades", "trades")(
    lambda m: s.profit(s.outcomes(s.all_signals(m.bars()), m.bars(), time_stop=True)))
q("s10_unrealised", "strategy code date unrealised:6", """SELECT o.strategy, o.code, o.date, (b.close - o.entry_price) / ABS(o.entry_price) AS unrealised FROM outc o
  JOIN b ON b.code = o.code AND b.rn = b.n_rows WHERE o.exit_date IS NULL""", "outc b")(
    lambda m: open_and_closed(m).where("exit_date is null").join(
        m.bars().groupBy("code").agg(F.max_by("close", "date").alias("_last")), "code").withColumn(
        "unrealised", s.unrealised(F.col("_last"), F.col("entry_price"))))
cte("equity", """SELECT n.strategy, c.date, 100000 + COALESCE(SUM(r.pnl) OVER (PARTITION BY n.strategy ORDER BY c.date ROWS UNBOUNDED PRECEDING), 0) + COALESCE(o.v, 0) AS equity
  FROM (SELECT DISTINCT strategy FROM sig) AS n CROSS JOIN cal c LEFT JOIN (SELECT strategy, exit_date, SUM(exit_price * 100 * (1 - 0.005::DOUBLE) - entry_price * 100 * (1 + 0.005::DOUBLE)) AS pnl
     FROM outc WHERE exit_date IS NOT NULL GROUP BY 1, 2) AS r ON r.strategy = n.strategy AND r.exit_date = c.date
  LEFT JOIN (SELECT o.strategy, b.date, SUM(100 * (b.close - o.entry_price)) AS v FROM outc o JOIN bars b ON b.code = o.code AND b.date >= o.entry_date
     AND (o.exit_date IS NULL OR b.date < o.exit_date) GROUP BY 1, 2) AS o ON o.strategy = n.strategy AND o.date = c.date""", "outc cal bars sig")
q("s11_equity_curve", "strategy date equity:4", "SELECT * FROM equity", "equity")(lambda m: s.equity_curve(open_and_closed(m), m.bars()))
cte("pos", f"""SELECT strategy || '-' || code || '-' || CAST(date AS VARCHAR) AS id, code, entry_date AS buy_date, CASE WHEN exit_date IS NOT NULL OR {NUM} % 3 <> 0 THEN entry_price END AS buy_price,
  CASE WHEN exit_date IS NULL THEN 'active' ELSE 'closed' END AS status, exit_date AS sell_date, exit_price AS sell_price, exit_reason AS sell_reason,
  ROUND_EVEN((exit_price - entry_price) / entry_price * 100, 2) AS profit_pct FROM outc""", "outc")


def pos(m):
    return po.from_trades(open_and_closed(m))


cte("mon0", """SELECT p.id, p.code, p.buy_price, b.date, b.high, b.low, b.close, LAG(b.close) OVER w AS pc, ROW_NUMBER() OVER w AS n FROM pos p JOIN bars b ON b.code = p.code AND b.date >= p.buy_date
  WHERE p.status = 'active' AND p.buy_price IS NOT NULL WINDOW w AS (PARTITION BY p.id ORDER BY b.date)""", "pos bars")
cte("mon", """SELECT *, ROUND_EVEN(buy_price - atr, 3) AS sp, ROUND_EVEN(buy_price + 4 * atr, 3) AS tp, ROUND_EVEN((close - buy_price) / buy_price * 100, 2) AS chg FROM (
  SELECT *, CASE WHEN n >= 30 THEN AVG(tr) OVER (PARTITION BY id ORDER BY date ROWS 29 PRECEDING) ELSE tr END AS atr, MAX(n) OVER (PARTITION BY id) AS nn FROM (
    SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE GREATEST(high - low, ABS(high - pc), ABS(low - pc)) END AS tr FROM mon0) AS x) AS y WHERE n = nn""", "mon0")
PRG = "COALESCE(ROUND_EVEN(CASE WHEN {t} = {a} THEN 0 ELSE GREATEST(0, LEAST(100, ({n} - {a}) / ({t} - {a}) * 100)) END, 1), 0)"
q("s12_exit_monitor", "id code current_price change_pct:2 holding_days stop_price:3 target_price:3 stop_hit stop_progress:1 target_hit target_progress:1 time_hit time_progress:1",
  f"""SELECT id, code, close AS current_price, chg AS change_pct, n AS holding_days, sp AS stop_price, tp AS target_price, close <= sp AS stop_hit, {PRG.format(n='close', a='buy_price', t='sp')} AS stop_progress,
  close >= tp AS target_hit, {PRG.format(n='close', a='buy_price', t='tp')} AS target_progress, n >= 10 AND chg <= 2 AS time_hit, LEAST(100, n * 10.0) AS time_progress FROM mon""", "mon")(
    lambda m: po.exit_monitor(pos(m), m.bars()))
SUPPORT = lines(10, "low", "su")
q("s12_support_monitor", "id code broken_support support_price:3 support_progress:1", """SELECT p.id, p.code, x.broken_support, x.sp AS support_price, COALESCE(CASE WHEN x.sp > 0 THEN CASE
  WHEN x.broken_support OR (x.close - x.sp) / x.sp <= 0 THEN 100 WHEN (x.close - x.sp) / x.sp > 0.1 THEN 0 ELSE ROUND_EVEN((0.1 - (x.close - x.sp) / x.sp) / 0.1 * 100, 1) END END, 0) AS support_progress
  FROM pos p JOIN (SELECT t.code, COALESCE(MAX(CASE WHEN t.pos >= t.nt - 3 AND t.close - (l.slope * t.day + l.ic) < -0.05::DOUBLE * ABS(l.slope * t.day + l.ic) THEN 1 ELSE 0 END), 0) = 1 AS broken_support,
    MAX(CASE WHEN t.pos = t.nt - 1 THEN t.close END) AS close, ROUND_EVEN(MAX(CASE WHEN t.pos = t.nt - 1 THEN l.slope * t.day + l.ic END), 3) AS sp FROM p10 t LEFT JOIN su l ON l.code = t.code GROUP BY t.code) AS x
  ON x.code = p.code WHERE p.status = 'active'""", "pos p10", SUPPORT)(lambda m: po.support_monitor(pos(m), m.bars()))
q("s13_open_mark", "id code current_price unrealised_pct:2", """SELECT p.id, p.code, b.close AS current_price, ROUND_EVEN((b.close - p.buy_price) / p.buy_price * 100, 2) AS unrealised_pct
  FROM pos p JOIN b ON b.code = p.code AND b.rn = b.n_rows WHERE p.status = 'active' AND p.buy_price IS NOT NULL""", "pos b")(lambda m: po.mark(pos(m), m.bars()))
q("s14_manual_close", "id code sell_price profit_pct:2", """SELECT p.id, p.code, b.close AS sell_price, ROUND_EVEN((b.close - p.buy_price) / p.buy_price * 100, 2) AS profit_pct
  FROM pos p JOIN b ON b.code = p.code AND b.rn = b.n_rows WHERE p.status = 'active' AND p.buy_price IS NOT NULL""", "pos b")(lambda m: po.close_now(pos(m), m.bars()))
cte("pw", """SELECT code, as_of, date, day, lo_price, lo_price AS hi_price, close, pos, nt, ROW_NUMBER() OVER (PARTITION BY code, part ORDER BY lo_price, pos) = 1 AS seg_low, FALSE AS seg_high FROM (
  SELECT *, CASE WHEN pos >= 2 THEN 1 ELSE 0 END + CASE WHEN pos >= 5 THEN 1 ELSE 0 END + CASE WHEN pos >= 7 THEN 1 ELSE 0 END AS part FROM (
    SELECT a.code || '|' || CAST(a.date AS VARCHAR) AS code, a.date AS as_of, z.date, z.low AS lo_price, z.close, z.rn - (a.rn - 9) AS pos, 10 AS nt,
      CAST(date_diff('day', MIN(z.date) OVER (PARTITION BY a.code, a.date), z.date) AS BIGINT) AS day FROM b a JOIN b z ON z.code = a.code AND z.rn BETWEEN a.rn - 9 AND a.rn WHERE a.rn >= 30) AS x0) AS x1""", "b")
REPLAY = lines(10, "low", "mv", "pw") + """,
flags AS MATERIALIZED (SELECT p.code FROM pw p JOIN mv l ON l.code = p.code WHERE p.pos >= 7 AND p.close - (l.slope * p.day + l.ic) < -0.05::DOUBLE * ABS(l.slope * p.day + l.ic) GROUP BY p.code),
rp AS MATERIALIZED (SELECT e.strategy, e.code, e.date, e.entry_date AS buy_date, e.entry_price, z.date AS d, z.high, z.close, f.code IS NOT NULL AS hit FROM ent e JOIN b z ON z.code = e.code AND z.date > e.entry_date
  LEFT JOIN flags f ON f.code = z.code || '|' || CAST(z.date AS VARCHAR)),
rs AS MATERIALIZED (SELECT *, COALESCE(MIN(CASE WHEN hit THEN d END) OVER w, MAX(d) OVER w) AS sell_date, MAX(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS was FROM rp WINDOW w AS (PARTITION BY strategy, code, date))"""
REPLAY_SQL = """SELECT strategy, code, date, buy_date, sell_date,
  MAX(CASE WHEN d = sell_date THEN close END) AS sell_price, CASE WHEN was = 1 THEN 'support_break' ELSE 'end_of_data' END AS exit_reason, COUNT(*) AS holding_days,
  (MAX(CASE WHEN d = sell_date THEN close END) - entry_price) / entry_price AS profit_rate, GREATEST((MAX(high) - entry_price) / entry_price, 0) AS max_profit_rate
  FROM rs WHERE d <= sell_date GROUP BY strategy, code, date, buy_date, sell_date, entry_price, was"""
REPLAY_COLS = "strategy code date buy_date sell_date sell_price exit_reason holding_days profit_rate:6 max_profit_rate:6"
q("s15_support_replay", REPLAY_COLS, REPLAY_SQL, "ent pw", REPLAY)(lambda m: s.support_replay(open_and_closed(m), m.bars()))
q("s15_support_replay_1pct", REPLAY_COLS, REPLAY_SQL, "ent pw", REPLAY.replace("0.05::DOUBLE", "0.01::DOUBLE"))(
    lambda m: s.support_replay(open_and_closed(m), m.bars(), 0.01))
MET = """COUNT(*) AS total_trades, COUNT(CASE WHEN pnl > 0 THEN 1 END) AS winning_trades, COUNT(CASE WHEN pnl <= 0 THEN 1 END) AS losing_trades, AVG(CASE WHEN pnl > 0 THEN 100.0 ELSE 0 END) AS win_rate,
  SUM(pnl) AS total_return, SUM(pnl) / 1000 AS total_return_pct, AVG(pnl_pct) * 100 AS avg_return_pct, COALESCE(AVG(CASE WHEN pnl > 0 THEN pnl_pct END) * 100, 0) AS avg_win_pct,
  COALESCE(AVG(CASE WHEN pnl <= 0 THEN pnl_pct END) * 100, 0) AS avg_loss_pct, COALESCE(SUM(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / NULLIF(ABS(SUM(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)), 0), 'inf'::DOUBLE) AS profit_factor,
  AVG(holding_days) AS avg_holding_days"""
METC = "total_trades winning_trades losing_trades win_rate:5 total_return:4 total_return_pct:5 avg_return_pct:5 avg_win_pct:5 avg_loss_pct:5 profit_factor:5 avg_holding_days:5"
q("s16_confidence_sweep", "min_confidence " + METC, f"SELECT l.x AS min_confidence, {MET} FROM trades JOIN (SELECT UNNEST([50.0::DOUBLE, 60, 70, 80]) AS x) AS l ON confidence >= l.x GROUP BY l.x", "trades")(
    lambda m: s.confidence_sweep(trades(m)))
q("d04_trade_metrics", "strategy " + METC, f"SELECT strategy, {MET} FROM trades GROUP BY strategy", "trades")(lambda m: s.trade_metrics(trades(m)))
q("d05_max_drawdown", "strategy max_drawdown:5", """SELECT strategy, MIN(equity / top - 1) * 100 AS max_drawdown FROM (SELECT *, MAX(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS top
  FROM equity) AS x GROUP BY strategy""", "equity")(lambda m: s.max_drawdown(s.equity_curve(open_and_closed(m), m.bars())))
q("d06_sharpe", "strategy sharpe_ratio:5", "SELECT strategy, COALESCE(AVG(pnl_pct) / NULLIF(STDDEV_SAMP(pnl_pct), 0) * SQRT(252), 0) AS sharpe_ratio FROM trades GROUP BY strategy", "trades")(
    lambda m: s.sharpe(trades(m)))
q("d07_exit_reasons", "strategy exit_reason n", "SELECT strategy, exit_reason, COUNT(*) AS n FROM trades GROUP BY 1, 2", "trades")(lambda m: s.exit_reasons(trades(m)))
q("d08_best_worst", "strategy best_code best_date best_pct:6 worst_code worst_date worst_pct:6", """SELECT a.strategy, a.code AS best_code, a.date AS best_date, a.pnl_pct AS best_pct, z.code AS worst_code, z.date AS worst_date, z.pnl_pct AS worst_pct
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY ROUND(pnl_pct, 12) DESC, code, date) AS k FROM trades) AS a JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY strategy ORDER BY ROUND(pnl_pct, 12), code, date) AS k FROM trades) AS z
  ON a.strategy = z.strategy AND a.k = 1 AND z.k = 1""", "trades")(lambda m: s.extremes(trades(m).withColumn("pnl_pct", F.round("pnl_pct", 12))))
q("d27_confidence_fit", "strategy n correlation:5 slope:6 intercept:6", """SELECT strategy, COUNT(*) AS n, CASE WHEN VAR_POP(confidence) > 0 THEN CORR(confidence, pnl_pct) END AS correlation,
  CASE WHEN VAR_POP(confidence) > 0 THEN REGR_SLOPE(pnl_pct, confidence) END AS slope, CASE WHEN VAR_POP(confidence) > 0 THEN REGR_INTERCEPT(pnl_pct, confidence) END AS intercept FROM trades GROUP BY strategy""", "trades")(
    lambda m: s.confidence_fit(trades(m)))
q("d28_agreement", "strategy code date n_models", "SELECT strategy, code, date, n AS n_models FROM (SELECT *, COUNT(*) OVER (PARTITION BY code, date) AS n FROM sig) AS x WHERE n > 1", "sig")(
    lambda m: s.agreement(s.all_signals(m.bars())))
q("d34_win_rate", "n_closed win_rate:6", "SELECT COUNT(*) AS n_closed, AVG(CASE WHEN profit_pct > 0 THEN 1 ELSE 0 END) AS win_rate FROM pos WHERE status = 'closed'", "pos")(
    lambda m: po.win_rate(pos(m)))
q("s32_closed_history", "id code sell_date profit_pct:2", "SELECT id, code, sell_date, profit_pct FROM pos WHERE status = 'closed' ORDER BY sell_date DESC, id LIMIT 50", "pos")(
    lambda m: po.history(pos(m)))


def model_side(m):
    return scored(m).where("prob >= 0.5").withColumns({"signal": F.when(F.col("prob") > 0.502, "buy").otherwise("hold"), "confidence": F.col("prob") * 100})


def rule_side(m):
    return s.golden_cross(m.bars()).withColumn("signal", F.col("signal_type"))


q("s07_hybrid", "code date signal confidence:5", """SELECT COALESCE(a.code, r.code) AS code, COALESCE(a.date, r.date) AS date, CASE WHEN a.code IS NULL THEN 'buy' WHEN r.code IS NULL THEN a.signal
  WHEN a.signal = 'buy' THEN 'buy' ELSE 'hold' END AS signal, CASE WHEN a.code IS NULL THEN r.confidence WHEN r.code IS NULL THEN a.confidence ELSE a.confidence * 0.5 + r.confidence * 0.5 END AS confidence
  FROM (SELECT code, date, CASE WHEN prob > 0.502::DOUBLE THEN 'buy' ELSE 'hold' END AS signal, prob * 100 AS confidence FROM scored WHERE prob >= 0.5) AS a
  FULL JOIN sig1 r ON r.code = a.code AND r.date = a.date""", "scored sig1")(lambda m: s.hybrid(model_side(m), rule_side(m)))


def odd_signals(m):
    n = F.substring("code", 4, 20).cast("long")
    return s.all_signals(m.bars()).withColumns({"signal_type": F.when(n % 5 == 0, "short").otherwise("buy"), "confidence": F.when(n % 4 == 0, F.col("confidence") * 2).otherwise(F.col("confidence"))})


BAD = f"{NUM} % 5 = 0 OR ({NUM} % 4 = 0 AND confidence * 2 > 100)"
q("v01_signal_check", "strategy code date side", f"SELECT strategy, code, date, CASE WHEN {BAD} THEN 'quarantine' ELSE 'valid' END AS side FROM sig", "sig")(
    lambda m: (lambda ok, bad: ok.withColumn("side", F.lit("valid")).unionByName(bad.withColumn("side", F.lit("quarantine"))))(*s.checked(odd_signals(m))))

# --- position joins ---------------------------------------------------------
q("c20_exclude_held", "strategy code date", "SELECT strategy, code, date FROM sig2all WHERE code NOT IN (SELECT code FROM pos WHERE status = 'active' AND id LIKE 'breakout%')", "sig2all pos")(
    lambda m: s.momentum(m.bars(), best_only=False).join(pos(m).where("status = 'active' AND id LIKE 'breakout%'").select("code").distinct(), "code", "left_anti"))


def tracked(m):
    return pos(m).where("status = 'active'").groupBy("code").agg(F.sum("quantity").alias("quantity"))


def held(m):
    return m.stock_basic().where(F.substring("code", 4, 20).cast("long") % 2 == 0).select("code", F.lit(100).cast("long").alias("quantity"))


q("c21_reconcile", "code tracked_quantity held_quantity side", f"""SELECT COALESCE(t.code, h.code) AS code, t.n AS tracked_quantity, h.n AS held_quantity, CASE WHEN h.code IS NULL THEN 'not_at_broker'
  WHEN t.code IS NULL THEN 'not_tracked' ELSE 'both' END AS side FROM (SELECT code, 100 * COUNT(*) AS n FROM pos WHERE status = 'active' GROUP BY code) AS t
  FULL JOIN (SELECT code, CAST(100 AS BIGINT) AS n FROM stock_basic WHERE {NUM} % 2 = 0) AS h ON h.code = t.code""", "pos stock_basic")(lambda m: joins.reconcile(tracked(m), held(m)))
q("c22_fill_buy_price", "id code buy_price", "SELECT p.id, p.code, COALESCE(p.buy_price, b.open) AS buy_price FROM pos p LEFT JOIN bars b ON b.code = p.code AND b.date = p.buy_date", "pos bars")(
    lambda m: joins.fill_buy_price(pos(m), m.bars()))


# --- CSV sinks and reader ---------------------------------------------------
def csv_round_trip(m):
    path = work_dir(m.spark, "trades-csv")
    trades(m).select("strategy", "code", "date", "entry_date", "entry_price", "exit_date", "exit_price", "pnl", "pnl_pct", "exit_reason", "holding_days").write.csv(path, header=True)
    schema = "strategy string, code string, date date, entry_date date, entry_price double, exit_date date, exit_price double, pnl double, pnl_pct double, exit_reason string, holding_days long"
    return m.spark.read.csv(path, header=True, schema=schema)


q("a24_trades_csv", "strategy code date entry_price exit_price pnl:5 exit_reason holding_days", "SELECT * FROM trades", "trades")(csv_round_trip)


def bilingual(m):
    path = work_dir(m.spark, "report-csv")
    trades(m).select(F.col("code").cast("long").alias("股票代码"), F.col("entry_date").alias("买入日期"), F.col("entry_price").alias("买入价格"), F.col("exit_date").alias("卖出日期"),
                     F.col("exit_price").alias("卖出价"), F.col("exit_reason").alias("退出原因")).write.csv(path, header=True)
    return payload.report(m.spark.read.csv(path, header=True))


q("a25_report_reader", "code buy_date buy_price sell_date sell_price pnl_pct exit_reason", """SELECT code, entry_date AS buy_date, entry_price AS buy_price, exit_date AS sell_date, exit_price AS sell_price,
  CAST(NULL AS DOUBLE) AS pnl_pct, exit_reason FROM trades""", "trades")(bilingual)
