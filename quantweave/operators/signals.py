"""Rule strategies, trade outcomes and trade metrics, for all dates at once.

A strategy is a function of bars that returns signal rows; outcomes treat every
signal on its own (no shared cash), so they are joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import by_code, div, lag, sma, trailing
from quantweave.operators.filters import entry_gate
from quantweave.operators.scans import calendar

# Commission, exit switches and time stop.
FEE = 0.005
TIME_STOP_DAYS, TIME_STOP_PNL = 10, 0.02
BLOCK = 32  # sessions; longer than the time stop, so that later blocks never start inside it
SIGNAL_COLUMNS = ["strategy", "code", "date", "signal_type", "price", "confidence", "stop_loss", "take_profit"]


def _signals(df: DataFrame, name: str, stop: Column, target: Column, confidence: Column) -> DataFrame:
    return df.select(F.lit(name).alias("strategy"), "code", "date", F.lit("buy").alias("signal_type"),
                     F.col("close").alias("price"), confidence.alias("confidence"), stop.alias("stop_loss"), target.alias("take_profit"))


def golden_cross(bars: DataFrame, short: int = 5, long: int = 20) -> DataFrame:
    df = bars.withColumns({"_s": sma("close", short), "_l": sma("close", long)})
    df = df.withColumns({"_ps": lag("_s"), "_pl": lag("_l")})
    df = df.where((F.col("_s") > F.col("_l")) & (F.col("_ps") <= F.col("_pl")))
    return _signals(df, "golden_cross", F.col("close") * 0.95, F.col("close") * 1.10, F.lit(70.0))


def momentum(bars: DataFrame, rows: int = 20, threshold: float = 0.10, atr_rows: int = 14, best_only: bool = True) -> DataFrame:
    pc = lag("close")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    df = bars.withColumns({"_tr": tr, "_past": lag("close", rows)})
    df = df.withColumns({"_atr": F.avg("_tr").over(trailing(atr_rows)), "_m": div(F.col("close") - F.col("_past"), F.abs("_past"))})
    df = df.where(F.col("_m") > threshold)
    if best_only:
        w = Window.partitionBy("date").orderBy(F.desc("_m"), "code")
        df = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1)
    return _signals(df, "momentum", F.col("close") - 2 * F.col("_atr"), F.col("close") + 3 * F.col("_atr"),
                    F.least(F.col("_m") * 100, F.lit(100.0)))


def breakout(bars: DataFrame, rows: int = 20, volume_factor: float = 1.5) -> DataFrame:
    before = by_code().rowsBetween(-rows, -1)
    full = F.count(F.lit(1)).over(before) == rows
    df = bars.withColumns({"_top": F.when(full, F.max("high").over(before)), "_vol": F.avg("volume").over(before)})
    df = df.where((F.col("close") > F.col("_top")) & (F.col("volume") > F.col("_vol") * volume_factor))
    return _signals(df, "breakout", F.col("_top") * 0.98, F.col("close") * 1.15, F.lit(75.0))


def all_signals(bars: DataFrame) -> DataFrame:
    return golden_cross(bars).unionByName(momentum(bars)).unionByName(breakout(bars))


def checked(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid signals and the quarantine (unknown type or confidence outside 0..100)."""
    ok = F.coalesce(F.col("signal_type").isin("buy", "sell", "hold") & F.col("confidence").between(0, 100), F.lit(False))
    return signals.where(ok), signals.where(~ok)


def hybrid(model: DataFrame, rule: DataFrame, model_weight: float = 0.5, rule_weight: float = 0.5) -> DataFrame:
    """Weighted confidence where both sides have a signal, the single side otherwise; buy only if both buy."""
    a = model.select("code", "date", F.col("signal").alias("_sa"), F.col("confidence").alias("_ca"))
    b = rule.select("code", "date", F.col("signal").alias("_sb"), F.col("confidence").alias("_cb"))
    j = a.join(b, ["code", "date"], "full_outer")
    both = F.col("_sa").isNotNull() & F.col("_sb").isNotNull()
    return j.select(
        "code", "date",
        F.when(both, F.when((F.col("_sa") == "buy") & F.col("_sb").isin("buy", "strong_buy"), "buy").otherwise("hold"))
        .otherwise(F.coalesce("_sa", "_sb")).alias("signal"),
        F.when(both, F.col("_ca") * model_weight + F.col("_cb") * rule_weight).otherwise(F.coalesce("_ca", "_cb")).alias("confidence"))


def entries(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Signals that can be entered at the next session's open; exit levels keep their distance to the entry price."""
    gate = entry_gate(bars).where(F.col("entry_price").isNotNull()).select("code", "date", "entry_date", "entry_price")
    df = signals.where(F.col("signal_type") == "buy").join(gate, ["code", "date"])
    shift = F.col("entry_price") - F.col("price")
    return df.withColumns({"stop_loss": F.col("stop_loss") + shift, "take_profit": F.col("take_profit") + shift})


def exit_index(path: DataFrame) -> list[DataFrame]:
    """Block extremes of ``path(code, _n, _d, low, high, close)`` in levels: a row of level 0 holds the bars of ``BLOCK`` sessions, a row
    of a higher level the extremes of ``BLOCK`` rows of the level below. The last level has one row for each instrument."""
    last = path.agg(F.max("_n")).first()[0] or 0
    kid = F.struct(F.col("_n").cast("long").alias("i"), F.col("low").alias("lo"), F.col("high").alias("hi"), F.col("close").alias("cl"), F.col("_d").alias("d"))
    levels, above = [path.groupBy("code", F.floor(F.col("_n") / BLOCK).alias("row")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))], last // BLOCK
    while above:
        kid = F.struct(F.col("row").alias("i"), F.array_min(F.transform("kids", lambda k: k["lo"])).alias("lo"), F.array_max(F.transform("kids", lambda k: k["hi"])).alias("hi"),
                       F.array_min(F.transform("kids", lambda k: k["cl"])).alias("cl"))
        below = levels[-1].select("code", "row", kid.alias("kid"))
        levels.append(below.groupBy("code", F.floor(F.col("row") / BLOCK).alias("row")).agg(F.sort_array(F.collect_list("kid")).alias("kids")))
        above //= BLOCK
    return levels


def outcomes(signals: DataFrame, bars: DataFrame, time_stop: bool = False, ids: Sequence[str] = ("strategy", "code", "date")) -> DataFrame:
    """First exit after the entry session: stop, then target, then time stop; fills at the close.

    The exit is looked up in the levels of :func:`exit_index`: the rest of the entry's block and the block
    after it bar by bar, then upwards, each level from where the one below ended, until some block reaches an exit
    level, and downwards into that block. A step joins every signal with one row of at most ``BLOCK`` entries, so the
    work is linear in the signals and logarithmic in the length of the history.
    """
    ids = list(ids)
    e = entries(signals, bars)
    path = bars.select("code", F.col("date").alias("_d"), "high", "low", "close", F.row_number().over(by_code()).alias("_n"))
    found = e.join(path.select("code", F.col("_d").alias("entry_date"), F.col("_n").alias("_n0")), ["code", "entry_date"])
    levels = exit_index(path)

    def why(k, bar):
        reason = F.when(k["lo"] <= F.col("stop_loss"), "stop_loss").when(k["hi"] >= F.col("take_profit"), "take_profit")
        if time_stop:
            late = (k["i"] - F.col("_n0") >= TIME_STOP_DAYS) if bar else F.lit(True)
            reason = reason.when(late & ((k["cl"] - F.col("entry_price")) / F.abs("entry_price") <= TIME_STOP_PNL), "time_stop")
        return reason

    def look(df, level, row, start, out):
        """Adds ``out``: the first child of ``row`` of ``level``, from ``start`` on, that reaches an exit level."""
        table = levels[level].select(F.col("code").alias("_c"), F.col("row").alias("_row"), "kids")
        hit = F.filter("kids", lambda k: (k["i"] >= start) & why(k, level == 0).isNotNull())
        df = df.withColumn("_at", row).join(table, (F.col("code") == F.col("_c")) & (F.col("_at") == F.col("_row")), "left")
        return df.withColumn(out, F.get(hit, F.lit(0))).drop("_at", "_c", "_row", "kids")
    block = F.floor((F.col("_n0") + 1) / BLOCK)
    found = look(found, 0, block, F.col("_n0") + 1, "_x")
    # Blocks after the next one lie beyond the time stop, so their extremes alone decide.
    next_block = F.when(F.col("_x").isNull(), block + 1)
    found = look(found, 0, next_block, F.col("_n0") + 1, "_y").withColumn("_x", F.coalesce("_x", "_y")).drop("_y")
    found = found.withColumns({"_start": F.when(F.col("_x").isNull(), block + 2), "_level": F.lit(None).cast("int"), "_child": F.lit(None).cast("long")})
    for level in range(1, len(levels)):
        found = look(found, level, F.floor(F.col("_start") / BLOCK), F.col("_start"), "_y")
        found = found.withColumns({"_level": F.when(F.col("_y").isNotNull(), level).otherwise(F.col("_level")), "_child": F.coalesce("_y.i", "_child"),
                                   "_start": F.when(F.col("_y").isNull(), F.floor(F.col("_start") / BLOCK) + 1)}).drop("_y")
    for level in range(len(levels) - 2, 0, -1):
        found = look(found, level, F.when(F.col("_level") > level, F.col("_child")), F.lit(0), "_y").withColumn("_child", F.coalesce("_y.i", "_child")).drop("_y")
    found = look(found, 0, F.col("_child"), F.lit(0), "_y").withColumn("_x", F.coalesce("_x", "_y")).drop("_y")
    x = F.col("_x")
    rest = [c for c in e.columns if c not in ids]
    return found.select(*ids, *rest, x["d"].alias("exit_date"), x["cl"].alias("exit_price"), F.when(x.isNotNull(), why(x, True)).alias("exit_reason"),
                        (x["i"] - F.col("_n0")).cast("int").alias("holding_days"))


def profit(trades: DataFrame, shares: float = 100.0, fee: float = FEE) -> DataFrame:
    """Closed-trade P&L net of commission on both sides."""
    basis = F.col("entry_price") * shares
    change = (F.col("exit_price") - F.col("entry_price")) / F.abs("entry_price")
    cost, proceeds = basis * (1 + fee), basis * (1 + change) * (1 - fee)
    return trades.where(F.col("exit_date").isNotNull()).withColumns({
        "shares": F.lit(shares), "commission": basis * fee + F.abs(basis * (1 + change)) * fee,
        "pnl": proceeds - cost, "pnl_pct": F.try_divide(proceeds - cost, cost)})


def unrealised(price: Column, entry: Column) -> Column:
    return F.when(entry != 0, (price - entry) / F.abs(entry))


def trade_metrics(trades: DataFrame, keys: Sequence[str] = ("strategy",), capital: float = 100_000.0) -> DataFrame:
    win = F.col("pnl") > 0

    def mean_pct(cond):
        return F.coalesce(F.avg(F.when(cond, F.col("pnl_pct"))) * 100, F.lit(0.0))
    gain, loss = F.sum(F.when(win, F.col("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(~win, F.col("pnl")).otherwise(0.0)))
    n, wins = F.count(F.lit(1)), F.sum(win.cast("long"))
    return trades.groupBy(*keys).agg(
        n.alias("total_trades"), wins.alias("winning_trades"), F.sum((~win).cast("long")).alias("losing_trades"),
        (wins / n * 100).alias("win_rate"), F.sum("pnl").alias("total_return"), (F.sum("pnl") / capital * 100).alias("total_return_pct"),
        (F.avg("pnl_pct") * 100).alias("avg_return_pct"), mean_pct(win).alias("avg_win_pct"), mean_pct(~win).alias("avg_loss_pct"),
        F.when(loss > 0, gain / loss).otherwise(F.lit(float("inf"))).alias("profit_factor"),
        F.avg("holding_days").alias("avg_holding_days"))


def sharpe(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    sd = F.stddev_samp("pnl_pct")
    return trades.groupBy(*keys).agg(F.when(sd.isNull() | (F.min("pnl_pct") == F.max("pnl_pct")), F.lit(0.0)).otherwise(F.avg("pnl_pct") / sd * 252 ** 0.5).alias("sharpe_ratio"))


def exit_reasons(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    return trades.groupBy(*keys, "exit_reason").agg(F.count(F.lit(1)).alias("n"))


def extremes(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    row = F.struct("code", "date", "pnl_pct")
    down = F.struct((-F.col("pnl_pct")).alias("a"), "code", "date")
    up = F.struct("pnl_pct", "code", "date")
    best, worst = F.min_by(row, down), F.min_by(row, up)
    return trades.groupBy(*keys).agg(best.alias("b"), worst.alias("w")).select(
        *keys, F.col("b.code").alias("best_code"), F.col("b.date").alias("best_date"), F.col("b.pnl_pct").alias("best_pct"),
        F.col("w.code").alias("worst_code"), F.col("w.date").alias("worst_date"), F.col("w.pnl_pct").alias("worst_pct"))


STRATEGIES = ("golden_cross", "momentum", "breakout")


def equity_curve(trades: DataFrame, bars: DataFrame, capital: float = 100_000.0, shares: float = 100.0,
                 strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """Per strategy and session: capital + realised P&L so far + open P&L at the close."""
    done = profit(trades, shares).groupBy("strategy", F.col("exit_date").alias("date")).agg(F.sum("pnl").alias("realised"))
    # Open trades enter and leave as +1 / -1 events on their instrument's bars; no trade meets every bar it was held.
    moves = trades.select("strategy", "code", F.inline(F.array_compact(F.array(
        F.struct(F.col("entry_date").alias("date"), F.lit(1).alias("k"), F.col("entry_price").alias("cost")),
        F.when(F.col("exit_date").isNotNull(), F.struct(F.col("exit_date").alias("date"), F.lit(-1).alias("k"), (-F.col("entry_price")).alias("cost")))))))
    moves = moves.groupBy("strategy", "code", "date").agg(F.sum("k").alias("_k"), F.sum("cost").alias("_cost"))
    each = bars.select("code", "date", "close", F.explode(F.array(*[F.lit(n) for n in strategies])).alias("strategy"))
    so_far = Window.partitionBy("code", "strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    held = each.join(moves, ["strategy", "code", "date"], "left").withColumns(
        {"_open": F.sum(F.coalesce("_k", F.lit(0))).over(so_far), "_paid": F.sum(F.coalesce("_cost", F.lit(0.0))).over(so_far)})
    open_pnl = held.groupBy("strategy", "date").agg(F.sum(shares * (F.col("_open") * F.col("close") - F.col("_paid"))).alias("open_pnl"))
    grid = calendar(bars).select("date", F.explode(F.array(*[F.lit(n) for n in strategies])).alias("strategy"))
    w = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = grid.join(done, ["strategy", "date"], "left").join(open_pnl, ["strategy", "date"], "left")
    return df.withColumn("equity", capital + F.sum(F.coalesce("realised", F.lit(0.0))).over(w) + F.coalesce("open_pnl", F.lit(0.0))
                         ).select("strategy", "date", "equity")


def max_drawdown(curve: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    top = F.max("equity").over(w)
    return curve.withColumn("_dd", (F.col("equity") - top) / top).groupBy(*keys).agg((F.min("_dd") * 100).alias("max_drawdown"))


def confidence_sweep(trades: DataFrame, levels: Sequence[float] = (50, 60, 70, 80)) -> DataFrame:
    """Metrics per confidence threshold; each trade expands into the few levels it passes."""
    arr = F.array(*[F.lit(float(x)) for x in levels])
    df = trades.withColumn("min_confidence", F.explode(F.filter(arr, lambda x: F.col("confidence") >= x)))
    return trade_metrics(df, ["min_confidence"])


def confidence_fit(trades: DataFrame, keys: Sequence[str] = ("strategy",)) -> DataFrame:
    # Constant columns are told by their extremes; a variance from several tasks may be a little above zero.
    vx, vy = (F.min(c) < F.max(c) for c in ("confidence", "pnl_pct"))
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.when(vx & vy, F.covar_pop("confidence", "pnl_pct") / (F.stddev_pop("confidence") * F.stddev_pop("pnl_pct"))).alias("correlation"),
        F.when(vx, F.regr_slope("pnl_pct", "confidence")).alias("slope"), F.when(vx, F.regr_intercept("pnl_pct", "confidence")).alias("intercept"))


def agreement(picks: DataFrame) -> DataFrame:
    """Rows of instruments that more than one model selected on the same date."""
    n = F.count(F.lit(1)).over(Window.partitionBy("code", "date"))
    return picks.withColumn("n_models", n).where(F.col("n_models") > 1)


def max_spans(path: DataFrame) -> DataFrame:
    """(code, _n, _spans): entry k is the largest high of the 2^k bars from ``_n`` on, or of those that are left.
    The entries double, one ``lead`` each, so a row holds the logarithm of the history; any range is covered by two of them."""
    last = path.agg(F.max("_n")).first()[0] or 1
    order, df = Window.partitionBy("code").orderBy("_n"), path.select("code", "_n", F.col("high").alias("_m0"))
    names = ["_m0"]
    while 1 << len(names) <= last:
        k = len(names)
        df = df.withColumn(f"_m{k}", F.greatest(f"_m{k - 1}", F.lead(f"_m{k - 1}", 1 << (k - 1)).over(order)))
        names.append(f"_m{k}")
    return df.select("code", "_n", F.array(*names).alias("_spans"))


def support_replay(trades: DataFrame, bars: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Hold from the buy date until the first broken support (re-analysed on every bar with at
    least 30 rows of history), else to the end of data. The next break after each bar is one
    window over the instrument, and its highest price two rows of :func:`max_spans`, so a trade never meets its whole holding time."""
    from quantweave.operators.structure import broken_support, moving_tails
    flags = broken_support(moving_tails(bars), threshold).select(
        "code", F.col("as_of").alias("_d"), (F.col("broken_support") & (F.col("n_rows") >= 30)).alias("_b"))
    w = Window.partitionBy("code").orderBy("_d")
    path = bars.select("code", F.col("date").alias("_d"), "high", "close").join(flags, ["code", "_d"]).withColumn("_n", F.row_number().over(w))
    spot = F.struct("_d", "_n", "close")
    later = path.select("code", F.col("_d").alias("buy_date"), F.col("_n").alias("_n0"), F.first(F.when(F.col("_b"), spot), ignorenulls=True).over(
        w.rowsBetween(1, Window.unboundedFollowing)).alias("_next"), F.last(spot).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_end"))
    t = trades.select("strategy", "code", "date", F.col("entry_date").alias("buy_date"), F.col("entry_price").alias("buy_price"))
    j = t.join(later, ["code", "buy_date"]).where(F.col("_end._n") > F.col("_n0")).withColumn("_s", F.coalesce("_next", "_end"))
    days, buy = F.col("_s._n") - F.col("_n0"), F.col("buy_price")
    spans, k = max_spans(path), F.length(F.bin(days)) - 1
    j = j.withColumns({"_k": k, "_left": F.col("_n0") + 1, "_right": F.col("_s._n") - F.call_function("shiftleft", F.lit(1), k) + 1})
    for side in ("_left", "_right"):
        j = j.join(spans.select("code", F.col("_n").alias(side), F.col("_spans").alias(f"_of{side}")), ["code", side])
    top = F.greatest(F.get("_of_left", F.col("_k")), F.get("_of_right", F.col("_k")))
    return j.select(
        "strategy", "code", "date", "buy_date", F.col("_s._d").alias("sell_date"), F.col("_s.close").alias("sell_price"),
        F.when(F.col("_next").isNotNull(), "support_break").otherwise("end_of_data").alias("exit_reason"), days.cast("long").alias("holding_days"),
        ((F.col("_s.close") - buy) / buy).alias("profit_rate"), F.greatest((top - buy) / buy, F.lit(0.0)).alias("max_profit_rate"))
