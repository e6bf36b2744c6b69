"""Swing points, two-point trend lines and market structure.

A trend line looks at the last 50 (long) or 10 (short) bars only. Those bars
ride along as one short array per row, and points, candidate lines, crossing
checks and scores are array expressions on it: no self join, no extra shuffle,
and the same code serves the last bar or every bar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import by_code, trailing, where_computed
from quantweave.operators.scans import last_n

# Trend-line settings.
LONG_ROWS, SHORT_ROWS, SWING, MIN_SWINGS, TOLERANCE, MIN_TOUCHES, BREAK = 50, 10, 5, 2, 0.02, 2, 0.05
MIN_ROWS = 20


def swings(bars: DataFrame, w: int = SWING, strict: bool = True) -> DataFrame:
    """Swing flags: extreme against w neighbours on both sides (all of them present)."""
    back, ahead = by_code().rowsBetween(-w, -1), by_code().rowsBetween(1, w)
    full = (F.count(F.lit(1)).over(back) == w) & (F.count(F.lit(1)).over(ahead) == w)
    low, high = F.col("low"), F.col("high")
    edge_low = F.least(F.min("low").over(back), F.min("low").over(ahead))
    edge_high = F.greatest(F.max("high").over(back), F.max("high").over(ahead))
    is_low = (low < edge_low) if strict else (low <= edge_low)
    is_high = (high > edge_high) if strict else (high >= edge_high)
    return bars.withColumns({"swing_low": full & F.coalesce(is_low, F.lit(False)),
                             "swing_high": full & F.coalesce(is_high, F.lit(False))})


def tails(bars: DataFrame, n: int = LONG_ROWS) -> DataFrame:
    """One row per instrument with its last n bars as an array (oldest first)."""
    cut = last_n(bars.select("code", "date", "low", "high", "close"), n)
    rows = bars.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"))
    arr = cut.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("date", "low", "high", "close"))).alias("win"))
    return arr.join(rows, "code").withColumn("as_of", F.element_at("win", -1)["date"])


def moving_tails(bars: DataFrame, n: int = SHORT_ROWS) -> DataFrame:
    """The same for every bar: its trailing n bars."""
    return bars.select("code", F.col("date").alias("as_of"), F.row_number().over(by_code()).alias("n_rows"),
                       F.collect_list(F.struct("date", "low", "high", "close")).over(trailing(n)).alias("win"))


def _points(win: Column, price: str) -> Column:
    first = F.element_at(win, 1)["date"]
    return F.transform(win, lambda r, i: F.struct(F.datediff(r["date"], first).alias("day"), r[price].alias("price"),
                                                  r["date"].alias("date"), i.alias("pos")))


def segment_points(ps: Column, kind: str, parts: int = 4) -> Column:
    """First extreme of each of four equal slices; none if there are fewer bars than slices."""
    n = F.size(ps)

    def one(k):
        a, z = F.floor(n * k / parts).cast("int"), F.floor(n * (k + 1) / parts).cast("int")
        piece = F.slice(ps, a + 1, z - a)
        if kind == "low":
            pos = F.array_min(F.transform(piece, lambda x: F.struct(x["price"].alias("p"), x["pos"].alias("q"))))["q"]
        else:
            pos = -F.array_max(F.transform(piece, lambda x: F.struct(x["price"].alias("p"), (-x["pos"]).alias("q"))))["q"]
        return F.get(ps, pos)
    return F.when(n >= parts, F.array(*[one(k) for k in range(parts)])).otherwise(F.slice(ps, 1, 0))


def swing_points(ps: Column, kind: str, w: int) -> Column:
    n = F.size(ps)

    def ok(x, i):
        near = F.concat(F.slice(ps, F.greatest(i - w + 1, F.lit(1)), F.lit(w)), F.slice(ps, i + 2, F.lit(w)))
        beats = (lambda y: y["price"] > x["price"]) if kind == "low" else (lambda y: y["price"] < x["price"])
        return (i >= w) & (i < n - w) & F.forall(near, beats)
    return F.filter(ps, ok)


def _lines(pts: Column, ps: Column, kind: str, recent: bool) -> Column:
    last = F.element_at(ps, -1)["day"]
    mean = F.aggregate(ps, F.lit(0.0), lambda a, x: a + x["price"]) / F.size(ps)
    pairs = F.flatten(F.transform(pts, lambda p, i: F.transform(
        F.slice(pts, i + 2, F.size(pts)),
        lambda r, j: F.struct(i.alias("i"), (i + j + 1).alias("j"), p.alias("p"), r.alias("r"),
                              F.try_divide(r["price"] - p["price"], r["day"] - p["day"]).alias("slope")))))
    lines = F.transform(pairs, lambda c: F.struct(
        c["i"].alias("i"), c["j"].alias("j"), c["p"].alias("p"), c["r"].alias("r"), c["slope"].alias("slope"),
        (c["p"]["price"] - c["slope"] * c["p"]["day"]).alias("intercept")))

    def over(c):
        gap = (lambda x: c["slope"] * x["day"] + c["intercept"] - x["price"])
        return F.array_max(F.transform(ps, gap if kind == "low" else lambda x: -gap(x)))

    def touch(c):
        def near(x):
            e = c["slope"] * x["day"] + c["intercept"]
            return (F.abs(e) >= 1e-10) & (F.abs(x["price"] - e) <= TOLERANCE * F.abs(e))
        return F.size(F.filter(pts, near))
    checked = F.transform(lines, lambda c: F.struct(c.alias("c"), over(c).alias("over"), touch(c).alias("touches")))
    valid = F.filter(checked, lambda v: v["c"]["slope"].isNotNull() & (v["touches"] >= MIN_TOUCHES)
                     & ((v["over"] <= 0) | ((mean > 0) & (v["over"] / mean <= TOLERANCE))))

    def score(v):
        p, r = v["c"]["p"], v["c"]["r"]
        span = F.coalesce(F.try_divide(r["day"] - p["day"], last), F.lit(0.0))
        base = v["touches"] * 100 + span * 50
        if recent:
            base = base + F.coalesce((1 - F.try_divide(last - r["day"], last)) * 80, F.lit(0.0))
            base = base + F.when(p["day"] >= last / 2, 30).otherwise(0)
        else:
            base = base + (1 - F.coalesce(F.try_divide(p["day"], last), F.lit(0.0))) * 80 + span * 30
        pct = F.abs(v["c"]["slope"] / p["price"]) * 100
        # Slope bands of the score.
        band = (F.when((pct >= 0.05) & (pct <= 0.5), 20).when((pct >= 0.02) & (pct < 0.05), 15)
                .when((pct > 0.5) & (pct <= 1.0), 12).when(pct > 0, 5).otherwise(0))
        return base + F.when(p["price"] > 0, band).otherwise(0)
    return F.transform(valid, lambda v: F.struct(
        F.round(score(v), 9).alias("score"), (-v["c"]["i"]).alias("ni"), (-v["c"]["j"]).alias("nj"),
        v["touches"].alias("touches"), v["c"]["slope"].alias("slope"), v["c"]["intercept"].alias("intercept"),
        v["c"]["p"].alias("p"), v["c"]["r"].alias("r")))


def best_line(df: DataFrame, kind: str, horizon: str, out: str = "line") -> DataFrame:
    """Best two-point line over ``win``: highest score, earliest pair on ties; null without a valid one."""
    rows = LONG_ROWS if horizon == "long" else SHORT_ROWS
    tail = F.when(F.size("win") > rows, F.slice("win", F.size("win") - rows + 1, F.lit(rows))).otherwise(F.col("win"))
    df = df.withColumn("_ps", _points(tail, kind))
    seg = segment_points(F.col("_ps"), kind)
    if horizon == "long":
        df = df.withColumn("_sw", swing_points(F.col("_ps"), kind, SWING))
        pts = F.when(F.size("_sw") >= MIN_SWINGS, F.col("_sw")).otherwise(
            F.array_sort(F.array_distinct(F.concat(F.col("_sw"), seg))))
    else:
        pts = F.array_sort(seg)
    df = df.withColumn("_pts", pts)
    df = df.withColumn("_best", F.array_max(_lines(F.col("_pts"), F.col("_ps"), kind, horizon == "long")))
    b = F.col("_best")
    line = F.when(b.isNotNull(), F.struct(
        b["slope"].alias("slope"), b["intercept"].alias("intercept"), F.element_at("_ps", 1)["date"].alias("base_date"),
        b["touches"].alias("touches"), b["p"]["date"].alias("start_date"), b["p"]["price"].alias("start_price"),
        b["r"]["date"].alias("end_date"), b["r"]["price"].alias("end_price"), (b["slope"] > 0).alias("is_rising"),
        b["score"].alias("score"), F.degrees(F.atan(b["slope"])).alias("angle_degrees")))
    return df.withColumn(out, line).drop("_ps", "_sw", "_pts", "_best")


LINE_FIELDS = ["slope", "intercept", "base_date", "touches", "start_date", "start_price", "end_date", "end_price",
               "is_rising", "score", "angle_degrees"]


def line_rows(bars: DataFrame, kind: str, horizon: str) -> DataFrame:
    df = best_line(tails(bars).where(F.col("n_rows") >= MIN_ROWS), kind, horizon)
    return where_computed(df.select("code", "line"), F.col("line").isNotNull()).select("code", *[F.col(f"line.{f}") for f in LINE_FIELDS])


def line_at(line: Column, date: Column) -> Column:
    return line["slope"] * F.datediff(date, line["base_date"]) + line["intercept"]


def broken(line: str = "line", threshold: float = BREAK) -> Column:
    """Any of the last three closes more than the threshold below the line."""
    ln = F.col(line)
    last3 = F.slice("win", F.greatest(F.size("win") - 2, F.lit(1)), F.lit(3))

    def below(r):
        e = line_at(ln, r["date"])
        return (F.abs(e) > 1e-10) & ((r["close"] - e) < -threshold * F.abs(e))
    return F.coalesce(F.exists(last3, below), F.lit(False))


def broken_support(df: DataFrame, threshold: float = BREAK) -> DataFrame:
    return best_line(df, "low", "short", "support").withColumn("broken_support", broken("support", threshold))


def trend_analysis(bars: DataFrame) -> DataFrame:
    """Four lines and the broken-support flag per instrument with at least 20 rows."""
    df = tails(bars).where(F.col("n_rows") >= MIN_ROWS)
    for name, kind, horizon in [("uptrend_line", "low", "long"), ("downtrend_line", "high", "long"),
                                ("short_uptrend_line", "low", "short"), ("short_downtrend_line", "high", "short")]:
        df = best_line(df, kind, horizon, name)
    return df.withColumn("broken_support", broken("short_uptrend_line")).drop("win")


def segments(bars: DataFrame, kind: str, rows: int = LONG_ROWS) -> DataFrame:
    df = tails(bars, rows).withColumn("_ps", _points(F.col("win"), kind))
    return df.select("code", F.inline(segment_points(F.col("_ps"), kind)))


def candidate_pairs(bars: DataFrame, kind: str = "low") -> DataFrame:
    """All ordered pairs of the swing points among the last 50 bars with their slope (at most 50 bars per row)."""
    df = tails(bars).withColumn("_ps", _points(F.col("win"), kind))
    df = df.withColumn("_pts", swing_points(F.col("_ps"), kind, SWING))
    pts = F.col("_pts")
    pairs = F.flatten(F.transform(pts, lambda p, i: F.transform(F.slice(pts, i + 2, F.size(pts)), lambda r: F.struct(
        p["date"].alias("start_date"), r["date"].alias("end_date"),
        ((r["price"] - p["price"]) / (r["day"] - p["day"])).alias("slope"),
        F.array_max(F.transform(F.col("_ps"), lambda x: p["price"] + (r["price"] - p["price"]) / (r["day"] - p["day"])
                                * (x["day"] - p["day"]) - x["price"])).alias("max_violation")))))
    return df.select("code", F.inline(pairs))


def support_distance(bars: DataFrame) -> DataFrame:
    df = broken_support(tails(bars).where(F.col("n_rows") >= MIN_ROWS))
    value = line_at(F.col("support"), F.col("as_of"))
    close = F.element_at("win", -1)["close"]
    return where_computed(df, F.col("support").isNotNull()).select(
        "code", "as_of", value.alias("support_price"), ((close - value) / value * 100).alias("distance_pct"),
        F.col("support.start_date").alias("first_touch"), F.col("support.end_date").alias("last_touch"))


def trend_strength(bars: DataFrame, atr_rows: int = 30) -> DataFrame:
    """abs(20-row momentum %) x relative volume x relative range, clamped to 0..100; 0 below 20 rows."""
    w = by_code()
    pc = F.lag("close").over(w)
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    df = bars.withColumns({"_rn": F.row_number().over(w), "_tr": tr, "_c20": F.lag("close", 19).over(w)})
    df = df.withColumns({"_v10": F.avg("volume").over(trailing(10)), "_atr": F.avg("_tr").over(trailing(atr_rows)),
                         "_va": F.avg("volume").over(Window.partitionBy("code"))})
    last = df.groupBy("code").agg(F.max_by(F.struct("close", "_rn", "_c20", "_v10", "_atr", "_va"), "date").alias("s"),
                                  F.max("date").alias("as_of")).select("code", "as_of", "s.*")
    momentum = F.when(F.col("_c20") != 0, (F.col("close") - F.col("_c20")) / F.col("_c20") * 100).otherwise(0.0)
    volume = F.when(F.col("_va") > 0, F.col("_v10") / F.col("_va")).otherwise(1.0)
    wide = F.when((F.col("_rn") > atr_rows) & (F.col("close") != 0),
                  F.least(F.col("_atr") / F.col("close") * 100, F.lit(10.0))).otherwise(5.0)
    value = F.least(F.greatest(F.abs(momentum) * volume * wide / 5, F.lit(0.0)), F.lit(100.0))
    return last.select("code", "as_of", F.when(F.col("_rn") < 20, F.lit(0.0)).otherwise(value).alias("strength"))


def market_structure(bars: DataFrame, min_rows: int = 50) -> DataFrame:
    """Direction and pattern from the last two swing highs and lows."""
    df = swings(bars, SWING, strict=False)

    def last_two(flag, price):
        return F.slice(F.sort_array(F.collect_list(F.when(F.col(flag), F.struct("date", F.col(price).alias("p")))), asc=False), 1, 2)
    s = df.groupBy("code").agg(F.count(F.lit(1)).alias("n_rows"), last_two("swing_high", "high").alias("hi"),
                               last_two("swing_low", "low").alias("lo")).where(F.col("n_rows") >= min_rows)
    h1, h2, l1, l2 = F.get("hi", 0)["p"], F.get("hi", 1)["p"], F.get("lo", 0)["p"], F.get("lo", 1)["p"]
    enough = (F.size("hi") >= 2) & (F.size("lo") >= 2)
    up, down = (h1 > h2) & (l1 > l2), (h1 < h2) & (l1 < l2)
    mixed = ((h1 > h2) & (l1 < l2)) | ((h1 < h2) & (l1 > l2))
    s = s.withColumns({
        "trend": F.when(~enough, "insufficient_data").when(up, "uptrend").when(down, "downtrend").when(mixed, "neutral")
        .otherwise("consolidation"),
        "pattern": F.when(~enough, F.lit(None)).when(up, "HH_HL").when(down, "LH_LL").when(mixed, "mixed_signals").otherwise("sideways"),
        "structure_shift": enough & mixed, "resistance": F.when(enough, h1), "support": F.when(enough, l1)})
    return s.join(trend_strength(bars), "code").withColumn(
        "strength", F.when(F.col("trend") == "insufficient_data", 0.0).otherwise(F.col("strength")))
