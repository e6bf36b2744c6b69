"""Candlestick shapes on bars, with their price-position context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import div, flag, lag, lead, rmax, rmin, rsum, sma
from quantweave.operators.technical import zero


@dataclass(frozen=True)
class Thresholds:
    """Body and shadow thresholds of the factor block."""
    small_body: float = 0.003
    large_body: float = 0.015
    lower: float = 1.5
    upper: float = 0.5
    marubozu: float = 0.003


FACTOR = Thresholds()
DETECTION = Thresholds(lower=2.0, marubozu=0.002)

# Pattern, score, kind, reliability.
PATTERNS = [
    ("white_candle", 2, "bullish", 40),
    ("black_candle", 2, "bearish", 40),
    ("doji", 10, "indecision", 60),
    ("hammer", 20, "bullish_reversal", 75),
    ("hanging_man", 20, "bearish_reversal", 70),
    ("shooting_star", 35, "bearish_reversal", 70),
    ("inverted_hammer", 15, "bullish_reversal", 65),
    ("marubozu", 15, "trend", 65),
    ("spinning_top", 8, "indecision", 50),
    ("bullish_engulfing", 25, "bullish_reversal", 78),
    ("bearish_engulfing", 25, "bearish_reversal", 78),
    ("piercing_line", 25, "bullish_reversal", 75),
    ("dark_cloud_cover", 25, "bearish_reversal", 75),
    ("morning_star", 25, "bullish_reversal", 68),
    ("evening_star", 25, "bearish_reversal", 68),
    ("three_white_soldiers", 30, "bullish_reversal", 78),
    ("three_black_crows", 30, "bearish_reversal", 78),
    ("harami", 15, "reversal", 60),
]

# Signals with and without a direction.
DIRECTIONAL = ["hammer", "inverted_hammer", "bullish_engulfing", "piercing_line", "morning_star", "three_white_soldiers",
               "shooting_star", "hanging_man", "bearish_engulfing", "dark_cloud_cover", "evening_star",
               "three_black_crows"]
UNDECIDED = ["doji", "spinning_top"]


def shape(df: DataFrame) -> DataFrame:
    """Body, shadows, range and the two previous bars."""
    op, hi, low, cl = F.col("open"), F.col("high"), F.col("low"), F.col("close")
    return df.withColumns({
        "_body": F.abs(cl - op), "_ls": F.least(op, cl) - low, "_us": hi - F.greatest(op, cl),
        "_range": F.when(hi == low, F.lit(1.0)).otherwise(hi - low),
        "_safe": F.greatest(F.abs(cl - op), cl * 0.001), "_white": cl > op, "_black": op > cl,
        "_o1": lag("open"), "_c1": lag("close"), "_o2": lag("open", 2), "_c2": lag("close", 2)})


def context_lines(n: int = 20) -> dict[str, Column]:
    return {"range_low": rmin("low", n), "range_high": rmax("high", n), "_ms": sma("close", n // 2), "_ml": sma("close", n)}


def context_cols(n: int = 20) -> dict[str, Column]:
    """All that :func:`context_flags` needs, for one pass."""
    lines = context_lines(n)
    return {**lines, "_prev_high": lag(lines["range_high"]), "_prev_low": lag(lines["range_low"])}


def context(df: DataFrame, n: int = 20) -> DataFrame:
    """Position in the n-row range, trend side, sideways flag."""
    return context_flags(df.withColumns(context_lines(n)).withColumns({"_prev_high": lag("range_high"), "_prev_low": lag("range_low")}))


def context_flags(df: DataFrame) -> DataFrame:
    width = F.col("range_high") - F.col("range_low")
    cl, ms, ml = F.col("close"), F.col("_ms"), F.col("_ml")
    rel = div(width, F.when(F.col("range_low") == 0, F.lit(1.0)).otherwise(F.col("range_low")))
    near = F.abs(div(cl, ml) - 1) < 0.02
    no = F.lit(False)
    return df.withColumns({
        "price_pos": div(cl - F.col("range_low"), F.when(width == 0, F.lit(1e-6)).otherwise(width)),
        "is_uptrend": F.coalesce((cl > ms) & (ms > ml), no),
        "is_downtrend": F.coalesce((cl < ms) & (ms < ml), no),
        "is_sideways": F.coalesce(rel < 0.07, no) | F.coalesce((rel < 0.12) & near, no)})


def signals(t: Thresholds = FACTOR, crowd_context: bool = True) -> dict[str, Column]:
    """Pattern name -> 0/1 column over a frame with shape and context columns."""
    op, cl, pos = F.col("open"), F.col("close"), F.col("price_pos")
    up, down, flat = F.col("is_uptrend"), F.col("is_downtrend"), F.col("is_sideways")
    white, black = F.col("_white"), F.col("_black")
    o1, c1, o2, c2 = F.col("_o1"), F.col("_c1"), F.col("_o2"), F.col("_c2")
    body, ls, us, safe = F.col("_body"), F.col("_ls"), F.col("_us"), F.col("_safe")
    long_lower = (ls > safe * t.lower) & (us < safe * t.upper)
    long_upper = (us > safe * t.lower) & (ls < safe * t.upper)
    mid1, mid2 = (o1 + c1) / 2, (o2 + c2) / 2
    broke_up, broke_down = cl > F.col("_prev_high"), cl < F.col("_prev_low")
    plain = (ls < cl * t.marubozu) & (us < cl * t.marubozu) & (body > cl * t.large_body)
    soldiers = white & (c1 > o1) & (c2 > o2) & (c1 > c2) & (cl > c1)
    crows = black & (o1 > c1) & (o2 > c2) & (c1 < c2) & (cl < c1)
    if crowd_context:
        soldiers, crows = soldiers & (down | (pos < 0.3)), crows & (up | (pos > 0.7))
    small_second = F.abs(c1 - o1) < F.abs(c2 - o2) * 0.5
    inside = (F.greatest(op, cl) < F.greatest(o1, c1)) & (F.least(op, cl) > F.least(o1, c1))
    out = {
        "white_candle": white, "black_candle": black, "doji": body < cl * t.small_body,
        "hammer": long_lower & (pos < 0.3) & ~flat,
        "hanging_man": long_lower & (pos > 0.75) & up,
        "shooting_star": long_upper & (pos > 0.75) & up,
        "inverted_hammer": long_upper & (pos < 0.25) & down,
        "marubozu": plain & (~flat | F.coalesce(broke_up, F.lit(False)) | F.coalesce(broke_down, F.lit(False))),
        "spinning_top": (body / F.col("_range") < 0.1) & (F.abs(ls - us) / F.col("_range") < 0.3),
        "bullish_engulfing": (o1 > c1) & white & (cl > o1 * 1.002) & (op < c1)
        & (((pos < 0.4) & ~flat) | (flat & broke_up)),
        "bearish_engulfing": (c1 > o1) & black & (cl < o1 * 0.998) & (op > c1)
        & (((pos > 0.6) & ~flat) | (flat & broke_down)),
        "piercing_line": (o1 > c1) & white & (cl > mid1) & (cl < o1),
        "dark_cloud_cover": (c1 > o1) & black & (cl < mid1) & (cl > o1),
        "morning_star": (o2 > c2) & small_second & white & (cl > mid2) & (pos < 0.3),
        "evening_star": (c2 > o2) & small_second & black & (cl < mid2) & (pos > 0.7),
        "harami": (F.abs(c1 - o1) > body * 2) & inside,
        "three_white_soldiers": soldiers, "three_black_crows": crows,
    }
    return {k: flag(v) for k, v in out.items()}


def with_shape(df: DataFrame) -> DataFrame:
    return context(shape(df))


def ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({"body_ratio": F.col("_body") / F.col("_range"), "upper_shadow_ratio": F.col("_us") / F.col("_range"),
                           "lower_shadow_ratio": F.col("_ls") / F.col("_range")})


def strength_cols(n: int = 5) -> dict[str, Column]:
    w, k = F.col("_white").cast("double"), F.col("_black").cast("double")
    return {"pattern_strength": zero(F.greatest(rsum(w, n), rsum(k, n)) / n)}


def strength(df: DataFrame, n: int = 5) -> DataFrame:
    return df.withColumns(strength_cols(n))


def confirmation(df: DataFrame, n: int = 3) -> DataFrame:
    """Share of the next n-1 bars with the same direction. Looks ahead: label side only."""
    df = df.withColumn("_dir", F.when(F.col("_white"), 1).otherwise(-1))
    hits = sum((F.coalesce(lead("_dir", i) == F.col("_dir"), F.lit(False)).cast("double") for i in range(1, n)), F.lit(0.0))
    return df.withColumn("pattern_confirmation", hits / (n - 1))


CANDLE_FACTORS = [p[0] for p in PATTERNS] + ["body_ratio", "upper_shadow_ratio", "lower_shadow_ratio", "pattern_strength"]
LABEL_SIDE = ["pattern_confirmation"]


def candle_block(df: DataFrame, t: Thresholds = FACTOR) -> DataFrame:
    return confirmation(strength(ratios(with_shape(df).withColumns(signals(t)))))


def pattern_dim(spark: SparkSession) -> DataFrame:
    """The fixed pattern table (one row per pattern)."""
    return spark.createDataFrame(PATTERNS, "pattern string, score int, kind string, reliability int")


def detections(df: DataFrame, last_n: int, names: list[str]) -> DataFrame:
    """Long form: one row per (code, date, pattern) that fired in the last n bars of each instrument."""
    fired = with_shape(df).withColumns(signals(DETECTION, crowd_context=False))
    fired = fired.withColumn("_back", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("date"))))
    fired = fired.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("code")))
    meta = {p[0]: p for p in PATTERNS}
    hits = F.array(*[F.when(F.col(n) > 0, F.struct(
        F.lit(n).alias("pattern"), F.lit(meta[n][1]).alias("score"), F.lit(meta[n][2]).alias("kind"),
        F.lit(meta[n][3]).alias("reliability"))) for n in names])
    return (fired.where((F.col("_back") <= last_n) & (F.col("_n") >= 3))
            .select("code", "date", F.inline(F.array_compact(hits))))


def side(kind: str = "kind") -> Column:
    k = F.col(kind)
    return (F.when(k.contains("bullish"), "bullish").when(k.contains("bearish"), "bearish")
            .when(k == "indecision", "neutral"))


def last_bar_patterns(df: DataFrame) -> DataFrame:
    return detections(df, 1, DIRECTIONAL + UNDECIDED).withColumn("side", side())


def pattern_history(df: DataFrame, n: int = 90) -> DataFrame:
    return detections(df, n, DIRECTIONAL).withColumn("side", side())


def pattern_scores(df: DataFrame) -> DataFrame:
    """Bullish and bearish score per instrument on its last bar (0 where nothing fired)."""
    hit = last_bar_patterns(df).groupBy("code").agg(
        F.sum(F.when(F.col("side") == "bullish", F.col("score")).otherwise(0)).alias("bull"),
        F.sum(F.when(F.col("side") == "bearish", F.col("score")).otherwise(0)).alias("bear"))
    return df.select("code").distinct().join(hit, "code", "left").select(
        "code", F.coalesce("bull", F.lit(0)).cast("long").alias("bullish_score"),
        F.coalesce("bear", F.lit(0)).cast("long").alias("bearish_score"))
