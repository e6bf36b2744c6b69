"""Cross-sectional screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.windows import rmax, rmin
from quantweave.operators import adjust, labels
from quantweave.operators import rolling as r
from quantweave.operators import technical as t

FLAGSHIP = ["mtm", "bias", "ma_ratio", "willr", "vol_ma", "low_position"]


def top_per_date(df: DataFrame, score: str, n: int, keys=("date",)) -> DataFrame:
    """Best n rows per date; Spark limits each group before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), "code")
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def equal_weight(df: DataFrame, features) -> DataFrame:
    return df.withColumn("score", reduce(lambda a, b: a + b, [F.col(f) for f in features]) / len(features))


def flagship(m, n: int = 5) -> DataFrame:
    """Adjusted bars -> window factors -> rank per date -> equal-weight score -> top n per date."""
    bars = adjust.to_sample_end(m.bars(), m.adjust_factor())
    df = t.willr(t.bias(t.mtm(bars)))
    df = r.range_position(t.ma_pair(t.ma_ratio(df), "volume", 5, "vol_ma"))
    df = df.select("code", "date", *[F.round(t.zero(F.col(f)), 6).alias(f) for f in FLAGSHIP])
    return top_per_date(equal_weight(labels.cross_rank(df, FLAGSHIP), FLAGSHIP), "score", n)


def pit_info(bars: DataFrame, profit: DataFrame, balance: DataFrame) -> DataFrame:
    """Price, valuation and debt of every bar from the statement published last before it."""
    from quantweave.operators.fundamentals import as_of_join
    fin = profit.where(F.col("pub_date").isNotNull()).join(
        balance.select("code", "stat_date", "liabilityToAsset"), ["code", "stat_date"], "left")
    df = as_of_join(bars.select("code", "date", "close", "is_st"), fin, "date", "pub_date", ["epsTTM", "totalShare", "liabilityToAsset"], ["stat_date"])
    return df.select("code", "date", F.col("close").alias("current_price"), "is_st", F.col("liabilityToAsset").alias("debt_ratio"),
                     F.when(F.col("epsTTM") > 0, F.col("close") / F.col("epsTTM")).alias("pe_ratio"),
                     (F.col("close") * F.col("totalShare") / 1e8).alias("market_cap"), F.lit(True).alias("has_info"),
                     F.lit(None).cast("string").alias("code_name"))


def model_signals(factors: DataFrame, info: DataFrame, levels: DataFrame, model, features, criteria, n: int = 5,
                  min_confidence: float = 0.0, stop_mult: float = 1.0, target_mult: float = 4.0) -> DataFrame:
    """Funnel -> rank per date among the passing -> model score -> top n per date -> ATR exits.

    ``levels`` carries ``atr`` per (code, date). All dates run in one plan.
    """
    from quantweave.operators.filters import confident, funnel
    from quantweave.plans.training import coded, predict
    passed = funnel(info, criteria, cap_gate=False).where(F.col("reject_reason").isNull()).select(
        "code", "date", "current_price", F.col("pe_ratio").alias("_pe"), F.col("market_cap").alias("_cap"))
    df = factors.select("code", "date", *features).join(passed, ["code", "date"])
    df = predict(model, coded(labels.cross_rank(df, features, null_rank=0.5, plus_one=False, sizes=info), features), chosen=features, features=features)
    df = confident(df, min_confidence, ranking=True)
    df = df.withColumn("score", F.col("prob") * 100 + labels.tie_breaker())
    top = top_per_date(df, "score", n).join(levels, ["code", "date"], "left")
    atr = F.when(F.col("atr") > 0, F.col("atr"))
    return top.select("date", "code", "place", (F.col("prob") * 100).alias("confidence"), "current_price", F.col("_pe").alias("pe_ratio"), F.col("_cap").alias("market_cap"),
                      F.when(F.col("prob") > 0.5, "buy").otherwise("hold").alias("signal"),
                      (F.col("current_price") - stop_mult * atr).alias("stop_loss"), (F.col("current_price") + target_mult * atr).alias("take_profit"))
