"""Rolling statistics and risk measures over bars that went through ``technical.base``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantweave.functions.trailing import ASKED, one_pass
from quantweave.functions.windows import div, guarded, lag, rmax, rmin, rstd, rsum, running, sma, trailing
from quantweave.operators.technical import zero

ANNUAL = 252


def range_cols() -> dict[str, Column]:
    hl = div(F.col("high") - F.col("low"), "close")
    return {"hl_range_mean": sma(hl, 20), "hl_range_std": rstd(hl, 20)}


def range_stats(df: DataFrame) -> DataFrame:
    return df.withColumns(range_cols())


def open_close_cols() -> dict[str, Column]:
    oc = div(F.col("close") - F.col("open"), "open")
    return {"oc_ratio_mean": sma(oc, 20), "oc_ratio_std": rstd(oc, 20)}


def open_close_stats(df: DataFrame) -> DataFrame:
    return df.withColumns(open_close_cols())


def volatility_cols() -> dict[str, Column]:
    return {"price_volatility_20": rstd("_ret", 20), "price_volatility_60": rstd("_ret", 60)}


def volatility(df: DataFrame) -> DataFrame:
    return df.withColumns(volatility_cols())


def sample_skew(x: str, n: int) -> Column:
    """Bias-corrected skewness from the population moment."""
    k = (n * (n - 1)) ** 0.5 / (n - 2)
    return guarded(F.skewness, x, n) * k


def sample_kurt(x: str, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    return (guarded(F.kurtosis, x, n) * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def moment_cols(n: int, skew: str, kurt: str) -> dict[str, Column]:
    return {skew: sample_skew("_ret", n), kurt: sample_kurt("_ret", n)}


def moments(df: DataFrame, n: int, skew: str, kurt: str) -> DataFrame:
    return df.withColumns(moment_cols(n, skew, kurt))


def position_cols() -> dict[str, Column]:
    lo, hi = rmin("low", 20), rmax("high", 20)
    return {"high_position": div(F.col("high") - lo, hi - lo), "low_position": div(F.col("close") - lo, hi - lo)}


def range_position(df: DataFrame) -> DataFrame:
    return df.withColumns(position_cols())


def volume_cols() -> dict[str, Column]:
    return {"volume_change_rate": div("volume", sma("volume", 20)), "volume_volatility": rstd("_vret", 20)}


def volume_change(df: DataFrame) -> DataFrame:
    return df.withColumn("volume_change_rate", volume_cols()["volume_change_rate"])


def volume_volatility(df: DataFrame) -> DataFrame:
    return df.withColumn("volume_volatility", volume_cols()["volume_volatility"])


def corr_cols(n: int = 20) -> dict[str, Column]:
    # The frame covers rows where both are present, else the value is null: deviations of either column are those of the pairs.
    if ASKED.get():
        return {"price_volume_corr": div(ASKED.get().add("covar_samp", n, "_ret", "_vret"), rstd("_ret", n) * rstd("_vret", n))}
    both = F.col("_ret").isNotNull() & F.col("_vret").isNotNull()
    full = F.count(F.when(both, 1)).over(trailing(n)) == n
    cov = F.covar_samp("_ret", "_vret").over(trailing(n))
    return {"price_volume_corr": F.when(full, div(cov, rstd("_ret", n) * rstd("_vret", n)))}


def price_volume_corr(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumns(corr_cols(n))


def amount_cols() -> dict[str, Column]:
    return {"amount_per_volume": div(sma("amount", 20), sma("volume", 20)), "amount_change_rate": div("amount", sma("amount", 20))}


def amount_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(amount_cols())


def return_cols(ks=(5, 10, 20, 60)) -> dict[str, Column]:
    return {f"return_{k}d": div("close", lag("close", k)) - 1 for k in ks}


def returns_k(df: DataFrame, ks=(5, 10, 20, 60)) -> DataFrame:
    return df.withColumns(return_cols(ks))


def momentum_sums(df: DataFrame) -> DataFrame:
    df = df.withColumns({f"momentum_{k}d": rsum("_ret", k) for k in (5, 10, 20)})
    return df.withColumn("acceleration", F.col("momentum_10d") - lag("momentum_20d", 10))


def downside_risk(df: DataFrame, min_periods: int | None = None) -> DataFrame:
    """Needs 20 non-positive returns in a row; ``min_periods`` gives the usual form."""
    neg = F.when(F.col("_ret") <= 0, F.col("_ret"))
    need = min_periods or 20
    value = F.when(F.count(neg).over(trailing(20)) >= need, F.stddev_samp(neg).over(trailing(20)))
    return df.withColumn("downside_risk" if min_periods is None else "downside_risk_partial", value)


def drawdown(df: DataFrame) -> DataFrame:
    """Compounded returns over their running maximum equal close over running maximum close."""
    return drawdown_line(df).withColumn("max_drawdown_20", rmin("drawdown", 20))


def drawdown_line(df: DataFrame) -> DataFrame:
    return df.withColumn("drawdown", div("close", running(F.max, "close")) - 1)


def sharpe_cols() -> dict[str, Column]:
    return {"sharpe_ratio": div(sma("_ret", 20), rstd("_ret", 20)) * ANNUAL ** 0.5}


def rolling_sharpe(df: DataFrame) -> DataFrame:
    return df.withColumns(sharpe_cols())


ROLLING_FACTORS = [
    "hl_range_mean", "hl_range_std", "oc_ratio_mean", "oc_ratio_std", "price_volatility_20", "price_volatility_60",
    "price_skewness", "price_kurtosis", "high_position", "low_position", "volume_change_rate", "volume_volatility",
    "price_volume_corr", "amount_per_volume", "amount_change_rate", "return_5d", "return_10d", "return_20d",
    "return_60d", "momentum_5d", "momentum_10d", "momentum_20d", "acceleration", "downside_risk", "drawdown",
    "max_drawdown_20", "sharpe_ratio", "return_skewness", "return_kurtosis"]


def clean(df: DataFrame, cols=ROLLING_FACTORS) -> DataFrame:
    """Infinite, NaN and missing values become 0."""
    inf = F.lit(float("inf"))
    return df.withColumns({c: zero(F.when(F.isnan(c) | (F.abs(F.col(c)) == inf), F.lit(None)).otherwise(F.col(c)))
                           for c in cols})


def rolling_cols() -> dict[str, Column]:
    """The rolling statistics, for one pass over bars with a :func:`drawdown_line`."""
    sums = {k: rsum("_ret", k) for k in (5, 10, 20)}
    return {**range_cols(), **open_close_cols(), **volatility_cols(), **position_cols(), **volume_cols(), **amount_cols(),
            **moment_cols(20, "price_skewness", "price_kurtosis"), **moment_cols(60, "return_skewness", "return_kurtosis"),
            **corr_cols(), **return_cols(), **{f"momentum_{k}d": c for k, c in sums.items()}, "acceleration": sums[10] - lag(sums[20], 10),
            "downside_risk": rstd(F.when(F.col("_ret") <= 0, F.col("_ret")), 20), "max_drawdown_20": rmin("drawdown", 20), **sharpe_cols()}


def rolling_block(df: DataFrame) -> DataFrame:
    with one_pass() as p:
        columns = rolling_cols()
    return clean(p.on(drawdown_line(df), columns))
