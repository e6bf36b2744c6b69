"""Window-expressible technical indicators.

Every function takes bars that went through :func:`base` and adds columns.
All windows share ``partitionBy(code).orderBy(date)``, so Spark plans one
exchange and one sort for any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.trailing import ASKED, PLACE, filled, one_pass
from quantweave.functions.windows import (by_code, div, ffill, lag, rmax, rmin, rstd, rstd_pop, rsum, running,
                                          rvar, sma, trailing)
from quantweave.functions.periods import PERIODS

def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def base(df: DataFrame) -> DataFrame:
    """Per-row helpers (``_``-prefixed) that most indicators share."""
    one = df.withColumns({
        "_i": F.row_number().over(by_code()), "_pc": lag("close"), "_pv": lag("volume"),
        "_tp": (F.col("high") + F.col("low") + F.col("close")) / 3})
    return one.withColumns({
        "_d": F.col("close") - F.col("_pc"), "_ret": div("close", "_pc") - 1, "_vret": div("volume", "_pv") - 1,
        "_ptp": lag("_tp"),
        "_tr": F.when(F.col("_pc").isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc")), F.abs(F.col("low") - F.col("_pc"))))})


def roc_cols(n: int = PERIODS["roc"], x: str = "close", out: str = "roc") -> dict[str, Column]:
    prev = lag(x, n)
    return {out: F.when(prev == 0, F.lit(0.0)).otherwise((div(x, prev) - 1) * 100)}


def roc(df: DataFrame, n: int = PERIODS["roc"], x: str = "close", out: str = "roc") -> DataFrame:
    return df.withColumns(roc_cols(n, x, out))


def mtm_cols(n: int = PERIODS["mtm"]) -> dict[str, Column]:
    return {"mtm": zero(F.col("close") - lag("close", n))}


def mtm(df: DataFrame, n: int = PERIODS["mtm"]) -> DataFrame:
    return df.withColumns(mtm_cols(n))


def rvi_cols(n: int = PERIODS["rvi"], min_periods: int | None = None) -> dict[str, Column]:
    spread = F.col("high") - F.col("low")
    up, down = F.when(F.col("_d") > 0, spread), F.when(F.col("_d") < 0, spread)

    def sd(x):
        if min_periods is None:
            return rstd(x, n)
        return F.when(F.count(x).over(trailing(n)) >= min_periods, F.stddev_samp(x).over(trailing(n)))
    value = div(100 * sd(up), sd(up) + sd(down))
    return {"rvi" if min_periods is None else "rvi_partial": F.coalesce(value, F.lit(50.0))}


def rvi(df: DataFrame, n: int = PERIODS["rvi"], min_periods: int | None = None) -> DataFrame:
    """With the full-window guard both deviations are never present together
    and the value is constant 50; ``min_periods=2`` gives the textbook index."""
    return df.withColumns(rvi_cols(n, min_periods))


def ulcer(df: DataFrame, n: int = PERIODS["ulcer"]) -> DataFrame:
    top = df.withColumn("_top", rmax("close", n))
    sq = top.withColumn("_sq", F.pow(div(F.col("close") - F.col("_top"), "_top"), 2))
    return sq.withColumn("ulcer", zero(F.sqrt(sma("_sq", n))))


def aroon(df: DataFrame, n: int = PERIODS["aroon"]) -> DataFrame:
    f = trailing(n + 1)
    full = F.count(F.lit(1)).over(f) == n + 1
    hi = F.max(F.struct("high", "_i")).over(f)["_i"]
    lo = F.min(F.struct(F.col("low"), (-F.col("_i")).alias("neg"))).over(f)["neg"]
    return df.withColumns({
        "aroon_up": F.when(full, 100.0 * (n - (F.col("_i") - hi)) / n),
        "aroon_down": F.when(full, 100.0 * (n - (F.col("_i") + lo)) / n)})


def ma_ratio_cols(n: int = PERIODS["ma_ratio"]) -> dict[str, Column]:
    return {"ma_ratio": F.when(F.col("close") == 0, F.lit(1.0)).otherwise(div(sma("close", n), "close"))}


def ma_ratio(df: DataFrame, n: int = PERIODS["ma_ratio"]) -> DataFrame:
    return df.withColumns(ma_ratio_cols(n))


def slope(x: str | Column, n: int) -> Column:
    """Least-squares slope per row step over a full window."""
    if ASKED.get():
        return ASKED.get().add("slope", n, x)
    return F.when(F.count(x).over(trailing(n)) == n, F.regr_slope(F.col(x), F.col("_i")).over(trailing(n)))


def ma_slope(df: DataFrame, n: int = PERIODS["ma_slope"]) -> DataFrame:
    return df.withColumn("_ma", sma("close", n)).withColumn("ma_slope", zero(slope("_ma", n)))


def price_slope(df: DataFrame, n: int = 20) -> DataFrame:
    return df.withColumn("price_slope", zero(slope("close", n)))


def bollinger_cols(n: int = PERIODS["bb"], k: float = PERIODS["bb_std"]) -> dict[str, Column]:
    mid, sd = sma("close", n), rstd_pop("close", n)
    lower, width = mid - k * sd, 2 * k * sd
    return {"bb_width": zero(div(width, mid)),
                           "bb_position": F.coalesce(div(F.col("close") - lower, width), F.lit(0.5))}


def bollinger(df: DataFrame, n: int = PERIODS["bb"], k: float = PERIODS["bb_std"]) -> DataFrame:
    return df.withColumns(bollinger_cols(n, k))


def cci(df: DataFrame, n: int = PERIODS["cci"]) -> DataFrame:
    tps = F.collect_list("_tp").over(trailing(n))
    df = df.withColumns({"_tps": tps, "_tpm": sma("_tp", n)})
    dev = F.aggregate("_tps", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tpm"))) / n
    gap = F.col("_tp") - F.col("_tpm")
    return df.withColumn("cci", F.when(F.col("_tpm").isNotNull(), zero(div(gap, 0.015 * dev)))).drop("_tps")


def price_var(df: DataFrame, n: int = PERIODS["price_var"]) -> DataFrame:
    return df.withColumn("_ret0", zero(F.col("_ret"))).withColumn("price_var", zero(rvar("_ret0", n)))


def _relative(line: str, out: str) -> dict[str, Column]:
    """Cumulative line minus its 20-row mean, in units of mean volume."""
    return {out: zero(div(F.col(line) - sma(line, 20), sma("volume", 20)))}


def obv(df: DataFrame) -> DataFrame:
    return obv_line(df).withColumns(_relative("_obv", "obv"))


def obv_line(df: DataFrame) -> DataFrame:
    signed = F.when(F.col("_pc").isNull(), F.col("volume")).otherwise(F.signum("_d") * F.col("volume"))
    return df.withColumn("_sv", signed).withColumn("_obv", running(F.sum, "_sv"))


def ad_line(df: DataFrame) -> DataFrame:
    rng = F.col("high") - F.col("low")
    flow = zero(div((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), rng)) * F.col("volume")
    return df.withColumn("_flow", flow).withColumn("_ad", running(F.sum, "_flow"))


def ad(df: DataFrame) -> DataFrame:
    return ad_line(df).withColumns(_relative("_ad", "ad"))


def money_flow(df: DataFrame) -> DataFrame:
    money = F.col("_tp") * F.col("volume")
    return df.withColumns({
        "_up": F.when(F.col("_ptp").isNotNull(), F.when(F.col("_tp") > F.col("_ptp"), money).otherwise(0.0)),
        "_dn": F.when(F.col("_ptp").isNotNull(), F.when(F.col("_tp") < F.col("_ptp"), money).otherwise(0.0))})


def mfi_cols(n: int = PERIODS["mfi"]) -> dict[str, Column]:
    total = rsum("_up", n) + rsum("_dn", n)
    return {"mfi": F.when(total < 1, F.lit(0.0)).otherwise(100 * div(rsum("_up", n), total))}


def mfi(df: DataFrame, n: int = PERIODS["mfi"]) -> DataFrame:
    return money_flow(df).withColumns(mfi_cols(n))


def ma_pair_cols(x: str, n: int, out: str) -> dict[str, Column]:
    """SMA(n) over SMA(5n); 1 where the base is 0, 0 during warm-up."""
    slow = sma(x, 5 * n)
    return {out: zero(F.when(slow == 0, F.lit(1.0)).otherwise(div(sma(x, n), slow)))}


def ma_pair(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return df.withColumns(ma_pair_cols(x, n, out))


def std_ratio_cols(x: str, n: int, out: str) -> dict[str, Column]:
    return {out: zero(div(zero(rstd(x, n)), sma(x, n)))}


def std_ratio(df: DataFrame, x: str, n: int, out: str) -> DataFrame:
    return df.withColumns(std_ratio_cols(x, n, out))


def willr_cols(n: int = PERIODS["willr"]) -> dict[str, Column]:
    hi, lo = rmax("high", n), rmin("low", n)
    return {"willr": F.when(hi.isNotNull(), zero(-100 * div(hi - F.col("close"), hi - lo)))}


def willr(df: DataFrame, n: int = PERIODS["willr"]) -> DataFrame:
    return df.withColumns(willr_cols(n))


def bias_cols(n: int = PERIODS["bias"]) -> dict[str, Column]:
    ma = sma("close", n)
    return {"bias": zero(div(F.col("close") - ma, ma) * 100)}


def bias(df: DataFrame, n: int = PERIODS["bias"]) -> DataFrame:
    return df.withColumns(bias_cols(n))


def vr_cols(n: int = PERIODS["vr"]) -> dict[str, Column]:
    up = F.when(F.col("_d") > 0, F.col("volume")).otherwise(0.0)
    down = F.when(F.col("_d") < 0, F.col("volume")).otherwise(0.0)
    return {"vr": zero(div(rsum(up, n), rsum(down, n)))}


def vr(df: DataFrame, n: int = PERIODS["vr"]) -> DataFrame:
    return df.withColumns(vr_cols(n))


def psy_cols(n: int = PERIODS["psy"]) -> dict[str, Column]:
    up = F.when(F.col("_d") > 0, 1.0).otherwise(0.0)
    return {"psy": zero(rsum(up, n) / n * 100)}


def psy(df: DataFrame, n: int = PERIODS["psy"]) -> DataFrame:
    return df.withColumns(psy_cols(n))


def ar_br_cols(n: int = PERIODS["ar_br"]) -> dict[str, Column]:
    return {
        "ar": zero(div(rsum(F.col("high") - F.col("open"), n), rsum(F.col("open") - F.col("low"), n)) * 100),
        "br": zero(div(rsum(F.col("high") - F.col("_pc"), n), rsum(F.col("_pc") - F.col("low"), n)) * 100)}


def ar_br(df: DataFrame, n: int = PERIODS["ar_br"]) -> DataFrame:
    return df.withColumns(ar_br_cols(n))


def cr_cols(n: int = PERIODS["cr"]) -> dict[str, Column]:
    up = F.greatest(F.col("high") - F.col("_ptp"), F.lit(0.0))
    down = F.greatest(F.col("_ptp") - F.col("low"), F.lit(0.0))
    ok = F.col("_ptp").isNotNull()
    return {"cr": zero(div(rsum(F.when(ok, up), n), rsum(F.when(ok, down), n)) * 100)}


def cr(df: DataFrame, n: int = PERIODS["cr"]) -> DataFrame:
    return df.withColumns(cr_cols(n))


def simple_atr(df: DataFrame, n: int = PERIODS["atr"], out: str = "atr_simple") -> DataFrame:
    """Plain mean of the true range; needs n + 1 rows of history."""
    return df.withColumn(out, F.when(F.col("_i") > n, sma("_tr", n)))


def fill_block(df: DataFrame, cols: list[str]) -> DataFrame:
    """Forward fill, then zero fill; in a pass where rows are numbered."""
    if PLACE in df.columns:
        return filled(df, cols).withColumns({c: zero(F.col(c)) for c in cols})
    return df.withColumns({c: zero(ffill(c)) for c in cols})


def warm(df: DataFrame, rows: int = 60) -> DataFrame:
    """Drop instruments with fewer rows than the block needs."""
    return (df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("code")))
            .where(F.col("_n") >= rows).drop("_n"))


WINDOW_FACTORS = ["roc", "mtm", "rvi", "aroon_up", "aroon_down", "ma_ratio", "ma_slope", "bb_width", "bb_position",
                  "cci", "ulcer", "price_var", "obv", "ad", "mfi", "vr", "vroc", "vol_ma", "vol_std", "amount_ma",
                  "amount_std", "willr", "bias", "psy", "ar", "br", "cr"]


def window_lines(df: DataFrame) -> DataFrame:
    """The running lines and flows that :func:`window_cols` looks at."""
    return money_flow(ad_line(obv_line(df)))


def window_cols() -> dict[str, Column]:
    """All window-only indicators, for one pass."""
    p, asked = PERIODS, ASKED.get()
    n, ages = p["aroon"], [asked.add(op, p["aroon"] + 1, x) for op, x in (("age_max", "high"), ("age_min", "low"))]
    mid = sma("_tp", p["cci"])
    return {
        **roc_cols(), **mtm_cols(), **ma_ratio_cols(), **bollinger_cols(), **willr_cols(), **bias_cols(), **vr_cols(), **psy_cols(),
        **ar_br_cols(), **roc_cols(p["vroc"], "volume", "vroc"), **ma_pair_cols("volume", p["vol_ma"], "vol_ma"),
        **ma_pair_cols("amount", p["amt_ma"], "amount_ma"), **std_ratio_cols("volume", p["vol_std"], "vol_std"),
        **std_ratio_cols("amount", p["amt_std"], "amount_std"), **rvi_cols(), **mfi_cols(), **cr_cols(),
        "aroon_up": 100.0 * (n - ages[0]) / n, "aroon_down": 100.0 * (n - ages[1]) / n,
        "ma_slope": zero(slope(sma("close", p["ma_slope"]), p["ma_slope"])),
        "ulcer": zero(F.sqrt(sma(asked.add("fall_square", p["ulcer"], "close"), p["ulcer"]))),
        "cci": F.when(mid.isNotNull(), zero(div(F.col("_tp") - mid, 0.015 * asked.add("mean_abs_dev", p["cci"], "_tp")))),
        "price_var": zero(rvar(zero(F.col("_ret")), p["price_var"])),
        **_relative("_obv", "obv"), **_relative("_ad", "ad")}


def window_block(df: DataFrame) -> DataFrame:
    """All window-only indicators on bars that went through :func:`base`, in one pass."""
    with one_pass() as p:
        columns = window_cols()
    return p.on(window_lines(df), columns)
