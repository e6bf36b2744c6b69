"""Point-in-time fundamentals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.trailing import one_pass
from quantweave.functions.windows import lag, rstd, sma
from quantweave.operators.scans import latest_close

RAW = ["roeAvg", "netProfit", "epsTTM", "totalShare", "YOYPNI", "assetToEquity", "liabilityToAsset", "dupontROE"]


def announced(stat: str = "stat_date", pub: str = "pub_date") -> Column:
    """Publication date, else a fixed calendar day by statement quarter, else 30 days later."""
    s = F.col(stat)
    y, m = F.year(s), F.month(s)
    guess = (F.when(m == 3, F.make_date(y, F.lit(4), F.lit(25))).when(m == 6, F.make_date(y, F.lit(8), F.lit(25)))
             .when(m == 9, F.make_date(y, F.lit(10), F.lit(25))).when(m == 12, F.make_date(y + 1, F.lit(4), F.lit(20)))
             .otherwise(F.date_add(s, 30)))
    return F.coalesce(F.col(pub), guess)


def one_per_period(df: DataFrame) -> DataFrame:
    """Latest publication per (code, stat_date), so that restatements do not multiply the join."""
    rest = [c for c in df.columns if c not in ("code", "stat_date")]
    order = F.struct(F.coalesce("pub_date", F.lit(dt.date(1900, 1, 1))), *[F.col(c) for c in rest if c != "pub_date"])
    return df.groupBy("code", "stat_date").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("code", "stat_date", "_r.*")


def statements(profit: DataFrame, growth: DataFrame, balance: DataFrame, dupont: DataFrame) -> DataFrame:
    """Profit left-joined with the other three statements on (code, stat_date)."""
    df = one_per_period(profit)
    for side in (growth, balance, dupont):
        df = df.join(one_per_period(side).drop("pub_date"), ["code", "stat_date"], "left")
    return df.withColumn("announced_date", announced()).where(F.col("announced_date").isNotNull())


def as_of_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, cols: Sequence[str],
               tie: Sequence[str] = ()) -> DataFrame:
    """For each left row the last right row of the same code with right_time <= left_time.

    Union plus last-not-null over one sort: linear in both sides, no range
    join. Right rows sort before left rows on equal times.
    """
    payload = F.struct(*[F.col(c) for c in cols])
    kept = [c for c in left.columns if c != "code"]
    r = right.select("code", F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
                     *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)], payload.alias("_r"))
    l = left.select("code", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_l"))
    w = (Window.partitionBy("code").orderBy("_t", "_side", *[f"_tie{i}" for i in range(len(tie))])
         .rowsBetween(Window.unboundedPreceding, 0))
    both = r.unionByName(l, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    return both.where(F.col("_side") == 1).select("code", "_l.*", *[F.col(f"_m.{c}").alias(c) for c in cols])


def pit_series(bars: DataFrame, reports: DataFrame, cols: Sequence[str] = RAW) -> DataFrame:
    return as_of_join(bars, reports, "date", "announced_date", ["stat_date", *cols], ["stat_date"])


def pit_snapshot(reports: DataFrame, as_of: dt.date | None) -> DataFrame:
    if as_of:
        reports = reports.where(F.col("announced_date") <= F.lit(as_of))
    rest = [c for c in reports.columns if c != "code"]
    order = F.struct("announced_date", "stat_date")
    return reports.groupBy("code").agg(F.max_by(F.struct(*rest), order).alias("_r")).select("code", "_r.*")


def latest_published(profit: DataFrame, balance: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Every statement published on each code's latest publication day, with its balance row."""
    p = profit.where(F.col("pub_date").isNotNull())
    if as_of:
        p = p.where(F.col("pub_date") <= F.lit(as_of))
    w = Window.partitionBy("code").orderBy(F.desc("pub_date"))
    p = p.withColumn("_k", F.rank().over(w)).where(F.col("_k") == 1).drop("_k")
    return p.join(balance.select("code", "stat_date", "liabilityToAsset"), ["code", "stat_date"], "left")


def info_map(bars: DataFrame, profit: DataFrame, balance: DataFrame, names: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Price, valuation and names per instrument. PE only for positive earnings; cap in units of 1e8."""
    price = latest_close(bars, as_of).select("code", F.col("close").alias("current_price"))
    st = bars if as_of is None else bars.where(F.col("date") <= F.lit(as_of))
    flag = st.groupBy("code").agg(F.max_by("is_st", "date").alias("is_st"))
    fin = latest_published(profit, balance, as_of).select(
        "code", "epsTTM", "totalShare", F.col("liabilityToAsset").alias("debt_ratio"))
    df = price.join(flag, "code", "left").join(fin, "code", "left").join(names.select("code", "code_name"), "code", "left")
    return df.withColumns({
        "pe_ratio": F.when(F.col("epsTTM") > 0, F.col("current_price") / F.col("epsTTM")),
        "market_cap": F.col("current_price") * F.col("totalShare") / 1e8, "has_info": F.lit(True)})


def finite(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def valuation(df: DataFrame) -> DataFrame:
    """Vendor ratios where present, else from the statements; inverses and market cap."""
    pe = F.try_divide("close", "epsTTM")
    if "peTTM" in df.columns:
        pe = F.coalesce("peTTM", pe)
    df = df.withColumns({"dynamic_pe": pe, "dynamic_pb": F.col("pbMRQ") if "pbMRQ" in df.columns else F.lit(None).cast("double")})
    return df.withColumns({"inv_pe": F.try_divide(F.lit(1.0), "dynamic_pe"), "inv_pb": F.try_divide(F.lit(1.0), "dynamic_pb"),
                           "market_cap": F.col("close") * F.col("totalShare") / 1e8})


def quality(df: DataFrame) -> DataFrame:
    growth = F.greatest(F.least(F.col("YOYPNI") / 100, F.lit(10.0)), F.lit(-10.0))
    return df.withColumns({
        "roe_x_np_growth": F.when(F.col("YOYPNI").isNotNull(), F.col("roeAvg") * growth),
        "roe_to_pb": F.when(F.col("dynamic_pb") > 0, F.col("roeAvg") / F.col("dynamic_pb"))})


def peg(df: DataFrame) -> DataFrame:
    return df.withColumn("peg", F.when((F.col("dynamic_pe") > 0) & (F.col("YOYPNI") > 0), F.col("dynamic_pe") / F.col("YOYPNI")))


def trend_cols(n: int = 250, k: int = 20) -> dict[str, Column]:
    return {"sue": F.try_divide(F.col("YOYPNI") - sma("YOYPNI", n), rstd("YOYPNI", n)), "eav": F.col("YOYPNI") - lag("YOYPNI", k)}


def surprise(df: DataFrame, n: int = 250) -> DataFrame:
    return df.withColumn("sue", trend_cols(n)["sue"])


def acceleration(df: DataFrame, k: int = 20) -> DataFrame:
    return df.withColumn("eav", trend_cols(k=k)["eav"])


DERIVED = ["dynamic_pe", "dynamic_pb", "inv_pe", "inv_pb", "market_cap", "roe_x_np_growth", "roe_to_pb", "peg", "sue", "eav"]
FUNDAMENTAL_FACTORS = RAW + DERIVED


def fundamental_lines(bars: DataFrame, reports: DataFrame) -> DataFrame:
    return peg(quality(valuation(pit_series(bars, reports))))


def fundamental_block(bars: DataFrame, reports: DataFrame) -> DataFrame:
    with one_pass() as p:
        columns = trend_cols()
    return p.on(fundamental_lines(bars, reports), columns)


def snapshot_with_price(reports: DataFrame, prices: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    df = pit_snapshot(reports, as_of).join(prices.select("code", "close"), "code", "left")
    ok = (F.col("close") > 0) & (F.col("epsTTM") > 0)
    df = df.withColumns({"dynamic_pe": F.when(ok, F.col("close") / F.col("epsTTM")),
                         "inv_pe": F.when(ok, F.col("epsTTM") / F.col("close"))})
    return peg(df)


def statement_history(reports: DataFrame, n: int = 12) -> DataFrame:
    """Last n periods per instrument, newest first; ``slot`` 1 is current, 2 previous."""
    w = Window.partitionBy("code").orderBy(F.desc("stat_date"))
    return reports.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= n)


def history_lists(reports: DataFrame, n: int = 12) -> DataFrame:
    """One row per instrument: the last n periods as a list (bounded by n), current and previous EPS."""
    h = statement_history(reports, n).groupBy("code").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("slot")).alias("k"), "stat_date", "epsTTM"))).alias("history"))
    last = F.element_at("history", -1)
    prev = F.when(F.size("history") > 1, F.element_at("history", F.when(F.size("history") > 1, -2).otherwise(-1)))
    return h.select("code", F.size("history").alias("periods"), last["stat_date"].alias("report_date"),
                    last["epsTTM"].alias("current_eps"), prev["epsTTM"].alias("previous_eps"))


def valuation_now(bars: DataFrame, reports: DataFrame) -> DataFrame:
    cur = statement_history(reports, 1).select("code", "epsTTM")
    return latest_close(bars).join(cur, "code", "left").withColumn(
        "pe", F.when(F.col("epsTTM") > 0, F.col("close") / F.col("epsTTM")))
