"""Calendar, grid and reconcile joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweave.operators.scans import calendar


def next_session_bar(bars: DataFrame) -> DataFrame:
    """Each bar with the bar of the next market session (null if the instrument did not trade then)."""
    nxt = bars.select("code", F.col("date").alias("next_date"), F.col("open").alias("next_open"))
    return bars.join(calendar(bars).select("date", "next_date"), "date", "left").join(nxt, ["code", "next_date"], "left")


def attach_breadth(bars: DataFrame, breadth: DataFrame, cols) -> DataFrame:
    """Date-level measures on bars: forward fill per instrument, then 0. The measures are as long as the calendar and go to every task, so no bar is moved."""
    from quantweave.functions.windows import ffill
    df = bars.join(F.broadcast(breadth.select("date", *cols)), "date", "left")
    return df.withColumns({c: F.coalesce(ffill(c), F.lit(0.0)) for c in cols})


def lookup(bars: DataFrame, dim: DataFrame, col: str) -> DataFrame:
    one = dim.groupBy("code").agg(F.min(col).alias(col))
    return bars.join(one, "code", "left")


def missing_sessions(bars: DataFrame) -> DataFrame:
    """Sessions inside each instrument's own date range without a bar. The grid is
    expanded from session numbers, so no inequality join is needed."""
    cal = calendar(bars).select("date", "session")
    numbered = bars.select("code", "date").join(cal, "date")
    grid = numbered.groupBy("code").agg(F.min("session").alias("a"), F.max("session").alias("b")).select(
        "code", F.explode(F.sequence("a", "b")).alias("session"))
    return grid.join(numbered.select("code", "session"), ["code", "session"], "left_anti").join(cal, "session").select("code", "date")


def missing_dates(all_dates: DataFrame, done: DataFrame) -> DataFrame:
    return all_dates.select("date").distinct().join(done.select("date").distinct(), "date", "left_anti")


def quarter_grid(codes: DataFrame, first_year, last_year) -> DataFrame:
    """(code, quarter end) for every quarter between two year columns."""
    y = codes.select("code", F.explode(F.sequence(first_year, last_year)).alias("year"))
    return y.select("code", "year", F.explode(F.array(*[F.lit(q) for q in (1, 2, 3, 4)])).alias("quarter")).withColumn(
        "stat_date", F.last_day(F.make_date("year", F.col("quarter") * 3, F.lit(1))))


def missing_periods(grid: DataFrame, stored: DataFrame) -> DataFrame:
    return grid.join(stored.select("code", "stat_date").distinct(), ["code", "stat_date"], "left_anti")


def fetch_plan(instruments: DataFrame, stored: DataFrame, current_year: int, years: int, incremental: bool) -> DataFrame:
    """Quarters still to fetch: target years clipped to listing and delisting year, minus stored periods."""
    base = F.greatest(F.lit(current_year - years + 1), F.coalesce("ipo_year", F.lit(0)))
    end = F.least(F.lit(current_year - 1), F.coalesce("out_year", F.lit(9999)))
    df = instruments.withColumns({"_b": base, "_e": end})
    first = F.greatest(F.col("_b"), F.col("_e") - 1) if incremental else F.col("_b")
    df = df.withColumn("_f", first).where(F.col("_f") <= F.col("_e"))
    return missing_periods(quarter_grid(df, F.col("_f"), F.col("_e")), stored)


def reconcile(tracked: DataFrame, holdings: DataFrame) -> DataFrame:
    """Full outer join of tracked positions and broker holdings with a side flag."""
    t = tracked.select("code", F.col("quantity").alias("tracked_quantity"))
    h = holdings.select("code", F.col("quantity").alias("held_quantity"))
    return t.join(h, "code", "full_outer").withColumn(
        "side", F.when(F.col("held_quantity").isNull(), "not_at_broker")
        .when(F.col("tracked_quantity").isNull(), "not_tracked").otherwise("both"))


def fill_buy_price(positions: DataFrame, bars: DataFrame) -> DataFrame:
    opens = bars.select("code", F.col("date").alias("buy_date"), F.col("open").alias("_open"))
    pending = (F.col("status") == "active") & F.col("buy_price").isNull()
    return positions.join(opens, ["code", "buy_date"], "left").withColumn(
        "buy_price", F.when(pending, F.col("_open")).otherwise(F.col("buy_price"))).drop("_open")
