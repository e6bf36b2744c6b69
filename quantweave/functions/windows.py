"""Row-count windows over one instrument, with the full-window guard.

``(code, date)`` is the key of the bar table, so one ``code`` partition never
holds more rows than the calendar has sessions, whatever the raw trade volume
of that instrument was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions.trailing import ASKED


def by_code():
    return Window.partitionBy("code").orderBy("date")


def whole_code():
    return Window.partitionBy("code")


def by_date():
    return Window.partitionBy("date")


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int):
    return by_code().rowsBetween(-(n - 1), 0)


def lag(x, k: int = 1) -> Column:
    if ASKED.get():
        return ASKED.get().add("lag", k, x)
    return F.lag(col(x), k).over(by_code())


def lead(x, k: int = 1) -> Column:
    return F.lead(col(x), k).over(by_code())


def guarded(agg, x, n: int) -> Column:
    """``agg`` over the last n rows, null unless all n values are present."""
    if ASKED.get():
        return ASKED.get().add(agg.__name__, n, x)
    x = col(x)
    return F.when(F.count(x).over(trailing(n)) == n, agg(x).over(trailing(n)))


def sma(x, n: int) -> Column:
    return guarded(F.avg, x, n)


def rsum(x, n: int) -> Column:
    return guarded(F.sum, x, n)


def rmax(x, n: int) -> Column:
    return guarded(F.max, x, n)


def rmin(x, n: int) -> Column:
    return guarded(F.min, x, n)


def rstd(x, n: int) -> Column:
    return guarded(F.stddev_samp, x, n)


def rstd_pop(x, n: int) -> Column:
    return guarded(F.stddev_pop, x, n)


def rvar(x, n: int) -> Column:
    return guarded(F.var_samp, x, n)


def running(agg, x) -> Column:
    return agg(col(x)).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def ffill(x) -> Column:
    return F.last(col(x), ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))


def bfill(x) -> Column:
    return F.first(col(x), ignorenulls=True).over(by_code().rowsBetween(0, Window.unboundedFollowing))


def div(a, b) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def flag(cond: Column) -> Column:
    """Signal as 0.0 / 1.0; an unknown comparison is no signal."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def where_computed(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on a costly computed column. The row id keeps the projection below
    non-deterministic, so the optimizer does not copy the column's expression into
    a second, pushed-down evaluation."""
    return df.withColumn("_row", F.monotonically_increasing_id()).where(cond & (F.col("_row") >= 0)).drop("_row")
