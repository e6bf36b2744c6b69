"""Forward returns, labels, cross-section ranks and sample weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions import ranks
from quantweave.functions.blockrank import block_shares
from quantweave.functions.windows import by_code, div, lead
from quantweave.operators.filters import status_flags

HORIZON = 5
UNBUYABLE_LABEL = 0.05


def forward_returns(bars: DataFrame, n: int = HORIZON) -> DataFrame:
    return bars.withColumn("f_return", div(lead("close", n), "close") - 1)


def forward_path(bars: DataFrame, n: int = HORIZON) -> DataFrame:
    """Best and worst excursion over the next n bars, null without n of them."""
    w = by_code().rowsBetween(1, n)
    full = F.count(F.lit(1)).over(w) == n
    return bars.withColumns({
        "f_max_return": F.when(full, div(F.max("high").over(w), "close") - 1),
        "f_min_return": F.when(full, div(F.min("low").over(w), "close") - 1)})


def path_label(bars: DataFrame, n: int = HORIZON) -> DataFrame:
    df = forward_path(forward_returns(bars, n), n)
    r = F.col("f_return")
    return df.withColumn("label_raw", F.signum(r) * F.pow(F.abs(r), 1.5) + 0.5 * F.col("f_max_return") + F.col("f_min_return"))


def labelled(bars: DataFrame, n: int = HORIZON) -> DataFrame:
    """Rows with a complete label, with market status."""
    return path_label(status_flags(bars), n).where(F.col("label_raw").isNotNull() & F.col("f_return").isNotNull())


def board_rank(df: DataFrame, bounded: bool = False) -> DataFrame:
    """Average rank / (n + 1) inside (date, limit threshold); 0.5 on single-row dates."""
    df = ranks.avg_rank(df, ["date", "limit_threshold"], "label_raw", "_r", "_n", bounded, few_groups=True)
    per_date = df.groupBy("date").agg(F.count(F.lit(1)).alias("_nd"))
    return df.join(F.broadcast(per_date), "date").withColumn(
        "label", F.when(F.col("_nd") == 1, F.lit(0.5)).otherwise(F.col("_r") / (F.col("_n") + 1))).drop("_r", "_n", "_nd")


def penalise(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.when(F.col("unbuyable") == 1, F.lit(UNBUYABLE_LABEL)).otherwise(F.col("label")))


def split_date(df: DataFrame, share: float = 0.7) -> DataFrame:
    """One row: the date that holds the row at ``share`` of all rows in date order.
    Works on counts per date (bounded by the calendar)."""
    per = df.groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    run = F.sum("n").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    per = per.withColumns({"_upto": run, "_all": F.sum("n").over(Window.partitionBy())})
    cut = F.least(F.floor(F.col("_all") * F.lit(share)), F.col("_all") - 1)
    return per.where((F.col("_upto") > cut) & (F.col("_upto") - F.col("n") <= cut)).select(F.col("date").alias("split_date"))


def time_split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """``is_train`` for rows before the split date; with a share of 1 every row trains."""
    one = split_date(df, share)
    before = F.lit(True) if share >= 1 else F.coalesce(F.col("date") < F.col("split_date"), F.lit(False))
    return df.join(F.broadcast(one), how="left").withColumn("is_train", before)


def sample_weight(df: DataFrame) -> DataFrame:
    raw = F.abs(F.col("f_return") / F.greatest(F.least(F.col("limit_threshold"), F.lit(0.3)), F.lit(0.04)))
    df = df.withColumn("_w", raw)
    mean = df.agg(F.avg("_w").alias("_mean"))
    return df.join(F.broadcast(mean)).withColumn("weight", F.col("_w") / F.col("_mean")).drop("_w", "_mean")


def cross_rank(df: DataFrame, features: Sequence[str], plus_one: bool = True, null_rank: float | None = None,
               keys: Sequence[str] = ("date",), bounded: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """Replace features by their average-tie percentile inside each date.

    ``plus_one`` divides by n + 1 (training), else by the number of non-null
    values (scoring). Dates with one row stay as they are. The split form keeps
    rows wide (:func:`block_shares`); ``bounded`` says that a date is small enough
    for one sort per feature inside a single exchange by date. ``sizes`` may stand in where the rows of the groups are counted (:func:`block_shares`).
    """
    keys, features = list(keys), list(features)
    if bounded:
        whole = Window.partitionBy(*keys)
        rows = F.count(F.lit(1)).over(whole)

        def expr(f):
            size = (rows + 1) if plus_one else F.count(f).over(whole)
            r = ranks.tied_rank(keys, f) / size
            if null_rank is not None:
                r = F.coalesce(r, F.lit(null_rank))
            return F.when(rows > 1, r).otherwise(F.col(f)) if plus_one else r
        return df.select(*[c for c in df.columns if c not in features], *[expr(f).alias(f) for f in features])
    return block_shares(df, keys, features, plus_one, null_rank, sizes=sizes)


def relevance(df: DataFrame, score: str, bins: int = 150, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Graded relevance: how many of the thresholds i/bins (i = 1 .. bins-1) lie strictly
    below the percentile rank. Integer arithmetic, so equality is exact."""
    df = ranks.avg_rank(df, keys, score, "_r", "_n", few_groups=True)
    twice = (F.col("_r") * 2).cast("long") * bins
    below = F.floor((twice + 2 * F.col("_n") - 1) / (2 * F.col("_n"))) - 1
    return df.withColumn("relevance", F.greatest(F.lit(0), F.least(F.lit(bins - 1), below)).cast("int")).drop("_r", "_n")


def tie_breaker(code: str = "code"):
    """int(md5(code)) mod 1000 / 100000 by Horner steps over four 32-bit chunks (2^32 mod 1000 = 296)."""
    h = F.md5(F.col(code))
    m = F.lit(0).cast("long")
    for i in range(4):
        m = (m * 296 + F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("long")) % 1000
    return m / 100000.0
