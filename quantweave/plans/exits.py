"""Stop and target levels from the average true range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantweave.operators.recursive import recursive


def wilder_stops(bars: DataFrame, stop_mult: float = 1.0, target_mult: float = 4.0) -> DataFrame:
    """Last Wilder ATR per instrument (0 without enough history) with exit levels."""
    last = recursive(bars, ["atr"]).groupBy("code").agg(
        F.max("date").alias("date"), F.max_by("atr_abs", "date").alias("atr"))
    price = bars.groupBy("code").agg(F.max_by("close", "date").alias("close"))
    atr = F.coalesce("atr", F.lit(0.0))
    return last.join(price, "code").select(
        "code", "date", "close", atr.alias("atr"), (F.col("close") - stop_mult * atr).alias("stop_loss"),
        (F.col("close") + target_mult * atr).alias("take_profit"))
