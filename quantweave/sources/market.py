"""Market tables derived from the TPC-H-like input tables.

Bars are weekly roll-ups of ``lineitem`` per supplier; the traded price is 20
plus one tick of 1/128 per 320 of extended price (about 20.0 to 22.6); with such
ticks sums of prices are exact, whatever the order of addition. Open and close are
``min_by`` / ``max_by`` aggregates, so a supplier that holds a third of all
line items is folded map-side and never lands whole in one task.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantweave.session import work_dir

# Code prefixes, one per listing board, assigned by supplier key modulo 8.
CODE_PREFIXES = ["600", "000", "300", "688", "430", "830", "870", "920"]


def instrument_code(key: str) -> Column:
    """Board prefix + running number; six digits up to 8 000 suppliers, longer beyond."""
    k = F.col(key)
    prefix = F.element_at(F.array(*[F.lit(p) for p in CODE_PREFIXES]), (k % 8 + 1).cast("int"))
    number = F.floor(k / 8).cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    return F.concat(prefix, padded)


def code_number(code: str = "code") -> Column:
    return F.substring(F.col(code), 4, 20).cast("long")


_LOCK = threading.RLock()
_TABLES: dict[tuple[str, str, str], str] = {}
#: Rows of a bucket; tables of fewer rows have LEAST_BUCKETS.
ROWS_PER_BUCKET = 2_000_000
LEAST_BUCKETS = 8


class Market:
    """The input tables of one data folder.

    The roll-ups of ``lineitem`` (weekly bars, quarterly statements) and the
    derived inputs of later stages (trades, model frame) are written once per
    session as tables bucketed by ``code`` in the shared folder; all later
    reads start from them. Every per-instrument window or grouped map on a
    bucketed table runs without a shuffle, a plan that reads its input several
    times does not repeat the upstream work, and a lost executor costs only
    the tasks it ran.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    def bucketed(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.root, name)
        with _LOCK:
            if key not in _TABLES:
                n = max(LEAST_BUCKETS, -(-self.table("lineitem").count() // ROWS_PER_BUCKET))  # no derived table has more rows
                table = f"quantweave_{name}_{uuid.uuid4().hex[:12]}"
                (build().repartition(n, "code").write.bucketBy(n, "code")
                 .option("path", work_dir(self.spark, name)).saveAsTable(table))
                _TABLES[key] = table
        return self.spark.table(_TABLES[key])

    def _fills(self) -> DataFrame:
        return self.table("lineitem").select(
            instrument_code("l_suppkey").alias("code"),
            F.to_date("l_shipdate").alias("day"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount",
            (F.lit(20.0) + F.floor(F.col("l_extendedprice") / 320) / 128.0).alias("px"))

    def bars(self) -> DataFrame:
        return self.bucketed("bars", self.derive_bars)

    def derive_bars(self) -> DataFrame:
        seq = F.struct("day", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "px")
        return (self._fills()
                .groupBy("code", F.trunc("day", "week").alias("date"))
                .agg(F.min_by("px", seq).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
                     F.max_by("px", seq).alias("close"), F.sum("l_quantity").alias("volume"),
                     F.round(F.sum("l_extendedprice"), 2).alias("amount"))
                .withColumn("is_st", (code_number() % 6 == 5).cast("int")))

    def adjust_factor(self) -> DataFrame:
        """Sparse factor rows: the first bar of each year, no rows for every seventh instrument."""
        first = (self.bars().where(code_number() % 7 != 0)
                 .groupBy("code", F.year("date").alias("y")).agg(F.min("date").alias("date")))
        return first.select("code", "date",
                            (F.lit(1.0) / (F.lit(1.0) + F.lit(0.05) * (2002 - F.col("y")))).alias("fore_adjust_factor"))

    def quarters(self) -> DataFrame:
        return self.bucketed("quarters", self.derive_quarters)

    def derive_quarters(self) -> DataFrame:
        return (self._fills()
                .groupBy("code", F.year("day").alias("y"), F.quarter("day").alias("qn"))
                .agg(F.round(F.sum("l_extendedprice"), 2).alias("rev"),
                     F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"),
                     F.sum("l_quantity").alias("sh"), F.count(F.lit(1)).alias("fills")))

    def _with_dates(self, q: DataFrame) -> DataFrame:
        n = code_number()
        stat = F.last_day(F.make_date("y", F.col("qn") * 3, F.lit(1)))
        pub = F.make_date(F.when(F.col("qn") == 4, F.col("y") + 1).otherwise(F.col("y")),
                          F.element_at(F.array(F.lit(4), F.lit(8), F.lit(10), F.lit(4)), F.col("qn")),
                          F.when(F.col("qn") == 4, F.lit(18)).otherwise(F.lit(28)))
        return q.withColumns({"stat_date": stat, "pub_date": F.when(n % 5 == 0, F.lit(None).cast("date")).otherwise(pub)})

    def profit_ability(self) -> DataFrame:
        return self._with_dates(self.quarters()).select(
            "code", "stat_date", "pub_date", (F.col("net") / F.col("rev")).alias("roeAvg"),
            F.col("net").alias("netProfit"), (F.col("net") / F.col("sh")).alias("epsTTM"),
            F.col("sh").alias("totalShare"))

    def growth_ability(self) -> DataFrame:
        w = Window.partitionBy("code", "qn").orderBy("y")
        q = self._with_dates(self.quarters()).withColumns({"_py": F.lag("y").over(w), "_prev": F.lag("net").over(w)})
        return q.where(F.col("_py") == F.col("y") - 1).select(
            "code", "stat_date", "pub_date",
            (F.lit(100.0) * (F.col("net") - F.col("_prev")) / F.col("_prev")).alias("YOYPNI"))

    def balance_ability(self) -> DataFrame:
        """Every ninth (instrument, quarter) has no balance row."""
        return self._with_dates(self.quarters()).where((code_number() + F.col("y") * 4 + F.col("qn")) % 9 != 0).select(
            "code", "stat_date", "pub_date", (F.col("rev") / F.col("net")).alias("assetToEquity"),
            (F.lit(1.0) - F.col("net") / F.col("rev")).alias("liabilityToAsset"))

    def dupont(self) -> DataFrame:
        return self._with_dates(self.quarters()).select(
            "code", "stat_date", "pub_date", (F.col("net") / F.col("rev") * F.col("fills")).alias("dupontROE"))

    def stock_basic(self) -> DataFrame:
        s = self.table("supplier")
        n = self.table("nation").select("n_nationkey", "n_name")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            instrument_code("s_suppkey").alias("code"), F.col("s_name").alias("code_name"),
            F.col("n_name").alias("industry"), F.col("s_acctbal").alias("acctbal"))
