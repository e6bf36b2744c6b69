"""The incremental jobs as streams.

Each job reads a folder of arriving files, works per micro-batch and merges by
key, so a replayed batch or a restart leaves the same table. Checkpoints and
tables live in the shared folder (``spark.checkpoint.dir``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quantweave.functions.windows import div
from quantweave.operators import breadth as br
from quantweave.operators import signals
from quantweave.session import staged, work_dir
from quantweave.sources.upsert import upsert_table
from quantweave.streaming import processors

cloudpickle.register_pickle_by_value(processors)

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def inbox(spark: SparkSession, slices: list[DataFrame], label: str) -> tuple[str, object]:
    """Folder of arriving files, one load after the other (stands in for the vendor feed)."""
    path = work_dir(spark, f"{label}-inbox")
    for df in slices:
        df.write.mode("append").parquet(path)
    return path, slices[0].schema


def files(spark: SparkSession, path: str, schema, per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(df: DataFrame, spark: SparkSession, label: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    (df.writeStream.outputMode(mode).option("checkpointLocation", work_dir(spark, f"{label}-checkpoint"))
     .trigger(availableNow=True).foreachBatch(each).start().awaitTermination())


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.year("date"))


def version(source: DataFrame) -> str | None:
    """Bars with a load number are merged by it, whatever their order of arrival."""
    return "load" if "load" in source.columns else None


def bar_upsert(spark: SparkSession, source: DataFrame) -> DataFrame:
    """Streaming bar upsert; the row with the highest load number wins, of equal ones the one that came last.

    A batch is written to a log under its number, so one that is run again replaces its own rows. The log is merged
    into the table when it holds as many rows as the table, and at the end: a row is rewritten once for each
    doubling of the table, however many batches it comes in.
    """
    table, log = work_dir(spark, "bars-table"), work_dir(spark, "bars-log")
    held, waiting = 0, {}  # rows merged so far, and those of each batch that waits

    def merge() -> None:
        nonlocal held
        rows = spark.read.schema(schema).parquet(*[f"{log}/{i}" for i in waiting])
        upsert_table(spark, table, rows, ["code", "date"], "year", ["load", "batch"])
        held += sum(waiting.values())
        waiting.clear()

    def each(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{log}/{i}")
        waiting[i] = spark.read.schema(schema).parquet(f"{log}/{i}").count()
        if sum(waiting.values()) >= held:
            merge()
    rows = with_year(source)
    schema = StructType([*rows.schema.fields, StructField("batch", LongType())])
    run(rows, spark, "bar-upsert", each)
    if waiting:
        merge()
    return spark.read.parquet(table).drop("batch")


def factor_append(spark: SparkSession, source: DataFrame, compute: Callable[[DataFrame], DataFrame], lookback: int) -> DataFrame:
    """Per batch: merge the bars, then recompute only the tail of the touched instruments
    from ``lookback`` earlier bars and merge it into the factor store."""
    bars_table, store = work_dir(spark, "bars-table"), work_dir(spark, "factor-store")

    def each(batch: DataFrame, _: int) -> None:
        upsert_table(spark, bars_table, batch, ["code", "date"], "year", version(source))
        first = batch.groupBy("code").agg(F.min("date").alias("_first"))
        w = Window.partitionBy("code").orderBy("date")
        df = spark.read.parquet(bars_table).join(first, "code").withColumn("_rn", F.row_number().over(w))
        start = F.min(F.when(F.col("date") >= F.col("_first"), F.col("_rn"))).over(Window.partitionBy("code"))
        df = df.withColumn("_from", start).where(F.col("_rn") >= F.col("_from") - lookback).drop("_rn", "_from")
        new = compute(df).where(F.col("date") >= F.col("_first")).drop("_first")
        upsert_table(spark, store, with_year(new), ["code", "date"], "year")
    run(with_year(source), spark, "factor-append", each)
    return spark.read.parquet(store)


def breadth_by_date(spark: SparkSession, source: DataFrame, reach: int = 20) -> DataFrame:
    """Per batch: breadth of every date that a changed bar reaches; rows replaced by date.

    A bar takes part in the averages of its instrument's next ``reach - 1`` bars and is
    the previous close of the next one. So dates are refreshed from the lowest changed one to
    the last one reached, and every instrument brings its own ``reach`` earlier bars.
    """
    bars_table, out = work_dir(spark, "bars-table"), work_dir(spark, "breadth-table")

    def each(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        upsert_table(spark, bars_table, batch, ["code", "date"], "year", version(source))
        bars = spark.read.parquet(bars_table)
        touched = batch.groupBy("code").agg(F.min("date").alias("_low"), F.max("date").alias("_high"))
        low, high = touched.agg(F.min("_low"), F.max("_high")).first()
        nearest = Window.partitionBy("code").orderBy("date")
        later = bars.select("code", "date").join(touched, "code").where(F.col("date") > F.col("_high")).withColumn("_n", F.row_number().over(nearest))
        last = later.where(F.col("_n") < reach).agg(F.max("date")).first()[0]
        high = max(high, last) if last else high
        latest = Window.partitionBy("code").orderBy(F.desc("date"))
        before = bars.where(F.col("date") < F.lit(low)).withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= reach).drop("_n")
        fresh = br.breadth(before.unionByName(bars.where(F.col("date").between(F.lit(low), F.lit(high))))).where(F.col("date") >= F.lit(low))
        upsert_table(spark, out, with_year(fresh), ["date"], "year")
    run(with_year(source), spark, "breadth", each)
    return spark.read.parquet(out)


def tick_bars(spark: SparkSession, ticks: DataFrame, lateness: str = "1 day") -> tuple[DataFrame, DataFrame]:
    """(bars, late): daily bars from ticks, and the ticks that came more than ``lateness`` after the newest one before their batch.

    A batch folds its ticks to one partial bar for each (code, date) and stores it under the batch number, so a batch that is
    run again replaces its own partials. First, last, extremes and counts of partials merge, so a tick of any age changes its bar; late ones
    are kept apart as well, with their batch. No state grows with the open days.
    """
    parts, late = work_dir(spark, "tick-partials"), work_dir(spark, "late-ticks")
    seq = F.struct("ts", "event_id")

    def each(batch: DataFrame, i: int) -> None:
        try:
            newest = spark.read.parquet(parts).where(F.col("batch") < i).agg(F.unix_micros(F.max("last_at.ts"))).first()[0]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            newest = None
        fresh = batch.groupBy("code", F.to_date("ts").alias("date")).agg(
            F.min(seq).alias("first_at"), F.max(seq).alias("last_at"), F.min_by("price", seq).alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", seq).alias("close"), F.count(F.lit(1)).alias("ticks"))
        fresh = fresh.select("*", F.lit(i).cast("long").alias("batch"), F.date_format("date", "yyyy-MM").alias("month"))
        upsert_table(spark, parts, fresh, ["code", "date", "batch"], "month")
        limit = F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"INTERVAL {lateness}")
        batch.where(F.col("ts") < limit).write.mode("overwrite").parquet(f"{late}/batch={i}")
    run(ticks, spark, "tick-bars", each)
    bars = spark.read.parquet(parts).groupBy("code", "date").agg(
        F.min_by("open", "first_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_at").alias("close"), F.sum("ticks").alias("ticks"))
    return bars, spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ticks.schema)}, batch long").parquet(late)


def ticks_to_bars(spark: SparkSession, ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    return tick_bars(spark, ticks, lateness)[0]


#: Bars may arrive this much out of order; later ones are not seen by the stateful jobs.
LATENESS = "30 days"
#: The key and the date of the row that closes a feed: it moves the watermark past all bars and is never released itself.
CLOSING, CLOSING_DATE = "", "2261-01-01"


def closing_row(bars: DataFrame) -> DataFrame:
    """One row with the columns of ``bars`` that ends a feed."""
    cells = [F.lit(CLOSING) if f.name == "code" else F.lit(CLOSING_DATE).cast("date") if f.name == "date" else F.lit(None) for f in bars.schema]
    return bars.sparkSession.range(1, numPartitions=1).select(*[c.cast(f.dataType).alias(f.name) for c, f in zip(cells, bars.schema, strict=True)])


def stateful(spark: SparkSession, bars: DataFrame, processor, schema: str, label: str, start: DataFrame | None = None, lateness: str = LATENESS) -> DataFrame:
    """Runs a processor over the bars, keyed by instrument, in event time to the end of the input and returns its output table."""
    table = work_dir(spark, f"{label}-table")
    if spark.conf.get(PROVIDER, None) != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)  # keyed state of this kind needs it; it stays set, so queries side by side agree
    rows = bars.select("code", F.col("date").cast("timestamp").alias("ts"), F.unix_date("date").cast("long").alias("day"), "high", "low", "close")
    out = rows.withWatermark("ts", lateness).groupBy("code").transformWithStateInPandas(
        processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", initialState=None if start is None else start.groupBy("code"))
    (out.writeStream.outputMode("append").format("parquet").option("path", table)
     .option("checkpointLocation", work_dir(spark, f"{label}-checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(schema).parquet(table)


def dated(df: DataFrame, **names: str) -> DataFrame:
    """Day numbers as dates under their names."""
    return df.select(*[F.date_from_unix_date(F.col(c).cast("int")).alias(names[c]) if c in names else F.col(c) for c in df.columns])


def exit_monitor(spark: SparkSession, bars: DataFrame, entries: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Bars stream against the open positions, which are the starting state of their instrument."""
    def day(c):
        return F.unix_date(c).cast("long")
    start = entries.select("code", "strategy", day("date").alias("signal_day"), day("entry_date").alias("entry_day"), F.col("entry_price").alias("price"),
                           F.col("stop_loss").alias("stop"), F.col("take_profit").alias("target"))
    start = staged(start, "open-positions")  # every batch plans the starting state again, so it is read from files, not joined anew
    out = stateful(spark, bars, processors.ExitMonitor(signals.TIME_STOP_DAYS, signals.TIME_STOP_PNL),
                   "strategy string, code string, signal_day long, exit_day long, exit_price double, exit_reason string, holding_days int", "exits", start, lateness)
    return dated(out, signal_day="signal_date", exit_day="exit_date")


def stochastic(spark: SparkSession, bars: DataFrame, n: int, lateness: str = LATENESS) -> DataFrame:
    return dated(stateful(spark, bars, processors.Stochastic(n), "code string, day long, kdj_k double, kdj_d double, kdj_j double", "kdj", lateness=lateness), day="date")


def breadth_alert(spark: SparkSession, bars: DataFrame, previous: DataFrame) -> DataFrame:
    """Running breadth counts per date as bars arrive; previous closes come from a static table.
    Bars are kept by key, and a batch recounts the dates it touches, so a bar that
    is sent again or corrected counts once and no state grows with the stream."""
    bars_table, table = work_dir(spark, "bars-table"), work_dir(spark, "alert-table")

    def each(batch: DataFrame, _: int) -> None:
        upsert_table(spark, bars_table, batch, ["code", "date"], "year", version(bars))
        dates = batch.select("date").distinct()
        stored = spark.read.parquet(bars_table).join(dates, "date", "left_semi")
        upsert_table(spark, table, with_year(alert_counts(stored.join(previous, ["code", "date"], "left"))), ["date"], "year")
    run(with_year(bars), spark, "alert", each)
    return spark.read.parquet(table)


def alert_counts(df: DataFrame) -> DataFrame:
    cl, op = F.col("close"), F.col("open")
    change = div(cl, "prev_close") - 1
    return df.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"), br.count_if(cl > op * (1 + br.TOLERANCE)).alias("up_count"),
        br.count_if(cl < op * (1 - br.TOLERANCE)).alias("down_count"),
        br.count_if((cl >= F.col("high") * (1 - br.TOLERANCE)) & (change > br.LIMIT)).alias("limit_up_count"),
        br.count_if((cl <= F.col("low") * (1 + br.TOLERANCE)) & (change < -br.LIMIT)).alias("limit_down_count"),
        F.avg(div(cl, op) - 1).alias("mean_return"))
