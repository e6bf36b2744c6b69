"""One pass of trailing aggregates against the window functions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quantweave.functions.trailing import numbered, one_pass
from quantweave.functions.windows import lag, rmax, rmin, rstd, rstd_pop, rsum, rvar, sma
from quantweave.operators import features, rolling, technical as t


def bars(spark):
    """Two instruments with nulls, a flat stretch and a volume of 0, one shorter than a frame, one without a code."""
    rnd, rows = random.Random(5), []
    for code, n in (("600001", 160), ("000002", 140), ("300003", 7), (None, 70)):
        for i in range(n):
            flat = 60 <= i < 100
            close = 20.0 if flat else 20 + rnd.randrange(300) / 128
            high, low, op = (close, close, close) if flat else (close + rnd.randrange(5) / 128, close - rnd.randrange(5) / 128, close)
            volume = float(0 if i % 31 == 30 else rnd.randrange(1, 50))
            row = [code, dt.date(1992, 1, 6) + dt.timedelta(7 * i), op, high, low, close, volume, volume * 10]
            if i in (12, 45):
                row[rnd.randrange(2, 8)] = None
            rows.append(tuple(row))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double")


def same(one, two):
    names = ["code", "date", *[c for c in one.columns if c not in ("code", "date")]]

    def rows(df):
        return {(r[0], r[1]): [None if x is None else x for x in r[2:]] for r in df.select(names).collect()}
    a, b = rows(one), rows(two.select(names))
    assert a.keys() == b.keys()
    for k in a:
        for name, x, y in zip(names[2:], a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(x))), (k, name, x, y)


def test_pass_equals_windows(spark):
    def columns():
        up = F.when(F.col("close") > F.col("open"), F.col("close"))
        return {"a": sma("close", 20), "b": rstd("close", 20), "c": rstd_pop(up, 3), "d": rsum(up, 2), "e": rmax("high", 5), "f": rmin("low", 5),
                "g": rvar("volume", 30), "h": lag("close", 4), **rolling.moment_cols(20, "i", "j")}
    df = bars(spark).withColumn("_ret", F.col("close") / 20 - 1)
    with one_pass() as p:
        asked = columns()
    same(p.on(df, asked).select("code", "date", *asked), df.withColumns(columns()).select("code", "date", *asked))


def test_blocks_equal_single_factors(spark):
    df = t.base(bars(spark))
    one = t.cr(t.mfi(t.ad(t.obv(t.price_var(t.cci(t.ulcer(t.ma_slope(t.aroon(t.rvi(df))))))))))
    names = ["cr", "mfi", "ad", "obv", "price_var", "cci", "ulcer", "ma_slope", "aroon_up", "aroon_down", "rvi"]
    same(t.window_block(df).select("code", "date", *names), one.select("code", "date", *names))
    one = rolling.price_volume_corr(rolling.momentum_sums(rolling.drawdown(rolling.downside_risk(rolling.range_stats(rolling.rolling_sharpe(df))))))
    names = ["price_volume_corr", "acceleration", "momentum_5d", "max_drawdown_20", "downside_risk", "hl_range_std", "sharpe_ratio"]
    same(rolling.rolling_block(df).select("code", "date", *names), rolling.clean(one, names).select("code", "date", *names))


def test_blocks_have_no_sliding_frames(spark):
    """A sliding frame costs its length for every row and column."""
    df = t.base(bars(spark))
    for block in (t.window_block, rolling.rolling_block):
        for line in block(df)._jdf.queryExecution().optimizedPlan().toString().split("RowFrame, ")[1:]:
            assert line.startswith(("unboundedpreceding", "-1, -1"))


@pytest.fixture
def small_batches(spark):
    """Batches of 16 rows, so that instruments go on in the next one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pass_over_cut_instruments(spark, small_batches):
    df = t.base(bars(spark)).withColumn("_ret", F.col("close") / 20 - 1)

    def columns():
        return {"a": sma("close", 20), "b": rstd("close", 60), "c": lag("close", 33), "d": rsum("_ret", 10) - lag(rsum("_ret", 20), 10), "e": sma("volume", 120)}
    with one_pass() as p:
        asked = columns()
    two = df.withColumns({"_s10": rsum("_ret", 10), "_s20": rsum("_ret", 20)}).withColumns(
        {"a": sma("close", 20), "b": rstd("close", 60), "c": lag("close", 33), "d": F.col("_s10") - lag("_s20", 10), "e": sma("volume", 120)})
    same(p.on(df, asked).select("code", "date", *asked), two.select("code", "date", *asked))


def test_fill_and_ranks_over_cut_instruments(spark, small_batches):
    df = bars(spark).withColumn("x", F.when(F.dayofyear("date") % 5 == 0, F.col("close")))
    same(t.fill_block(numbered(df), ["x", "volume"]).select("code", "date", "x", "volume"), t.fill_block(df, ["x", "volume"]).select("code", "date", "x", "volume"))
    dateless = df.limit(1).withColumns({"code": F.lit("600001"), "date": F.lit(None).cast("date"), "close": F.lit(1.0), "x": F.lit(1.0)})
    got = features.rolling_rank(df.unionByName(dateless), ["close", "x"], 50, 25).select("code", "date", "rank_close", "rank_x")
    pdf, want = df.toPandas().sort_values("date"), {("600001", None): [None, None]}
    want |= {(None, d): [None, None] for d in pdf["date"][pdf["code"].isna()]}  # neither code nor date may be absent
    for _, g in pdf[pdf["code"].notna()].groupby("code"):
        for name in ("close", "x"):
            for r, v in zip(g.itertuples(), g[name].rolling(50, min_periods=25).rank(pct=True).where(g[name].notna()), strict=True):
                want.setdefault((r.code, r.date), []).append(None if v != v else v)
    rows = {(r[0], r[1]): [r[2], r[3]] for r in got.collect()}
    assert rows.keys() == want.keys() and len(rows) == 378
    assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for k in rows for x, y in zip(rows[k], want[k], strict=True))


def test_pass_tells_moved_rows(spark):
    df = numbered(bars(spark)).repartition(3, "date")
    with pytest.raises(Exception, match="not in one piece"):
        t.fill_block(df, ["close"]).agg(F.sum("close")).collect()


@pytest.mark.parametrize("name", ["x26_base_block", "x27_engineered_block", "x27_full_pipeline"])
def test_wide_rows_are_not_moved(spark, name):
    """From the first pass on no row is shuffled, and the block is worked out once."""
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    passes = [i for i, line in enumerate(plan) if "ArrowEvalPython" in line]
    assert len(passes) == (3 if name == "x27_engineered_block" else 2)  # the pipeline aligned to few columns leaves the ranks out
    assert not [line for line in plan[:passes[-1]] if "Exchange" in line or "Join" in line]
