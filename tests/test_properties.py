"""Properties: adjustment, no look-ahead, skew-safe ranks, upserts, streams equal batch."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweave.catalog.joins import reports
from quantweave.functions import ranks
from quantweave.operators import adjust, candles, features, labels, rolling, scoring, signals, structure
from quantweave.operators import fundamentals as fu
from quantweave.operators import technical as t
from quantweave.operators.kernels import ALL, output_columns
from quantweave.operators.recursive import recursive
from quantweave.session import work_dir
from quantweave.sources import payload, upsert

D = dt.date


def test_returns_do_not_depend_on_the_base_date(market):
    df = adjust.base_dependence(market.bars(), market.adjust_factor(), D(1997, 12, 31), D(2000, 12, 31))
    assert df.agg(F.max("max_return_diff")).first()[0] < 1e-6


def test_adjusted_price_depends_on_the_base_date(market):
    a = adjust.to_base_date(market.bars(), market.adjust_factor(), D(1997, 12, 31), ["close"])
    b = adjust.to_base_date(market.bars(), market.adjust_factor(), D(2000, 12, 31), ["close"])
    j = a.select("code", "date", F.col("adj_close").alias("x")).join(b.select("code", "date", F.col("adj_close").alias("y")), ["code", "date"])
    assert j.where(F.abs(F.col("x") - F.col("y")) > 1e-6).count() > 0


def test_as_of_adjustment_sees_no_later_factor(market):
    day = market.bars().where("date <= DATE '1998-06-30'").agg(F.max("date")).first()[0]
    one = adjust.to_as_of(market.bars(), market.adjust_factor(), day)
    cut = adjust.to_as_of(market.bars().where(F.col("date") <= F.lit(day)), market.adjust_factor().where(F.col("date") <= F.lit(day)), day)
    assert one.exceptAll(cut).count() == 0


def test_no_feature_looks_ahead(market):
    """Every feature computed on data cut at a date equals the full computation up to that date."""
    cut = D(2000, 6, 30)
    bars = market.bars()

    def block(df):
        wide = rolling.rolling_block(t.window_block(t.base(fu.fundamental_block(df, reports(market)))))
        wide = candles.strength(candles.ratios(candles.with_shape(wide).withColumns(candles.signals())))
        cols = t.WINDOW_FACTORS + rolling.ROLLING_FACTORS + candles.CANDLE_FACTORS + fu.DERIVED
        return wide.where(F.col("date") <= F.lit(cut)).select("code", "date", *[F.round(F.col(c), 7).alias(c) for c in cols])

    def block_rec(df):
        cols = output_columns(ALL)
        return recursive(df).where(F.col("date") <= F.lit(cut)).select("code", "date", *[F.round(F.col(c), 7).alias(c) for c in cols])
    short = bars.where(F.col("date") <= F.lit(cut))
    for f in (block, block_rec):
        full, part = f(bars).toPandas(), f(short).toPandas()
        keys = ["code", "date"]
        full, part = full.sort_values(keys).reset_index(drop=True), part.sort_values(keys).reset_index(drop=True)
        pd.testing.assert_frame_equal(full, part, check_exact=False, atol=2e-6, rtol=0)


def test_label_side_columns_do_look_ahead(market):
    assert candles.LABEL_SIDE == ["pattern_confirmation"]
    assert not set(candles.LABEL_SIDE) & set(candles.CANDLE_FACTORS)


@pytest.fixture(scope="module")
def skewed(spark):
    """A group that holds most rows, a hot value, nulls and ties."""
    rng = np.random.default_rng(7)
    v = np.where(rng.random(6000) < 0.4, 0.0, rng.normal(size=6000).round(2))
    pdf = pd.DataFrame({"id": range(6000), "g": np.where(rng.random(6000) < 0.8, "hot", rng.choice(list("abc"), 6000)), "v": v})
    pdf.loc[rng.random(6000) < 0.05, "v"] = None
    return pdf, spark.createDataFrame(pdf.astype({"v": object}).where(pdf.notna(), None), "id long, g string, v double")


@pytest.mark.parametrize("split", [True, False])
def test_average_ranks_equal_pandas(skewed, split):
    pdf, df = skewed
    got = ranks.avg_rank(df, ["g"], "v", "r", "n", bounded=not split).toPandas().sort_values("id")
    want = pdf.groupby("g")["v"].rank(method="average")
    assert np.allclose(got["r"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("keys", [["g"], []])
def test_quantiles_equal_numpy(skewed, keys):
    pdf, df = skewed
    got = ranks.quantiles(df, keys, "v", {"a": 0.05, "m": 0.5, "z": 0.93}).toPandas()
    groups = pdf.groupby("g")["v"] if keys else [(None, pdf["v"])]
    for name, s in groups:
        row = got[got["g"] == name].iloc[0] if keys else got.iloc[0]
        assert np.allclose([row["a"], row["m"], row["z"]], s.dropna().quantile([0.05, 0.5, 0.93]))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_rank_correlation_is_exact_for_any_partitioning(spark, parts):
    """Constant groups are left out, and every bit of the result is the same however the rows are dealt."""
    from quantweave.operators import scoring as sc
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"date": rng.choice(["hot", "hot", "hot", "a", "b", "flat", "flat2"], 9000), "p": rng.normal(size=9000).round(1), "r": rng.normal(size=9000).round(2)})
    pdf.loc[pdf.date == "flat", "p"] = 0.1 + 0.2
    pdf.loc[pdf.date == "flat2", "r"] = 1e-9
    pdf.loc[rng.random(9000) < 0.4, "p"] = 0.0
    pdf.loc[pdf.date == "flat", "p"] = 0.1 + 0.2
    df = spark.createDataFrame(pdf).union(spark.createDataFrame([("a", None, 1.0), ("tiny", 1.0, 2.0)], "date string, p double, r double")).repartition(parts)
    got = {r["date"]: r for r in sc.daily_rank_ic(df, "p", "r").collect()}
    small = {r["date"]: r for r in sc.daily_rank_ic(df, "p", "r", bounded=True).collect()}
    assert got == small and set(got) == {"hot", "a", "b"}
    for date, r in got.items():
        group = pdf[pdf.date == date]
        assert r["n"] == len(group)
        assert abs(r["rank_ic"] - np.corrcoef(group.p.rank(), group.r.rank())[0, 1]) < 1e-12
    first = getattr(test_rank_correlation_is_exact_for_any_partitioning, "seen", got)
    test_rank_correlation_is_exact_for_any_partitioning.seen = first
    assert got == first


def test_mutual_information_against_plain_counts(spark):
    from quantweave.operators import scoring as sc
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000).round(2)
    pdf = pd.DataFrame({"x": x, "z": np.where(rng.random(3000) < .5, 0.0, x), "y": (x + rng.normal(size=3000)).round(2)})
    pdf.loc[rng.random(3000) < .1, "x"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, z double, y double").withColumn("none", F.lit(None).cast("double"))
    got = {r["feature"]: r["score"] for r in sc.mutual_information(df, ["x", "z", "none"], "y").collect()}
    bins = {c: np.floor((pdf[c].rank(method="min") - 1) * 10 / pdf[c].notna().sum()) for c in pdf}
    assert set(got) == {"x", "z"}
    for c in got:
        table = pd.crosstab(bins[c], bins["y"]).to_numpy()
        p = table / table.sum()
        want = np.nansum(p * np.log(np.where(p > 0, p, 1) / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True))))
        assert abs(got[c] - want) < 1e-9


def test_best_weights_equal_the_exact_search(spark):
    from quantweave.operators import scoring as sc
    rng = np.random.default_rng(6)
    y = (rng.random(2000) < .4).astype(float)
    pdf = pd.DataFrame({"a": (y + rng.normal(size=2000)).round(1), "b": (y + 2 * rng.normal(size=2000)).round(2), "c": rng.normal(size=2000), "y": y})
    df = spark.createDataFrame(pdf)
    exact = {r["weight_id"]: r["auc"] for r in sc.weight_search(df, ["a", "b", "c"], "y", 8).collect()}
    for r in sc.weight_bounds(df, ["a", "b", "c"], "y", 8).collect():
        assert r["low"] <= exact[r["weight_id"]] <= r["high"]
    best = sc.best_weights(df, ["a", "b", "c"], "y", 8).first()
    assert best["weight_id"] == min(exact, key=lambda i: (-round(exact[i], 12), i)) and best["auc"] == exact[best["weight_id"]]
    plan = sc.weight_bounds(df, ["a", "b", "c"], "y", 8)._jdf.queryExecution().toString()
    assert "Generate" not in plan


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(3)
    s, y = rng.random(400).round(2), (rng.random(400) > 0.6).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"s": s, "y": y}))
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    assert scoring.auc(df, "s", "y").first()["auc"] == pytest.approx(want)


def test_cross_rank_forms_agree(market):
    df = t.bias(t.mtm(market.bars())).select("code", "date", F.round("bias", 6).alias("bias"), "mtm")
    a = labels.cross_rank(df, ["bias", "mtm"], bounded=True)
    b = labels.cross_rank(df, ["bias", "mtm"], bounded=False)
    j = a.join(b.select("code", "date", F.col("bias").alias("b2"), F.col("mtm").alias("m2")), ["code", "date"])
    assert j.where((F.abs(F.col("bias") - F.col("b2")) > 1e-12) | (F.abs(F.col("mtm") - F.col("m2")) > 1e-12)).count() == 0
    assert j.count() == df.count()


def test_relevance_counts_thresholds_strictly_below(spark):
    df = spark.createDataFrame([("d", i, float(i)) for i in range(1, 11)], "date string, code long, s double")
    got = [r["relevance"] for r in labels.relevance(df, "s", bins=10).orderBy("code").collect()]
    want = [sum(1 for i in range(1, 10) if k * 10 > 10 * i) for k in range(1, 11)]
    assert got == want


def test_tie_breaker_equals_md5(spark):
    import hashlib
    codes = ["600000", "000001", "300750"]
    got = {r["code"]: r["t"] for r in spark.createDataFrame([(c,) for c in codes], "code string").withColumn("t", labels.tie_breaker()).collect()}
    for c in codes:
        assert got[c] == int(hashlib.md5(c.encode()).hexdigest(), 16) % 1000 / 100000.0


def test_upsert_table_is_idempotent_and_touches_only_its_partitions(spark):
    path = work_dir(spark, "upsert-test")
    cols = "code string, y int, v int, load int"
    first = spark.createDataFrame([("a", 1, 10, 1), ("b", 1, 20, 1), ("a", 2, 30, 1)], cols)
    second = spark.createDataFrame([("a", 1, 11, 2), ("c", 1, 40, 2)], cols)
    upsert.upsert_table(spark, path, first, ["code", "y"], "y", "load")
    for _ in range(2):
        upsert.upsert_table(spark, path, second, ["code", "y"], "y", "load")
    upsert.upsert_table(spark, path, first, ["code", "y"], "y", "load")
    rows = {(r["code"], r["y"]): r["v"] for r in spark.read.parquet(path).collect()}
    assert rows == {("a", 1): 11, ("b", 1): 20, ("c", 1): 40, ("a", 2): 30}


def test_payload_bad_values_become_null(spark):
    df = spark.createDataFrame([("sh.600000", "1.5", "x"), ("sz.000001", "NaN", "1")], "code string, close string, isST string")
    rows = payload.normalise(df, payload.BAR_RENAME, ["close"], ["is_st"]).orderBy("code").collect()
    assert [(r["code"], r["close"], r["is_st"]) for r in rows] == [("000001", None, 1), ("600000", 1.5, 0)]


def test_signal_check_splits_everything(market):
    sig = signals.all_signals(market.bars()).withColumn("confidence", F.when(F.col("strategy") == "breakout", 140.0).otherwise(F.col("confidence")))
    ok, bad = signals.checked(sig)
    assert ok.count() + bad.count() == sig.count()
    assert bad.where("strategy <> 'breakout'").count() == 0


def brute_line(rows, kind):
    """Plain-loop short support/resistance line of at most ten bars."""
    n = len(rows)
    col = [r[1] if kind == "low" else r[2] for r in rows]
    days = [(r[0] - rows[0][0]).days for r in rows]
    pts = []
    for k in range(4):
        a, z = int(k * n / 4), int((k + 1) * n / 4)
        seg = list(range(a, z))
        pts.append(min(seg, key=lambda i: (col[i], i)) if kind == "low" else min(seg, key=lambda i: (-col[i], i)))
    best = None
    for x in range(4):
        for y in range(x + 1, 4):
            i, j = pts[x], pts[y]
            s = (col[j] - col[i]) / (days[j] - days[i])
            b = col[i] - s * days[i]
            over = max((s * d + b - c) if kind == "low" else (c - s * d - b) for d, c in zip(days, col))
            if over > 0 and over / np.mean(col) > 0.02:
                continue
            touches = sum(abs(col[p] - (s * days[p] + b)) <= 0.02 * abs(s * days[p] + b) for p in pts)
            if touches < 2:
                continue
            span = (days[j] - days[i]) / days[-1]
            pct = abs(s / col[i]) * 100
            band = 20 if 0.05 <= pct <= 0.5 else 15 if 0.02 <= pct < 0.05 else 12 if 0.5 < pct <= 1 else 5 if pct > 0 else 0
            score = round(touches * 100 + span * 50 + (1 - days[i] / days[-1]) * 80 + span * 30 + band, 9)
            if best is None or score > best[0]:
                best = (score, s, b)
    return best


def test_support_replay_equals_plain_loop(market):
    """Re-analysis on every bar, against loops over pandas rows."""
    bars = market.bars()
    trades = signals.entries(signals.golden_cross(bars), bars)
    got = {(r["code"], r["date"]): (r["sell_date"], r["exit_reason"], r["holding_days"]) for r in signals.support_replay(trades, bars).collect()}
    assert got
    pdf = bars.select("code", "date", "low", "high", "close").toPandas().sort_values(["code", "date"])
    by_code = {c: list(g[["date", "low", "high", "close"]].itertuples(index=False, name=None)) for c, g in pdf.groupby("code")}
    checked = 0
    for r in trades.select("code", "date", "entry_date").collect():
        rows = by_code[r["code"]]
        start = next(i for i, x in enumerate(rows) if x[0] == r["entry_date"])
        if start == len(rows) - 1:
            continue
        want = (rows[-1][0], "end_of_data", len(rows) - 1 - start)
        for i in range(start + 1, len(rows)):
            if i + 1 < 30:
                continue
            tail = rows[i - 9:i + 1]
            line = brute_line(tail, "low")
            if line is None:
                continue
            _, s, b = line
            hit = any((x[3] - (s * (x[0] - tail[0][0]).days + b)) < -0.05 * abs(s * (x[0] - tail[0][0]).days + b) for x in tail[-3:])
            if hit:
                want = (rows[i][0], "support_break", i - start)
                break
        assert got[(r["code"], r["date"])] == want
        checked += 1
    assert checked > 20


def test_support_monitor_agrees_with_the_line(market):
    from quantweave.operators import positions
    bars = market.bars()
    pos = positions.from_trades(signals.outcomes(signals.all_signals(bars), bars))
    got = {r["code"]: r for r in positions.support_monitor(pos, bars).collect()}
    dist = {r["code"]: r for r in structure.support_distance(bars).collect()}
    assert got
    for code, r in got.items():
        if code in dist:
            assert r["support_price"] == pytest.approx(dist[code]["support_price"], abs=6e-4)
            near = 100.0 if r["broken_support"] or r["close"] <= r["support_price"] else max(0.0, (0.1 - (r["close"] / r["support_price"] - 1)) * 1000)
            assert r["support_progress"] == pytest.approx(min(near, 100.0), abs=0.06)


def test_redundancy_removal_equals_plain_loop(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=500)
    pdf = pd.DataFrame({"a": a, "b": a + rng.normal(scale=0.01, size=500), "c": rng.normal(size=500), "d": -a, "y": a + rng.normal(size=500)})
    df = spark.createDataFrame(pdf)
    names = ["a", "b", "c", "d"]
    score = scoring.target_correlation(df, names, "y")
    kept = scoring.drop_redundant(scoring.correlation_pairs(df, names), score, names)
    sc = {n: abs(np.corrcoef(pdf[n], pdf["y"])[0, 1]) for n in names}
    # by hand: of the three that move together only the best scored stays, and no conflict is left
    best = max(["a", "b", "d"], key=lambda n: (round(sc[n], 12), -names.index(n)))
    assert kept == [n for n in names if n in (best, "c")]


def test_correlation_matrix_form_agrees(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(300, 41)), columns=[f"f{i}" for i in range(41)])
    df = spark.createDataFrame(pdf)
    got = {(r["f1"], r["f2"]): r["corr"] for r in scoring.correlation_pairs(df, list(pdf.columns)).collect()}
    want = np.corrcoef(pdf.to_numpy().T)
    assert len(got) == 41 * 40 / 2
    assert got[("f3", "f17")] == pytest.approx(want[3, 17])


def test_transform_pipeline_is_repeatable(market):
    df = t.ma_pair(t.bias(t.roc(t.base(fu.pit_series(market.bars(), reports(market))))), "volume", 5, "vol_ma")
    cols = ["roc", "bias", "vol_ma", "epsTTM", "totalShare", "roeAvg", "YOYPNI"]
    df = df.select("code", "date", *cols)
    one, two = features.transform_all(df, cols), features.transform_all(df, list(reversed(cols)))
    assert sorted(one.columns) == sorted(two.columns)
    assert one.count() == df.count()


def test_window_work_needs_no_shuffle_on_the_bucketed_bars(market):
    plan = t.window_block(t.base(market.bars()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_scan_reads_only_the_needed_columns(market):
    plan = t.roc(market.bars().select("code", "date", "close")).select("code", "date", "roc")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<code:string,date:date,close:double>" in plan


# --- one plan at every size, streams with corrections ------------------------

def test_pair_correlation_does_not_depend_on_other_features(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(900, 45)) + rng.normal(size=(900, 1)) + 1000
    x[rng.random(x.shape) < 0.2] = np.nan
    names = [f"f{i}" for i in range(45)]
    pdf = pd.DataFrame(x, columns=names)
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"{n} double" for n in names))
    want = pdf.corr()
    for part in (names[:5], names[:41], names):
        got = scoring.correlation_pairs(df, part).collect()
        assert len(got) == len(part) * (len(part) - 1) // 2
        assert max(abs(r["corr"] - want.loc[r["f1"], r["f2"]]) for r in got) < 1e-9


def test_time_split_keeps_all_rows(market):
    df = labels.labelled(market.bars())
    for share in (0.3, 1.0):
        out = labels.time_split(df, share)
        assert out.count() == df.count()
    assert out.where(~F.col("is_train")).count() == 0


def test_weight_grid_obeys_steps():
    assert len(scoring.simplex(4, 20)) == 1771 and len(scoring.simplex(2, 7)) == 8


def test_a_year_is_written_by_several_tasks(spark):
    import glob

    from quantweave.session import work_dir
    from quantweave.sources.upsert import upsert_table
    path, before = work_dir(spark, "one-year"), spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    rows = spark.range(0, 60_000, 1, 8).select(F.col("id").alias("code"), F.rand(1).alias("close"), F.lit(2001).alias("year"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        upsert_table(spark, path, rows, ["code"], "year")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(glob.glob(f"{path.removeprefix('file:')}/year=2001/*.parquet")) > 1 and spark.read.parquet(path).count() == 60_000


def corrected_feed(spark, market, label):
    """All bars in two loads, then late corrections of some old ones, then one load sent again."""
    from quantweave.streaming import jobs
    bars = market.bars().select("code", "date", "open", "high", "low", "close", "volume", "amount", "is_st")
    first, second = bars.where("date < DATE '1996-01-01'"), bars.where("date >= DATE '1996-01-01'")
    late = bars.where("date BETWEEN DATE '1994-06-01' AND DATE '1994-06-20'").withColumn("close", F.col("close") * 1.04)
    loads = [df.withColumn("load", F.lit(n)) for n, df in ((1, first), (1, second), (2, late), (1, first))]
    path, schema = jobs.inbox(spark, [df.coalesce(1) for df in loads], label)
    final = bars.join(late.select("code", "date", F.col("close").alias("_c")), ["code", "date"], "left").withColumn("close", F.coalesce("_c", "close")).drop("_c")
    return jobs.files(spark, path, schema, 1), final


def same_rows(a, b, keys):
    a, b = (x.toPandas().sort_values(keys).reset_index(drop=True) for x in (a, b.select(*a.columns)))
    assert len(a) == len(b)
    for c in a.columns:
        if c in keys:
            assert (a[c] == b[c]).all()
        else:
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, equal_nan=True), c


def test_streamed_breadth_follows_corrections(spark, market):
    from quantweave.operators import breadth
    from quantweave.streaming import jobs
    feed, final = corrected_feed(spark, market, "corrected-breadth")
    same_rows(jobs.breadth_by_date(spark, feed).select("date", *breadth.BREADTH), breadth.breadth(final), ["date"])


def test_streamed_alert_counts_each_bar_once(spark, market):
    from quantweave.functions.windows import lag
    from quantweave.streaming import jobs
    feed, final = corrected_feed(spark, market, "repeated-alert")
    previous = market.bars().select("code", "date", lag("close").alias("prev_close"))
    want = jobs.alert_counts(final.join(previous, ["code", "date"], "left"))
    same_rows(jobs.breadth_alert(spark, feed, previous).drop("year"), want, ["date"])


def test_late_ticks_change_their_bar_and_are_reported(spark):
    from quantweave.streaming import jobs
    t0 = dt.datetime(2024, 1, 1, 9)

    def tick(code, days, event, price, hours=0):
        return code, t0 + dt.timedelta(days=days, hours=hours), event, float(price)
    loads = [[tick("a", 0, 1, 10), tick("a", 0, 2, 12, 1), tick("b", 0, 3, 5)], [tick("a", 5, 4, 20), tick("a", 4, 5, 19, 20)],
             [tick("a", 0, 6, 99, -1), tick("a", 5, 7, 21, 1), tick("b", 1, 8, 6)]]
    kind = "code string, ts timestamp, event_id long, price double"
    frames = [spark.createDataFrame(x, kind).coalesce(1) for x in loads]
    path, schema = jobs.inbox(spark, frames, "ticks")
    bars, late = jobs.tick_bars(spark, jobs.files(spark, path, schema, 1))
    got = {(r["code"], str(r["date"])): (r["open"], r["high"], r["low"], r["close"], r["ticks"]) for r in bars.collect()}
    assert got == {("a", "2024-01-01"): (99, 99, 10, 12, 3), ("b", "2024-01-01"): (5, 5, 5, 5, 1), ("b", "2024-01-02"): (6, 6, 6, 6, 1),
                   ("a", "2024-01-06"): (19, 21, 19, 21, 3)}
    assert sorted(r["event_id"] for r in late.collect()) == [6, 8] and {r["batch"] for r in late.collect()} == {2}


def test_stateful_streams_take_shuffled_and_repeated_bars(spark, market):
    from quantweave.streaming import jobs
    bars = market.bars().select("code", "date", "high", "low", "close").where("date < DATE '1997-01-01'")
    week = F.floor(F.datediff("date", F.lit(D(1995, 1, 1))) / 100)
    loads = [bars.where(week == i).unionByName(bars.where((week == i - 1) & (F.pmod(F.datediff("date", F.lit(D(1995, 1, 1))), F.lit(100)) >= 79))) for i in range(8)]  # the last weeks come again
    path, schema = jobs.inbox(spark, [*[x.coalesce(1) for x in loads], jobs.closing_row(bars)], "again")
    got = jobs.stochastic(spark, jobs.files(spark, path, schema, 1), 28).select("code", "date", F.round("kdj_k", 8).alias("k"), F.round("kdj_d", 8).alias("d"))
    path, schema = jobs.inbox(spark, [bars.coalesce(1), jobs.closing_row(bars)], "once")
    want = jobs.stochastic(spark, jobs.files(spark, path, schema, 1), 28).select("code", "date", F.round("kdj_k", 8).alias("k"), F.round("kdj_d", 8).alias("d"))
    assert got.count() == bars.count() and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_runs_of_a_sorted_partition_in_any_batches(size):
    """Counts inside a task do not depend on where the Arrow batches end, for hot values and groups too."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 900), "v": np.where(rng.random(900) < 0.5, 3, rng.integers(0, 40, 900))}).sort_values(["g", "v"], ignore_index=True)
    batch = pa.RecordBatch.from_pandas(pdf.assign(_g1=pdf.g, _g2=pdf.g, _v1=100 * pdf.g + pdf.v, _v2=pdf.v)[["_g1", "_g2", "_v1", "_v2", "g", "v"]], preserve_index=False)
    got = pa.Table.from_batches(ranks._in_runs()(batch.slice(i, size) for i in range(0, 900, size))).to_pandas()
    assert (got.v == pdf.v).all() and (got._cnt == pdf.groupby(["g", "v"])["v"].transform("size")).all()
    assert (got._before == pdf.groupby("g")["v"].rank(method="min").astype(int) - 1).all()
    runs = 100 * got.g + got.v
    assert (got._edge == runs.isin([runs.iloc[0], runs.iloc[-1]])).all()


def test_ranks_deal_rows_once(spark, skewed, monkeypatch):
    """Rows are written, dealt and written again, whatever is ranked: no join brings ranks back to their rows, and
    a value that many tasks share is ranked as one."""
    from quantweave.operators import scoring as sc
    pdf, df = skewed
    written, real = [], ranks.staged
    monkeypatch.setattr(ranks, "staged", lambda d, label: written.append(label) or real(d, label))
    monkeypatch.setattr(sc, "staged", ranks.staged)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranks.avg_rank(df, ["g"], "v", "r", "n", few_groups=True)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = out.toPandas().sort_values("id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert written == ["rows", "dealt"] and "SortMergeJoin" not in plan
    assert np.allclose(got["r"].astype(float), pdf.groupby("g")["v"].rank(method="average"), equal_nan=True)
    assert (got["n"].to_numpy() == pdf.groupby("g")["v"].transform("count").to_numpy()).all()
    written.clear()
    pairs = df.select("g", F.col("v").alias("p"), (-F.col("v")).alias("r"))
    assert all(abs(r["rank_ic"] + 1) < 1e-12 for r in sc.daily_rank_ic(pairs, "p", "r", ["g"]).collect())
    assert written == ["pairs", "dealt", "dealt"]


def test_model_frame_and_candidates_read_the_bars_once(market):
    """Scores, labels and candidates come from one pass over the bars, with no join of bars to bars."""
    from quantweave.catalog import scoring as sq
    plan = sq.candidates(market)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
    frame = sq.build_frame(market)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in frame


def test_exit_monitor_starts_from_positions_of_bucketed_tables(spark):
    """Buckets and shuffle partitions differ in number and nothing is broadcast, as in a stream on a cluster."""
    from quantweave.streaming import jobs
    rng, path = np.random.default_rng(5), work_dir(spark, "monitor-bars")
    rows = []
    for k in range(6):
        close = 20 + np.cumsum(rng.integers(-40, 44, 90)) / 128
        for i, c in enumerate(close.tolist()):
            rows.append((f"60000{k}", dt.date(2020, 1, 6) + dt.timedelta(days=7 * i), c, c + 0.25, c - 0.25, c, float(rng.integers(1, 9)), 100.0 * c, 0))
    df = spark.createDataFrame(rows, "code string, date date, open double, high double, low double, close double, volume double, amount double, is_st int")
    df.write.bucketBy(8, "code").option("path", path).saveAsTable("monitor_bars")
    bars = spark.table("monitor_bars")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "3"}
    before = {c: spark.conf.get(c) for c in changed}
    try:
        for c, v in changed.items():
            spark.conf.set(c, v)
        narrow = bars.select("code", "date", "high", "low", "close")
        loads = [narrow.where("date < DATE '2020-10-01'"), narrow.where("date >= DATE '2020-10-01'")]
        folder, schema = jobs.inbox(spark, [*[x.coalesce(1) for x in loads], jobs.closing_row(narrow)], "monitor")
        got = jobs.exit_monitor(spark, jobs.files(spark, folder, schema, 1), signals.entries(signals.all_signals(bars), bars))
        want = signals.outcomes(signals.all_signals(bars), bars, time_stop=True).where("exit_date IS NOT NULL").withColumnRenamed("date", "signal_date")
        cols = ["strategy", "code", "signal_date", "exit_date", "exit_price", "exit_reason", "holding_days"]
        got, want = (sorted(tuple(r) for r in x.select(*cols).collect()) for x in (got, want))
        assert got == want and len(got) > 5
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        spark.sql("DROP TABLE monitor_bars")


def test_streamed_bars_are_rewritten_once_for_each_doubling(spark, monkeypatch):
    """Sixteen batches of new keys and of keys sent before; the highest load wins, of equal loads the last batch."""
    from quantweave.streaming import jobs
    frames, want = [], {}
    for i in range(16):
        load = 1 if i % 5 else 3
        rows = [(f"c{i}", dt.date(2000, 1, 3), float(i), load), (f"c{i // 2}", dt.date(2001, 1, 1), float(100 + i), load), ("hot", dt.date(2000, 1, 3), float(i), load)]
        for code, date, close, load in rows:
            if load >= want.get((code, date), (0, 0.0))[0]:
                want[code, date] = (load, close)
        frames.append(spark.createDataFrame(rows, "code string, date date, close double, load int").coalesce(1))
    merges, merge = [], jobs.upsert_table
    monkeypatch.setattr(jobs, "upsert_table", lambda *a: (merges.append(1), merge(*a)))
    path, schema = jobs.inbox(spark, frames, "doubling")
    # files of a folder come in the order of their times, which may be equal, so every load has a file time of its own
    import glob
    import os
    for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        first = spark.read.parquet(f).where("code <> 'hot' AND date = DATE '2000-01-03'").first()["close"]
        os.utime(f, (1e9 + 10 * first, 1e9 + 10 * first))
    got = jobs.bar_upsert(spark, jobs.files(spark, path, schema, 1))
    assert got.columns == ["code", "date", "close", "load", "year"]
    assert {(r["code"], r["date"]): (r["load"], r["close"]) for r in got.collect()} == want
    assert len(merges) <= 6


class Kept:
    """A value state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_stream_state_is_one_value(monkeypatch):
    """The calls to the state of an instrument do not grow with its bars or positions."""
    from types import SimpleNamespace

    from quantweave.streaming import processors
    calls, timers = [], []
    handle = SimpleNamespace(getValueState=lambda *a: Kept(calls), registerTimer=timers.append)
    p = processors.ExitMonitor(5, 0.01)
    p.init(handle)
    start = pd.DataFrame([("s", i, 100 + i, 20.0, 19.0, 20.0 + i) for i in range(40)], columns=["strategy", "signal_day", "entry_day", "price", "stop", "target"])
    p.handleInitialState(("x",), start.iloc[:30], None)
    p.handleInitialState(("x",), start.iloc[30:], None)
    assert len(calls) == 4 and len(p.positions()) == 40
    calls.clear()
    bars = pd.DataFrame([(d, 20.5, 19.5, 20.0) for d in (150, 100, 120, 100)], columns=["day", "high", "low", "close"])
    list(p.handleInputRows(("x",), iter([bars.iloc[:2], bars.iloc[2:]]), None))
    list(p.handleInputRows(("x",), iter([pd.DataFrame([(120, 21.5, 19.5, 20.7)], columns=list(bars))]), None))
    assert calls == ["get", "update"] * 2 and timers == [100 * processors.DAY, 120 * processors.DAY]
    calls.clear()
    out = pd.concat(p.handleExpiredTimer(("x",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 120 * processors.DAY), None))
    assert len(calls) == 4 and timers[-1] == 150 * processors.DAY
    # the bar of day 120 that came last reaches the targets up to 21.5 of what was entered before it
    assert out[["signal_day", "exit_day", "exit_price", "exit_reason", "holding_days"]].values.tolist() == [[0, 120, 20.7, "take_profit", 1], [1, 120, 20.7, "take_profit", 1]]
    assert len(p.positions()) == 38 and {r[6] for r in p.positions()} == {0, 1}
