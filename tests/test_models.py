"""Wide block ranks, and models on planted signals."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantweave.functions.blockrank import block_ranks, block_shares
from quantweave.operators import labels, scoring
from quantweave.plans import training as tr

NAMES = ["n0", "n1", "signal", "n3", "weak", "n5"]


@pytest.mark.parametrize("block", [8192, 150])
def test_block_ranks_equal_pandas(spark, block):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": range(4000), "g": rng.choice(["hot", "hot", "hot", "a", "b"], 4000), "h": rng.choice([1, 2], 4000),
                        "x": np.where(rng.random(4000) < .5, 0.0, rng.normal(size=4000).round(2)), "y": rng.normal(size=4000), "z": 7.0})
    pdf.loc[rng.random(4000) < .1, "x"] = np.nan
    pdf.loc[pdf.g == "b", "y"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "id long, g string, h long, x double, y double, z double")
    got = block_ranks(df, ["g", "h"], ["x", "y", "z"], block).toPandas().sort_values("id")
    for c in "xyz":
        assert np.allclose(got[f"_rank_{c}"].astype(float), pdf.groupby(["g", "h"])[c].rank(), equal_nan=True), c
        assert (got[f"_rank_{c}_n"].to_numpy() == pdf.groupby(["g", "h"])[c].transform("count").to_numpy()).all()
    assert (got["_rows"].to_numpy() == pdf.groupby(["g", "h"])["id"].transform("count").to_numpy()).all()


def test_block_ranks_of_copies_and_nothing(spark):
    df = spark.createDataFrame([(1, 5.0)] * 500 + [(1, None), (2, float("nan"))], "g long, x double")
    got = block_ranks(df, ["g"], ["x"], 64).groupBy("g", "x", "_rank_x", "_rank_x_n", "_rows").count().collect()
    assert {(r["g"], r["_rank_x"], r["_rank_x_n"], r["_rows"], r["count"]) for r in got} == {(1, 250.5, 500, 501, 500), (1, None, 500, 501, 1), (2, None, 0, 1, 1)}
    assert block_ranks(df.limit(0), ["g"], ["x"]).count() == 0
    plan = block_ranks(df, ["g"], ["x"])._jdf.queryExecution().toString()
    assert "Expand" not in plan and "Generate" not in plan


@pytest.fixture(scope="module")
def planted(spark):
    """60 dates of 50 rows; the label follows one feature and a little of another."""
    rng = np.random.default_rng(3)
    rows = []
    for day in range(60):
        x = rng.integers(0, tr.BINS, (50, len(NAMES)))
        label = np.clip(0.1 + 0.7 * x[:, 2] / 31 + 0.1 * x[:, 4] / 31 + rng.normal(0, .05, 50), 0, 1)
        rows += [(f"c{i}", dt.date(2020, 1, 1) + dt.timedelta(7 * day), float(v), float(round(v * 149) / 149), 1.0, day < 42, [int(k) for k in b])
                 for i, (v, b) in enumerate(zip(label, x, strict=True))]
    return tr.staged(spark.createDataFrame(rows, "code string, date date, label double, grade double, weight double, is_train boolean, bins array<tinyint>"), "planted")


def test_models_find_the_planted_signal(planted):
    later = planted.where("NOT is_train")
    for kind in tr.KINDS:
        model = tr.fit_trees(planted, NAMES, NAMES, kind, rounds=6, depth=3)
        score = {r["feature"]: r["score"] for r in tr.importance(model, NAMES, planted.sparkSession).collect()}
        assert max(score, key=score.get) == "signal"
        assert scoring.rank_ic_summary(tr.predict(model, later, "prob", NAMES, NAMES), "prob", "label").first()["rank_ic"] > 0.9
    assert tr.eliminate(planted, NAMES, 1, features=NAMES) == ["signal"]
    assert set(tr.eliminate(planted, NAMES, 2, features=NAMES)) == {"signal", "weak"}


def test_no_row_is_scored_by_a_model_that_saw_it(planted):
    train = planted.where("is_train")
    days = sorted(tr.folds(train).collect(), key=lambda r: r["date"])
    assert [r["fold"] for r in days] == [0] * 14 + [1] * 14 + [2] * 14
    for i, r in enumerate(days):
        for k in range(3):
            near = [abs(i - j) for j, x in enumerate(days) if x["fold"] == k]
            assert (k in r["apart"]) == (min(near) > labels.HORIZON)
    past = tr.out_of_fold(train, {"a": NAMES, "b": NAMES[:2]}, NAMES, rounds=3)
    assert past.count() == train.count()
    got = scoring.rank_ic_summary(past, "a", "label").first()["rank_ic"], scoring.rank_ic_summary(past, "b", "label").first()["rank_ic"]
    assert got[0] > 0.8 and abs(got[1]) < 0.15  # the second model has noise alone, and has not seen its rows
    later = tr.stack(past, past.where("date > '2020-06-01'"), ["a", "b"])
    assert scoring.auc(later, "stacked", "label").first()["auc"] > 0.9
    assert later.where(F.col("stacked").isNull()).count() == 0


def test_quality_of_many_frames_takes_the_passes_of_one(spark, monkeypatch):
    from quantweave.functions import ranks
    rng, rows = np.random.default_rng(8), []
    for model in ("a", "b"):
        for part in ("x", "y"):
            for day in range(6):
                for i in range(4 if (part, day) == ("y", 5) else 20):
                    rows.append((model, part, f"c{i}", dt.date(2020, 1, 6 + day), round(rng.random(), 1) if rng.random() > .05 else None, round(rng.random(), 2)))
    df = tr.staged(spark.createDataFrame(rows, "model string, part string, code string, date date, prob double, label double"), "many")
    written, write = [], tr.staged

    def count(d, label):
        written.append(label)
        return write(d, label)
    for module in (tr, ranks, scoring):
        monkeypatch.setattr(module, "staged", count)
    cols = ["rank_ic", "rank_ic_std", "n_dates", "auc", "top1_precision", "top5_precision"]
    got = {(r["model"], r["part"]): [r[c] for c in cols] for r in tr.quality(df, keys=["model", "part"]).collect()}
    many = len(written)
    assert len(got) == 4
    for (model, part), values in got.items():
        del written[:]
        one = tr.quality(df.where((F.col("model") == model) & (F.col("part") == part))).first()
        assert len(written) == many
        assert np.allclose(values, [one[c] for c in cols], rtol=1e-12)


def test_all_features_in_order_make_the_same_vector(planted):
    one, other = (planted.select(v.alias("v")) for v in (tr.vector(NAMES, NAMES), tr.vector([*NAMES, "more"], NAMES)))
    assert [r["v"] for r in one.collect()] == [r["v"] for r in other.collect()]
    assert "transform" not in one._jdf.queryExecution().toString()


@pytest.mark.parametrize("limit", [100, 10_000])
def test_block_shares_of_cut_groups(spark, limit):
    """Groups above and below the limit, a hot value, nulls, NaN, a lone row, and a group without values, in many partitions and blocks."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"id": range(1500), "g": rng.choice(["hot", "hot", "hot", "a", "b"], 1500), "x": np.where(rng.random(1500) < .6, 3.0, rng.normal(size=1500)), "y": rng.normal(size=1500)})
    pdf.loc[rng.random(1500) < .1, "x"] = np.nan
    pdf.loc[pdf.g == "b", "y"] = np.nan
    rows = [tuple(r) for r in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False)]
    df = spark.createDataFrame([*rows, (1500, None, None, 5.0), (1501, "a", float("nan"), None)], "id long, g string, x double, y double").repartition(5)
    both = pd.concat([pdf, pd.DataFrame({"id": [1501], "g": ["a"], "x": [np.nan], "y": [np.nan]})])
    for plus_one in (True, False):
        got = block_shares(df, ["g"], ["x", "y"], plus_one, 0.5, 70, limit).toPandas().set_index("id").sort_index()
        assert list(got.columns) == ["g", "x", "y"] and len(got) == 1502
        one = got.loc[1500]
        assert (one["y"] == (5.0 if plus_one else 1.0)) and (np.isnan(one["x"]) if plus_one else one["x"] == 0.5)
        for c in "xy":
            over = both.groupby("g")["id"].transform("count") + 1 if plus_one else both.groupby("g")[c].transform("count")
            want = (both.groupby("g")[c].rank() / over).fillna(0.5).to_numpy()
            assert np.allclose(got.drop(1500)[c], want), (c, plus_one)
    ranks = block_ranks(df, ["g"], ["x"], 70, limit).toPandas().set_index("id").sort_index().drop(1500)
    assert np.allclose(ranks["_rank_x"], both.groupby("g")["x"].rank(), equal_nan=True) and (ranks["_rows"].to_numpy() == both.groupby("g")["id"].transform("count").to_numpy()).all()


def test_block_shares_move_values_once(spark):
    """Nothing is joined, and the values pass through one exchange, their ranks through another."""
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    plan = labels.cross_rank(df, ["x", "y"], keys=["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_frames_of_models_equal_the_block(spark, market):
    """The labelled and the wanted frame hold the rows and values of the stored block that they replace; only narrow rows are moved."""
    from quantweave.catalog.joins import reports
    from quantweave.plans import factor_block as fb
    bars, factors, rep = market.bars(), market.adjust_factor(), reports(market)
    block = tr.staged(tr.known(fb.base_factors(bars, factors, rep)), "block")
    want = labels.path_label(block)
    got = tr.labelled_frame(bars, factors, rep)
    assert set(got.columns) == set(want.columns)
    a, b = (x.select(*sorted(want.columns)).toPandas().sort_values(["code", "date"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
    wanted = bars.where(F.dayofmonth("date") < 4)
    got = tr.factor_frame(bars, factors, rep, wanted).toPandas()
    want = block.join(wanted.select("code", "date"), ["code", "date"]).select(*got.columns).toPandas()
    a, b = (x.sort_values(["code", "date"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
    plan = tr.labelled_frame(bars, factors, rep)._jdf.queryExecution().executedPlan().toString().split("\n")
    last = max(i for i, line in enumerate(plan) if "ArrowEvalPython" in line)
    assert not [line for line in plan[:last] if "Exchange" in line or "Join" in line]


def test_target_correlation_equals_numpy(spark):
    """Nulls, a constant, a column without values, NaN, large means, more partitions than rows of some; many features make no aggregates of their own."""
    rng = np.random.default_rng(11)
    n = 400
    x = {"plain": rng.normal(size=n), "far": 1e6 + rng.normal(size=n), "flat": np.full(n, 0.1), "holes": np.where(rng.random(n) < .5, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)}
    y = np.where(rng.random(n) < .1, np.nan, x["plain"] + 0.5 * np.nan_to_num(x["far"] - 1e6) + rng.normal(size=n))
    pdf = pd.DataFrame({**x, "y": y}).astype(object)
    rows = [tuple(r) for r in pdf.where(pdf.notna(), None).itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf)).repartition(50).withColumn("odd", F.when(F.rand(1) < 0.1, float("nan")).otherwise(F.col("plain")))
    got = {r["feature"]: r["score"] for r in scoring.target_correlation(df, [*x, "odd"], "y").collect()}
    both = {c: ~np.isnan(v) & ~np.isnan(y) for c, v in x.items()}
    for c in ("plain", "far", "holes"):
        assert abs(got[c] - abs(np.corrcoef(x[c][both[c]], y[both[c]])[0, 1])) < 1e-9, c
    assert got["flat"] == got["none"] == 0.0 and np.isnan(got["odd"]) and len(got) == 6
    wide = spark.range(50).select(*[F.rand(i).alias(f"c{i}") for i in range(129)], F.rand(200).alias("y"))
    plan = scoring.target_correlation(wide, wide.columns[:-1], "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("covar") + plan.count("stddev") + plan.count("partial_min") < 10


def test_fits_of_a_fold_run_side_by_side(planted, monkeypatch):
    import threading
    import time
    lock, now, most = threading.Lock(), [0], [0]
    fit = tr.fit_trees

    def watched(*args, **kw):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.5)
        try:
            return fit(*args, **kw)
        finally:
            with lock:
                now[0] -= 1
    monkeypatch.setattr(tr, "fit_trees", watched)
    scores = tr.out_of_fold(planted, {"all": NAMES, "few": NAMES[2:4]}, NAMES, rounds=2)
    assert most[0] == 2 and scores.count() == planted.count()
