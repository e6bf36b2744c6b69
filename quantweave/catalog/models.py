"""Model rows: S04-S06, S20-S22, S25, S26, S30, S31, A28."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Window
from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.joins import reports
from quantweave.catalog.scoring import FEATS, PAIRS, TC, frame
from quantweave.operators import filters, labels as lb, scoring as sc
from quantweave.operators import technical as t
from quantweave.operators.recursive import recursive
from quantweave.plans import screen, training as tr
from quantweave.session import work_dir

CRITERIA = filters.Criteria(max_price=22.0, markets=("sh_main", "sz_main", "sz_gem", "star"))


def wilder_levels(bars):
    return recursive(bars, ["atr"]).select("code", "date", F.col("atr_abs").alias("atr"))


def simple_levels(bars):
    return t.simple_atr(t.base(bars), 30, "atr").select("code", "date", "atr")


def signals(m, since=None, levels=wilder_levels, **kw):
    model = tr.archive(m, reports(m))[0]["regression"]
    bars = m.bars()
    info = screen.pit_info(bars, m.profit_ability(), m.balance_ability())
    if since == "last":
        info = info.join(F.broadcast(bars.agg(F.max("date").alias("date"))), "date", "left_semi")
    passed = filters.funnel(info, CRITERIA, cap_gate=False).where(F.col("reject_reason").isNull())
    factors = tr.factor_frame(bars, m.adjust_factor(), reports(m), passed)
    return screen.model_signals(factors, info, levels(bars), model, tr.FEATURES, CRITERIA, **kw)


COLS = "date code place confidence:4 current_price signal stop_loss:4 take_profit:4"
q("s04_model_signals", COLS)(lambda m: signals(m, n=5))
q("s05_screening_run", COLS + " code_name pe_ratio:8 market_cap:8")(
    lambda m: signals(m, "last", n=20).join(m.stock_basic().select("code", "code_name"), "code", "left"))
q("s06_batch_screen", COLS)(lambda m: signals(m, "last", simple_levels, n=50, stop_mult=1.5, target_mult=3.0))
q("s31_order_signals", COLS)(lambda m: signals(m, "last", n=10).where("signal = 'buy' OR place <= 3"))


def both(m, of=None):
    """Models of both kinds, and the training or the later rows."""
    models, data = tr.archive(m, reports(m))
    return models, data if of is None else data.where("is_train" if of == "train" else "NOT is_train")


Q = " rank_ic:4 rank_ic_std:4 n_dates auc:4 top1_precision:4 top5_precision:4"


def train_quality(m):
    models, data = both(m)
    return tr.compare(models, data.withColumn("split", F.when(F.col("is_train"), "train").otherwise("validation")), ["split"])


q("s21_train_model", "split model" + Q)(train_quality)
q("s29_trained_comparison", "model place" + Q)(
    lambda m: tr.compare(*both(m, "validation")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_ic"), "model"))))
q("s22_feature_importance", "model feature score:6")(lambda m: (lambda models: tr.importance(models["regression"], tr.FEATURES, m.spark).withColumn("model", F.lit("regression")).unionByName(
    tr.importance(models["ranking"], tr.FEATURES, m.spark).withColumn("model", F.lit("ranking"))))(both(m)[0]))


def stacked(m):
    scores = tr.staged(lb.time_split(frame(m)).select("code", "date", "p1", "p2", "p3", "label", "is_train"), "scores")
    return tr.stack(scores.where("is_train"), scores.where("NOT is_train"), ["p1", "p2", "p3"])


q("s20_stacking", "code date stacked:5")(stacked)


def kept(m):
    f = frame(m)
    names = sc.drop_redundant(sc.correlation_pairs(f, FEATS), sc.target_correlation(f, FEATS, "f_return"), FEATS)
    return sc.target_correlation(f, FEATS, "f_return").where(F.col("feature").isin(names))


# The greedy pass in score order: a feature stays unless it correlates with one that stays.
SWEEP = f"""/*rec*/ ranked_f AS (SELECT feature, score, ROW_NUMBER() OVER (ORDER BY score DESC) AS place FROM ({TC}) AS t WHERE score IS NOT NULL),
strong AS (SELECT f1 AS a, f2 AS z FROM ({PAIRS}) AS p WHERE ABS(corr) > 0.95 UNION ALL SELECT f2, f1 FROM ({PAIRS}) AS p WHERE ABS(corr) > 0.95),
foes AS (SELECT r.place, r.feature, COALESCE(LIST(s.z) FILTER (s.z IS NOT NULL), []) AS foes FROM ranked_f r LEFT JOIN strong s ON s.a = r.feature GROUP BY ALL),
sweep_f AS (SELECT 0::BIGINT AS place, []::VARCHAR[] AS kept UNION ALL SELECT f.place, CASE WHEN list_has_any(s.kept, f.foes) THEN s.kept ELSE list_append(s.kept, f.feature) END
  FROM sweep_f s JOIN foes f ON f.place = s.place + 1)"""
q("s25_redundancy_removal", "feature score:6", "SELECT feature, score FROM ranked_f WHERE list_contains((SELECT kept FROM sweep_f ORDER BY place DESC LIMIT 1), feature)", "mf", SWEEP)(kept)
q("s26_recursive_elimination", "feature score:6")(
    lambda m: (lambda data: (lambda names: sc.target_correlation(tr.ranked_columns(data, names), names, "label"))(tr.eliminate(data, tr.FEATURES, 8)))(both(m)[1]))
q("s30_optimisation", "stage auc:4 n_features")(lambda m: (lambda models, data: tr.optimise(data, tr.FEATURES, models["regression"]))(*both(m)))


def reload(m):
    models, data = both(m)
    path = work_dir(m.spark, "model-copy")
    models["regression"].write().overwrite().save(path)
    again = GBTRegressionModel.load(path)
    pair = tr.predict(again, tr.predict(models["regression"], data, "a"), "b")
    return pair.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_diff"))


# The reloaded model must give the same prediction on every labelled row.
q("a28_model_archive", "n max_diff:9", "SELECT COUNT(*) - 5 * COUNT(DISTINCT code) AS n, CAST(0 AS DOUBLE) AS max_diff FROM bars")(reload)
