"""Model-quality and scoring rows: D09-D16, D24-D26, D35-D37, S17-S19, S23-S24, S27-S29, C24, I02-I04, I06."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.labels import SPLIT, avg_rank, labelled
from quantweave.catalog.sqlkit import W, cte, g, lagx
from quantweave.operators import labels as lb, scoring as sc
from quantweave.operators import technical as t
from quantweave.plans import screen

CD = "code date "


def frame(m):
    return m.bucketed("model_frame", lambda: build_frame(m))


def build_frame(m):
    """Three model scores, soft label, forward return and the time split."""
    # Scores and labels come from one pass over the bars; only what the frame needs is ranked.
    df = labelled(m, t.willr(t.psy(t.bias(t.base(m.bars()))))).select(
        "code", "date", "limit_threshold", "unbuyable", "label_raw", "f_return", "bias", "psy", "willr", F.round(sc.sigmoid(F.col("bias")), 9).alias("p1"), F.round(F.col("psy") / 100, 9).alias("p2"),
        F.round(sc.clip01(F.coalesce(1 + F.col("willr") / 100, F.lit(0.5))), 9).alias("p3"))
    # Rows without an instrument take part in the ranks only.
    return lb.penalise(lb.board_rank(df)).dropna(subset=["code", "date"]).withColumn("label", F.round("label", 9)).select(
        "code", "date", "bias", "psy", "willr", "p1", "p2", "p3", "f_return", "label")


def split(m):
    return lb.time_split(frame(m))


cte("mf", f"""SELECT f.*, r.f_return, ROUND(CASE WHEN r.unbuyable = 1 THEN 0.05 ELSE r.label END, 9) AS label, f.date < s.d AS is_train FROM (
  SELECT code, date, bias, psy, willr, ROUND(1 / (1 + EXP(-bias)), 9) AS p1, ROUND(psy / 100, 9) AS p2, ROUND(LEAST(GREATEST(COALESCE(1 + willr / 100, 0.5), 0), 1), 9) AS p3 FROM (
   SELECT code, date, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias, COALESCE({g('SUM', 'CASE WHEN d > 0 THEN 1 ELSE 0 END', 30)} / 30.0 * 100, 0) AS psy,
     CASE WHEN rn >= 35 THEN COALESCE(-100 * ({g('MAX', 'high', 35)} - close) / NULLIF({g('MAX', 'high', 35)} - {g('MIN', 'low', 35)}, 0), 0) END AS willr FROM b) AS x) AS f
  JOIN ranked r ON r.code = f.code AND r.date = f.date CROSS JOIN (SELECT date AS d FROM {SPLIT} AS y) AS s""", "b ranked labr")
cte("ric", f"""SELECT date, COUNT(*) AS n, CORR(a, z) AS rank_ic FROM (SELECT date, {avg_rank('p1', 'date')} AS a, {avg_rank('label', 'date')} AS z FROM mf) AS x
  GROUP BY date HAVING COUNT(*) >= 10 AND STDDEV_POP(a) > 0 AND STDDEV_POP(z) > 0""", "mf")
q("d09_daily_rank_ic", "date n rank_ic:6", "SELECT * FROM ric", "ric")(lambda m: sc.daily_rank_ic(frame(m), "p1", "label"))
q("d10_rank_ic_summary", "rank_ic:6 rank_ic_std:6 n_dates", "SELECT AVG(rank_ic) AS rank_ic, STDDEV_POP(rank_ic) AS rank_ic_std, COUNT(*) AS n_dates FROM ric", "ric")(
    lambda m: sc.rank_ic_summary(frame(m), "p1", "label"))


def top_sql(top, qq):
    return f"""SELECT date, AVG(CASE WHEN label >= cut - 1e-12 THEN 1 ELSE 0 END) AS precision FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY p1 DESC, code) AS k,
  QUANTILE_CONT(label, {qq}) OVER (PARTITION BY date) AS cut, COUNT(*) OVER (PARTITION BY date) AS n FROM mf) AS x WHERE k <= {top} AND n >= 10 GROUP BY date"""


q("d11_top1_precision", "date precision:6", top_sql(1, 0.95), "mf")(lambda m: sc.top_precision(frame(m), "p1", "label", 1, 0.95))
q("d12_top5_precision", "date precision:6", top_sql(5, 0.80), "mf")(lambda m: sc.top_precision(frame(m), "p1", "label", 5, 0.80))
q("d13_classification", "accuracy:6 precision:6 recall:6 f1:6", """SELECT (tp + tn) * 1.0 / n AS accuracy, tp * 1.0 / (tp + fp) AS precision, tp * 1.0 / (tp + fn) AS recall,
  2.0 * tp / (2 * tp + fp + fn) AS f1 FROM (SELECT COUNT(*) AS n, COUNT(CASE WHEN label >= 0.5 AND p1 >= 0.5 THEN 1 END) AS tp, COUNT(CASE WHEN label < 0.5 AND p1 >= 0.5 THEN 1 END) AS fp,
  COUNT(CASE WHEN label >= 0.5 AND p1 < 0.5 THEN 1 END) AS fn, COUNT(CASE WHEN label < 0.5 AND p1 < 0.5 THEN 1 END) AS tn FROM mf) AS x""", "mf")(
    lambda m: sc.classification(frame(m), "p1", "label"))


def auc_sql(score, src="mf", part=None):
    sel, over = (f"{part}, ", f"PARTITION BY {part} ") if part else ("", "")
    cnt = f"PARTITION BY {part}, {score}" if part else f"PARTITION BY {score}"
    return f"""SELECT {sel}(SUM(CASE WHEN label >= 0.5 THEN r END) - np * (np + 1) / 2.0) / (np * (n - np)) AS auc FROM (SELECT *, RANK() OVER ({over}ORDER BY {score}) + (COUNT(*) OVER ({cnt}) - 1) / 2.0 AS r,
  COUNT(CASE WHEN label >= 0.5 THEN 1 END) OVER ({over}) AS np, COUNT(*) OVER ({over}) AS n FROM {src}) AS x GROUP BY {sel}np, n"""


q("d14_auc", "auc:8", auc_sql("p1"), "mf")(lambda m: sc.auc(frame(m), "p1", "label"))
q("d15_dispersion", "prob_std:6 n_unique", "SELECT STDDEV_POP(p1) AS prob_std, COUNT(DISTINCT ROUND(p1, 6)) AS n_unique FROM mf", "mf")(lambda m: sc.dispersion(frame(m), "p1"))
q("s17_ensemble", CD + "score:6", "SELECT code, date, (p1 * 2 + p2 * 1 + p3 * 1) / 4 AS score FROM mf", "mf")(
    lambda m: frame(m).withColumn("score", sc.ensemble(["p1", "p2", "p3"], [2, 1, 1])))
q("s18_score_transforms", CD + "ranker:6 regressor:6", "SELECT code, date, 1 / (1 + EXP(-bias)) AS ranker, LEAST(GREATEST(bias, 0), 1) AS regressor FROM mf", "mf")(
    lambda m: frame(m).withColumns({"ranker": sc.sigmoid(F.col("bias")), "regressor": sc.clip01(F.col("bias"))}))
MIX = """mix AS MATERIALIZED (SELECT w.i AS weight_id, ROUND(p1 * (w.i / 20.0::DOUBLE) + p2 * ((20 - w.i) / 20.0::DOUBLE), 9) AS s, label FROM mf CROSS JOIN (SELECT UNNEST(RANGE(0, 21)) AS i) AS w)"""
q("c24_weights_by_prediction", "weight_id n mean_score:6", "SELECT weight_id, COUNT(*) AS n, AVG(s) AS mean_score FROM mix GROUP BY weight_id", "mf", MIX)(
    lambda m: frame(m).select("p1", "p2", F.explode(F.array(*[F.struct(F.lit(i).alias("weight_id"), F.lit(w[0]).alias("a"), F.lit(w[1]).alias("b"))
                                                              for i, w in enumerate(sc.simplex(2))])).alias("w")).groupBy("w.weight_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.round(F.col("p1") * F.col("w.a") + F.col("p2") * F.col("w.b"), 9)).alias("mean_score")))
q("s19_weight_search", "weight_id auc:8", auc_sql("s", "mix", "weight_id"), "mf", MIX)(lambda m: sc.weight_search(frame(m), ["p1", "p2"], "label"))
q("s19_best_weights", "weight_id auc:8", "SELECT * FROM (" + auc_sql("s", "mix", "weight_id") + ") AS z ORDER BY ROUND(auc, 12) DESC, weight_id LIMIT 1", "mf", MIX)(
    lambda m: sc.best_weights(frame(m), ["p1", "p2"], "label"))
FEATS = ["bias", "psy", "p1", "p2", "p3"]
TC = " UNION ALL ".join(f"SELECT '{f}' AS feature, ABS(CORR({f}, f_return)) AS score FROM mf" for f in FEATS)
q("d24_target_correlation", "feature score:6", TC, "mf")(lambda m: sc.target_correlation(frame(m), FEATS, "f_return"))
PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS f1, '{z}' AS f2, CORR({a}, {z}) AS corr FROM mf" for i, a in enumerate(FEATS) for z in FEATS[i + 1:])
q("d25_feature_correlation", "f1 f2 corr:6", PAIRS, "mf")(lambda m: sc.correlation_pairs(frame(m), FEATS))
MI = " UNION ALL ".join(f"SELECT '{f}' AS feature, FLOOR((RANK() OVER (ORDER BY {f}) - 1) * 10 / COUNT(*) OVER ()) AS bx, FLOOR((RANK() OVER (ORDER BY label) - 1) * 10 / COUNT(*) OVER ()) AS bz FROM mf"
                        for f in ("bias_r", "p2", "p3")).replace("bias_r FROM", "p1 FROM")
MIS = f"""SELECT feature, SUM(n * 1.0 / tot * LN(n * 1.0 * tot / (nx * ny))) AS score FROM (SELECT *, SUM(n) OVER (PARTITION BY feature) AS tot, SUM(n) OVER (PARTITION BY feature, bx) AS nx,
  SUM(n) OVER (PARTITION BY feature, bz) AS ny FROM (SELECT feature, bx, bz, COUNT(*) AS n FROM ({MI.replace('bias_r', 'p1')}) AS u GROUP BY 1, 2, 3) AS v) AS w GROUP BY feature"""
q("d26_mutual_information", "feature score:6", MIS, "mf")(lambda m: sc.mutual_information(frame(m), ["p1", "p2", "p3"], "label"))
q("s23_importance_selection", "feature score:6", f"SELECT * FROM ({TC}) AS x WHERE score >= 0.1::DOUBLE", "mf")(
    lambda m: sc.select_by_threshold(sc.target_correlation(frame(m), FEATS, "f_return"), 0.1))
THREE = ["p1", "p2", "p3"]
q("s24_borda_selection", "feature points", f"""SELECT feature, CAST(SUM(place) AS BIGINT) AS points FROM (
  SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(score, 9) DESC, feature) - 1 AS place FROM ({TC}) AS a WHERE feature IN ('p1', 'p2', 'p3')
  UNION ALL SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(score, 9) DESC, feature) - 1 FROM ({MIS}) AS b
  UNION ALL SELECT feature, ROW_NUMBER() OVER (ORDER BY ROUND(score, 9) DESC, feature) - 1 FROM ({TC.replace('f_return', 'label')}) AS c WHERE feature IN ('p1', 'p2', 'p3')) AS z
  GROUP BY feature ORDER BY points, feature LIMIT 2""", "mf")(
    lambda m: sc.borda({"a": sc.target_correlation(frame(m), THREE, "f_return"), "b": sc.mutual_information(frame(m), THREE, "label"),
                        "c": sc.target_correlation(frame(m), THREE, "label")}, 2))
LASTROW = "SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY code ORDER BY date DESC) AS k FROM mf) AS x WHERE k = 1"


def last_row(m, cols):
    return frame(m).groupBy("code").agg(F.max_by(F.struct("date", *cols), "date").alias("r")).select("code", "r.*")


CONTR = " UNION ALL ".join(f"SELECT code, date, '{f}' AS feature, {f} AS value FROM lastrow" for f in FEATS)
q("d35_contributions", "code date feature value:6 importance:6 contribution:6", f"""SELECT code, date, feature, value, importance, value * importance AS contribution FROM (
  SELECT c.*, t.score AS importance, ROW_NUMBER() OVER (PARTITION BY code ORDER BY ROUND(t.score, 9) DESC, c.feature) AS place FROM ({CONTR}) AS c JOIN ({TC}) AS t ON t.feature = c.feature) AS z
  WHERE place <= 3""", "mf", f"lastrow AS MATERIALIZED ({LASTROW})")(
    lambda m: sc.contributions(last_row(m, FEATS), FEATS, sc.target_correlation(frame(m), FEATS, "f_return"), 3))
q("s33_factor_board", "code date feature value:6 importance:6 place", f"""SELECT code, date, feature, value, importance, ROW_NUMBER() OVER (PARTITION BY code ORDER BY ROUND(importance, 9) DESC, feature) AS place FROM (
  SELECT c.*, t.score AS importance FROM ({CONTR}) AS c JOIN (SELECT feature, SUM(score) AS score FROM ({TC} UNION ALL {TC.replace('f_return', 'label')}) AS u GROUP BY feature) AS t ON t.feature = c.feature) AS z""",
  "mf", f"lastrow AS MATERIALIZED ({LASTROW})")(
    lambda m: sc.contributions(last_row(m, FEATS), FEATS, sc.target_correlation(frame(m), FEATS, "f_return").unionByName(
        sc.target_correlation(frame(m), FEATS, "label")).groupBy("feature").agg(F.sum("score").alias("score")), 100))
q("d36_label_stats", "n positive_rate:6 mean_label:6", "SELECT COUNT(*) AS n, AVG(CASE WHEN label >= 0.5 THEN 1 ELSE 0 END) AS positive_rate, AVG(label) AS mean_label FROM mf", "mf")(
    lambda m: frame(m).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") >= 0.5).cast("int")).alias("positive_rate"), F.avg("label").alias("mean_label")))
AUCS = " UNION ALL ".join(f"SELECT '{p}' AS model, a.auc AS train_auc, z.auc AS val_auc FROM ({auc_sql(p, '(SELECT * FROM mf WHERE is_train) AS q')}) AS a CROSS JOIN ({auc_sql(p, '(SELECT * FROM mf WHERE NOT is_train) AS q')}) AS z"
                          for p in THREE)


def model_auc(df):
    long = df.select("label", *THREE).unpivot(["label"], THREE, "model", "score")
    return sc.auc(long, "score", "label", ["model"])


q("d37_overfit_gap", "model train_auc:8 val_auc:8 gap:8 overfit", f"SELECT *, train_auc - val_auc AS gap, train_auc - val_auc > 0.1 AS overfit FROM ({AUCS}) AS x", "mf")(
    lambda m: (lambda s: sc.overfit(model_auc(s.where("is_train")), model_auc(s.where("NOT is_train"))))(split(m)))
q("s29_model_comparison", "model rank_ic:6 place", f"""SELECT model, rank_ic, ROW_NUMBER() OVER (ORDER BY rank_ic DESC) AS place FROM (""" + " UNION ALL ".join(
    f"""SELECT '{p}' AS model, AVG(c) AS rank_ic FROM (SELECT date, CORR(a, z) AS c FROM (SELECT date, {avg_rank(p, 'date')} AS a, {avg_rank('label', 'date')} AS z FROM mf WHERE NOT is_train) AS x
  GROUP BY date HAVING COUNT(*) >= 10 AND STDDEV_POP(a) > 0 AND STDDEV_POP(z) > 0) AS y""" for p in THREE) + ") AS u", "mf")(
    lambda m: (lambda s: s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rank_ic")))))(
        sc.daily_rank_ic(split(m).where("NOT is_train").unpivot(["date", "label"], THREE, "model", "score"), "score", "label", ["model", "date"])
        .groupBy("model").agg(F.avg("rank_ic").alias("rank_ic"))))
SWEEP = {"roc": [20, 40, 60], "bias": [24, 36, 48]}


def candidates(m):
    df = lb.forward_returns(t.base(m.bars()))
    for n in SWEEP["roc"]:
        df = t.roc(df, n, "close", f"roc|{n}")
    for n in SWEEP["bias"]:
        df = t.bias(df, n).withColumnRenamed("bias", f"bias|{n}")
    names = [f"{p}|{n}" for p, ns in SWEEP.items() for n in ns]
    long = df.dropna(subset=["code", "date"]).select("code", "date", F.round("f_return", 9).alias("target"), *[F.round(F.col(f"`{n}`"), 6).alias(n) for n in names]).unpivot(
        ["code", "date", "target"], [F.col(f"`{n}`") for n in names], "k", "value")
    return long.withColumns({"param": F.split("k", r"\|")[0], "setting": F.split("k", r"\|")[1].cast("int")})


SW = " UNION ALL ".join(f"SELECT code, date, 'roc' AS param, {n} AS setting, ROUND((close / {lagx('close', n)} - 1) * 100, 6) AS value, ROUND(LEAD(close, 5) OVER ({W}) / close - 1, 9) AS target FROM bars" for n in SWEEP["roc"])
SW += " UNION ALL " + " UNION ALL ".join(f"SELECT code, date, 'bias' AS param, {n} AS setting, ROUND(COALESCE(100 * (close / {g('AVG', 'close', n)} - 1), 0), 6) AS value, ROUND(LEAD(close, 5) OVER ({W}) / close - 1, 9) AS target FROM bars" for n in SWEEP["bias"])
P3 = "param, setting, date"
cte("sweep", f"""SELECT param, setting, AVG(ABS(c)) AS mean_abs_ic, COUNT(*) AS n_dates FROM (SELECT {P3}, CORR(a, z) AS c FROM (SELECT {P3}, {avg_rank('value', P3)} AS a, {avg_rank('target', P3)} AS z
  FROM ({SW}) AS s WHERE value IS NOT NULL AND target IS NOT NULL) AS x GROUP BY {P3} HAVING COUNT(*) >= 20 AND STDDEV_POP(a) > 0 AND STDDEV_POP(z) > 0) AS y GROUP BY 1, 2""", "bars")
q("d16_factor_ic", "param setting mean_abs_ic:7 n_dates", "SELECT * FROM sweep", "sweep")(lambda m: sc.sweep_ic(candidates(m), "target"))


def best_sql(gain, base):
    cond = " OR ".join(f"(param = '{p}' AND setting = {v})" for p, v in base.items())
    return f"""SELECT param, bs AS base_setting, bi AS base_ic, CASE WHEN ti > bi * {gain} THEN ts ELSE bs END AS best_setting, CASE WHEN ti > bi * {gain} THEN ti ELSE bi END AS best_ic FROM (
  SELECT param, MAX(CASE WHEN {cond} THEN mean_abs_ic END) AS bi, MAX(CASE WHEN {cond} THEN setting END) AS bs, MAX(mean_abs_ic) AS ti,
    ARG_MIN(setting, -ROUND(mean_abs_ic, 9)) AS ts FROM sweep GROUP BY param) AS x"""


BEST = "param base_setting base_ic:7 best_setting best_ic:7"
q("s27_parameter_sweep", BEST, best_sql(1.001, {"roc": 60, "bias": 36}), "sweep")(
    lambda m: sc.best_setting(sc.sweep_ic(candidates(m), "target"), {"roc": 60, "bias": 36}))
q("s28_period_optimisation", BEST, best_sql(1.0, {"roc": 20, "bias": 24}), "sweep")(
    lambda m: sc.best_setting(sc.sweep_ic(candidates(m), "target"), {"roc": 20, "bias": 24}, 1.0))

# --- top-k ------------------------------------------------------------------
TIE = """CAST((((((('0x' || SUBSTR(md5(code), 1, 8))::UBIGINT % 1000) * 296 + ('0x' || SUBSTR(md5(code), 9, 8))::UBIGINT) % 1000) * 296
  + ('0x' || SUBSTR(md5(code), 17, 8))::UBIGINT) % 1000 * 296 + ('0x' || SUBSTR(md5(code), 25, 8))::UBIGINT) % 1000 AS DOUBLE) / 100000"""
q("i02_top_n", CD + "confidence:5", f"SELECT code, date, p2 * 100 AS confidence FROM ({LASTROW}) AS l ORDER BY p2 * 100 + {TIE} DESC, code LIMIT 20", "mf")(
    lambda m: last_row(m, ["p2"]).withColumn("confidence", F.col("p2") * 100).orderBy(F.desc(F.col("confidence") + lb.tie_breaker()), "code").limit(20))
q("i03_top_n_per_date", CD + "score:6 place", "SELECT code, date, p1 AS score, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY p1 DESC, code) AS place FROM mf) AS x WHERE place <= 3", "mf")(
    lambda m: screen.top_per_date(frame(m).withColumn("score", F.col("p1")), "score", 3))
q("i04_top_factors", "feature score:6", f"SELECT * FROM ({TC}) AS x ORDER BY score DESC, feature LIMIT 3", "mf")(
    lambda m: sc.target_correlation(frame(m), FEATS, "f_return").orderBy(F.desc("score"), "feature").limit(3))
q("i06_results_order", "model code confidence:5", " UNION ALL ".join(f"SELECT '{p}' AS model, code, {p} * 100 AS confidence FROM ({LASTROW}) AS x" for p in THREE), "mf")(
    lambda m: last_row(m, THREE).unpivot(["code"], THREE, "model", "s").withColumn("confidence", F.col("s") * 100).orderBy("model", F.desc("confidence"), "code"))
