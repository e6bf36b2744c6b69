"""Training set, boosted-tree score models, stacking and the optimisation pipeline on Spark ML.

All factors of the assembled block are ranked per date and coded once as bins of one byte (``BINS`` equal
steps of the rank, which are the exact quantiles of a date). The coded table is written once; every fit, whatever
its features, rounds or rows, reads the bytes it needs from there. Boosting ends early: at most ``MAX_ROUNDS``
rounds, fewer when the error on the later rows no longer falls by ``TOLERANCE``.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from quantweave.functions import ranks
from quantweave.functions.trailing import PLACE
from quantweave.operators import labels, scoring
from quantweave.plans.factor_block import assembled, families
from quantweave.session import staged, work_dir

FEATURES = [c for family in families().values() for c in family]
BINS = 32
#: Bounds of a fit: rounds, and the least relative gain that goes on. Fits of elimination and folds are smaller.
MAX_ROUNDS, TOLERANCE, SMALL_ROUNDS = 24, 0.002, 8
#: What a model learns: the soft label, or the graded relevance of a date's rows (0..1).
KINDS = ("regression", "ranking")
FOLDS = 3
GRADES = 150


def known(block: DataFrame) -> DataFrame:
    """What is missing counts as zero."""
    return block.drop(PLACE).withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in FEATURES})


def factor_frame(bars: DataFrame, factors: DataFrame, reports: DataFrame, wanted: DataFrame) -> DataFrame:
    """The assembled factor block of the ``wanted`` (code, date), each once. All bars take part; they are marked while they are narrow."""
    marked = bars.join(wanted.select("code", "date", F.lit(1).alias("_wanted")), ["code", "date"], "left")
    return known(assembled(marked, factors, reports, ["_wanted"]).where("_wanted = 1").drop("_wanted"))


def labelled_frame(bars: DataFrame, factors: DataFrame, reports: DataFrame) -> DataFrame:
    """The assembled factor block with the path labels, which look at the next sessions of an instrument before its rows are wide."""
    return known(assembled(bars, factors, reports, lines=labels.path_label))


def coded(df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Replaces ranked ``features`` by ``bins``, one byte each in their order."""
    cells = [F.least(F.floor(F.col(f) * BINS), F.lit(BINS - 1)).cast("tinyint") for f in features]
    return df.select(*[c for c in df.columns if c not in features], F.array(*cells).alias("bins"))


def training_set(block: DataFrame, features: Sequence[str] = FEATURES, sizes: DataFrame | None = None) -> DataFrame:
    """Bins of the ranked features, board-neutral label, its grade, weight and time split; one row per (code, date).
    ``sizes`` has a row of the same date for every row of the block, where these are cheaper to count."""
    df = block if "label_raw" in block.columns else labels.path_label(block)
    df = df.where(F.col("label_raw").isNotNull() & F.col("f_return").isNotNull()).select(
        "code", "date", "f_return", "label_raw", "limit_threshold", F.col("unbuyable").alias("_blocked"), *features)
    wide = staged(coded(labels.cross_rank(df, features, null_rank=0.5, sizes=sizes), features).withColumnRenamed("_blocked", "unbuyable"), "coded")
    # Labels, split and weight look at their rows several times: they work on the few columns they need.
    df = staged(labels.relevance(labels.penalise(labels.board_rank(wide.drop("bins"))), "label", GRADES), "labels")
    df = labels.sample_weight(labels.time_split(df.withColumn("grade", F.col("relevance") / float(GRADES - 1))))
    return df.join(wide.select("code", "date", "bins"), ["code", "date"])


def vector(features: Sequence[str], chosen: Sequence[str]) -> Column:
    """The bins of the ``chosen`` ones of ``features`` as a vector."""
    if list(chosen) == list(features):
        return array_to_vector(F.col("bins").cast("array<double>"))
    place = {f: i for i, f in enumerate(features)}
    cells = F.transform(F.array(*[F.lit(place[f]) for f in chosen]), lambda i: F.get("bins", i).cast("double"))
    return array_to_vector(cells)


def fit_trees(train: DataFrame, chosen: Sequence[str] = FEATURES, features: Sequence[str] = FEATURES, kind: str = "regression", rounds: int = MAX_ROUNDS,
              depth: int = 4, seed: int = 42) -> GBTRegressionModel:
    """Boosted regression trees on the label or the grade; rows outside the training window drive early stopping."""
    data = train.select(vector(features, chosen).alias("features"), F.col("label" if kind == "regression" else "grade").alias("target"), "weight", (~F.col("is_train")).alias("is_val"))
    gbt = GBTRegressor(featuresCol="features", labelCol="target", weightCol="weight", validationIndicatorCol="is_val", validationTol=TOLERANCE, maxIter=rounds,
                       maxDepth=depth, stepSize=0.2, seed=seed, maxBins=BINS, subsamplingRate=1.0, maxMemoryInMB=512)
    return gbt.fit(data)


def predict(model: GBTRegressionModel, df: DataFrame, out: str = "prob", chosen: Sequence[str] = FEATURES, features: Sequence[str] = FEATURES) -> DataFrame:
    scored = model.transform(df.withColumn("features", vector(features, chosen)))
    return scored.withColumn(out, scoring.clip01(F.col("prediction"))).drop("prediction", "features")


def importance(model: GBTRegressionModel, features: Sequence[str], spark) -> DataFrame:
    values = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values, strict=True)], "feature string, score double")


_LOCK = threading.Lock()
_ARCHIVE: dict[tuple[str, str], tuple[str, dict[str, str]]] = {}


def archive(m, reports: DataFrame) -> tuple[dict[str, GBTRegressionModel], DataFrame]:
    """Models of both kinds and the stored training set of one input folder, fitted once per session."""
    key = (m.spark.sparkContext.applicationId, m.root)
    with _LOCK:
        if key not in _ARCHIVE:
            data = work_dir(m.spark, "training-set")
            training_set(labelled_frame(m.bars(), m.adjust_factor(), reports), sizes=m.bars()).write.parquet(data)
            paths = {}
            for kind in KINDS:
                paths[kind] = work_dir(m.spark, f"model-{kind}")
                fit_trees(m.spark.read.parquet(data), kind=kind).write().save(paths[kind])
            _ARCHIVE[key] = (data, paths)
    data, paths = _ARCHIVE[key]
    return {kind: GBTRegressionModel.load(path) for kind, path in paths.items()}, m.spark.read.parquet(data)


def quality(df: DataFrame, prob: str = "prob", label: str = "label", keys: Sequence[str] = ()) -> DataFrame:
    """Rank IC, AUC and top-1 and top-5 precision of scored frames, one row for each of ``keys`` (none: of one frame), all frames in the same passes."""
    keys = list(keys)
    ic, a = scoring.rank_ic_summary(df, prob, label, keys), scoring.auc(df, prob, label, keys, few_groups=True)
    cuts = staged(ranks.quantiles(df, [*keys, "date"], label, {"_top1": 0.95, "_top5": 0.8}), "cuts")

    def precision(n, q):
        cut = cuts.select(*keys, "date", F.col(f"_top{n}").alias("_cut"))
        return scoring.top_precision(df, prob, label, n, q, keys=keys, cut=cut).groupBy(*keys).agg(F.avg("precision").alias(f"top{n}_precision"))
    one, five = precision(1, 0.95), precision(5, 0.8)
    if not keys:
        return ic.join(a).join(one).join(five)  # one row each
    rows = df.select(*keys).distinct().join(ic, keys, "left").join(a, keys).join(one, keys, "left").join(five, keys, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (("rank_ic", 0.0), ("rank_ic_std", 0.0), ("n_dates", 0))})


def compare(models: dict[str, GBTRegressionModel], df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Quality of every kind on the same rows, for each of ``keys``, the best rank IC first. The scores of all kinds are written once."""
    scores = [predict(model, df).select(*keys, "code", "date", "label", "prob", F.lit(kind).alias("model")) for kind, model in models.items()]
    return quality(staged(reduce(DataFrame.unionByName, scores), "scores"), keys=["model", *keys]).orderBy(F.desc("rank_ic"))


def fit_stack(scored: DataFrame, scores: Sequence[str], label: str = "label") -> PipelineModel:
    """Logistic regression of the binarised label on model scores."""
    data = scored.withColumn("_y", (F.col(label) >= 0.5).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=list(scores), outputCol="_v"),
                            LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=100, tol=1e-9, probabilityCol="_pv", rawPredictionCol="_rv", predictionCol="_pl")]).fit(data)


def stack(train: DataFrame, later: DataFrame, scores: Sequence[str], label: str = "label") -> DataFrame:
    """``later`` with the column ``stacked``, from a stack fitted on ``train`` alone."""
    return fit_stack(train, scores, label).transform(later).withColumn("stacked", vector_to_array("_pv")[1]).drop("_v", "_pv", "_rv", "_pl")


def folds(train: DataFrame, n: int = FOLDS, purge: int = labels.HORIZON) -> DataFrame:
    """(date, fold, apart): the dates in ``n`` runs of about equal length. ``apart`` lists the folds whose models may learn
    from the date: every other fold, unless the date lies within ``purge`` sessions of it, as its label would
    reach into that fold. The table is as long as the calendar."""
    from pyspark.sql import Window
    days = train.select("date").distinct()
    order = Window.orderBy("date")
    days = days.withColumns({"_i": F.row_number().over(order) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy())})

    def first(k):
        return F.floor(F.lit(k) * F.col("_n") / n)
    fold = reduce(lambda a, k: F.when(F.col("_i") >= first(k), k).otherwise(a), range(1, n), F.lit(0))
    far = [F.when((F.col("_i") < first(k) - purge) | (F.col("_i") >= first(k + 1) + purge), F.lit(k)) for k in range(n)]
    return days.select("date", fold.cast("int").alias("fold"), F.array_compact(F.array(*far)).alias("apart"))


def out_of_fold(train: DataFrame, chosen: dict[str, Sequence[str]], features: Sequence[str] = FEATURES, n: int = FOLDS, rounds: int = SMALL_ROUNDS) -> DataFrame:
    """Every training row with one score for each name of ``chosen`` (name: its features), from models that saw
    neither its fold nor the sessions next to it."""
    dealt = staged(train.join(F.broadcast(folds(train, n)), "date"), "folds")
    parts = []
    # The fits of a fold are chains of short jobs: side by side, those of one fill the gaps of the other.
    with ThreadPoolExecutor(len(chosen)) as pool:
        for k in range(n):
            rows = dealt.where(F.array_contains("apart", k)).withColumn("is_train", F.pmod(F.xxhash64("date"), F.lit(5)) != 0)  # a fifth of the dates stops the fit
            fits = {name: pool.submit(inheritable_thread_target(dealt.sparkSession)(fit_trees), rows, own, features, rounds=rounds, depth=3) for name, own in chosen.items()}
            part = dealt.where(F.col("fold") == k)
            for name, own in chosen.items():
                part = predict(fits[name].result(), part, name, own, features)
            parts.append(staged(part.select("code", "date", "label", *chosen), "fold-scores"))
    return reduce(DataFrame.unionByName, parts)


def eliminate(train: DataFrame, chosen: Sequence[str], keep: int, share: float = 0.5, features: Sequence[str] = FEATURES) -> list[str]:
    """Recursive elimination: the weakest ``share`` of the features goes after each small fit, until ``keep`` remain.
    All fits read the same bins."""
    left = list(chosen)
    while len(left) > keep:
        values = fit_trees(train, left, features, rounds=SMALL_ROUNDS, depth=3).featureImportances.toArray()
        order = sorted(range(len(left)), key=lambda i: (-values[i], left[i]))
        stay = set(order[:max(keep, len(left) - max(1, int(len(left) * share)))])
        left = [f for i, f in enumerate(left) if i in stay]
    return left


def ranked_columns(data: DataFrame, chosen: Sequence[str], features: Sequence[str] = FEATURES) -> DataFrame:
    """Bins of the chosen features as columns."""
    place = {f: i for i, f in enumerate(features)}
    return data.select("code", "date", "label", "is_train", *[F.get("bins", F.lit(place[f])).cast("double").alias(f) for f in chosen])


def optimise(train: DataFrame, chosen: Sequence[str], model: GBTRegressionModel, n_features: int = 24, features: Sequence[str] = FEATURES) -> DataFrame:
    """Hybrid selection -> redundancy removal -> refit -> weight search -> stacking; one row per stage metric, all
    judged on the dates after the training window. Weights and stack are fitted on out-of-fold scores of the training dates."""
    spark = train.sparkSession
    head = staged(ranked_columns(train, chosen, features).where("is_train"), "columns")
    corr = staged(scoring.target_correlation(head, chosen, "label"), "correlations")  # read twice
    picked = [r["feature"] for r in scoring.borda({"importance": importance(model, chosen, spark), "correlation": corr,
                                                   "information": scoring.mutual_information(head, chosen, "label")}, n_features).collect()]
    kept = scoring.drop_redundant(scoring.correlation_pairs(head, picked), corr, picked)
    small = fit_trees(train, kept, features, rounds=SMALL_ROUNDS, depth=3)
    val = predict(small, predict(model, train.where("NOT is_train"), "p_full", chosen, features), "p_small", kept, features)
    val = staged(val.select("code", "date", "label", "p_full", "p_small"), "validation-scores")
    past = staged(out_of_fold(train.where("is_train"), {"p_full": chosen, "p_small": kept}, features), "past-scores")
    names = ["p_full", "p_small"]
    grid = scoring.simplex(len(names))
    weights = grid[scoring.best_weights(past, names, "label").first()["weight_id"]]
    mixed = val.withColumn("p_mixed", scoring.ensemble(names, weights))
    stacked = staged(stack(past, mixed, names), "stacked")
    stages = {"full": "p_full", "selected": "p_small", "weights": "p_mixed", "stacked": "stacked"}
    long = stacked.select("label", *[F.col(c).alias(stage) for stage, c in stages.items()]).unpivot("label", list(stages), "stage", "prob")
    none = spark.createDataFrame([(stage,) for stage in stages], "stage string")  # a stage without scores has 0.5
    aucs = none.join(scoring.auc(long, "prob", "label", ["stage"], few_groups=True), "stage", "left").withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    return aucs.withColumn("n_features", F.when(F.col("stage") == "full", len(list(chosen))).otherwise(len(kept)))


def rmse(df: DataFrame) -> float:
    return RegressionEvaluator(labelCol="label", predictionCol="prob").evaluate(df)
