"""Model scores: transforms, ensembles, quality metrics, feature selection, parameter sweeps."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantweave.functions import ranks
from quantweave.session import staged

# Ship the kernels with the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ensemble(cols: Sequence[str], weights: Sequence[float]) -> Column:
    total = float(sum(weights))
    return reduce(lambda a, b: a + b, [F.col(c) * (w / total) for c, w in zip(cols, weights)])


#: Exact sums of products of whole numbers: high and low parts are added up apart.
LOW_BITS = 24


def daily_rank_ic(df: DataFrame, pred: str, ref: str, keys: Sequence[str] = ("date",), min_rows: int = 10, bounded: bool = False) -> DataFrame:
    """Spearman correlation per group; groups that are too small or constant are left out.

    Twice a tied rank is a whole number, and so is its distance from the mean of the group. The moments are
    sums of products of these, exact at up to 2^28 rows a group (more is an error, never a wrong value):
    a constant group has variance zero, and the result is the same however the rows are dealt.
    Equal (pred, ref) pairs fold first. The keys hold a date, so that groups are few however many rows there are. ``bounded`` says that a group is small enough for one sort.
    """
    keys = list(keys)
    rows = df.where(F.col(pred).isNotNull() & F.col(ref).isNotNull()).select(*keys, pred, ref)
    if bounded:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        both = rows.withColumns({"_w": F.lit(1), "_n": n, "_x": (2 * ranks.tied_rank(keys, pred) - 1 - n).cast("long"), "_y": (2 * ranks.tied_rank(keys, ref) - 1 - n).cast("long")})
    else:
        pairs = rows.groupBy(*keys, pred, ref).agg(F.count(F.lit(1)).alias("_w"))
        rows = staged(pairs.withColumn("_id", F.monotonically_increasing_id()), "pairs")
        one, _ = ranks.dealt_ranks(rows, keys, pred, "_rx", "_n", few_groups=True, weight="_w")
        both, _ = ranks.dealt_ranks(one.select(*keys, ref, "_id", "_w", "_rx", "_n"), keys, ref, "_ry", "_size", few_groups=True, weight="_w")
        both = both.withColumns({"_x": (2 * F.col("_rx") - 1 - F.col("_n")).cast("long"), "_y": (2 * F.col("_ry") - 1 - F.col("_n")).cast("long")})

    def total(a, b):
        return [F.sum(F.col("_w") * F.shiftright(F.col(a) * F.col(b), LOW_BITS)).alias(f"{a}{b}_high"),
                F.sum(F.col("_w") * (F.col(a) * F.col(b)).bitwiseAND(F.lit((1 << LOW_BITS) - 1))).alias(f"{a}{b}_low")]

    def moment(a, b):
        return F.col(f"{a}{b}_high").cast("double") * float(1 << LOW_BITS) + F.col(f"{a}{b}_low")
    per = both.groupBy(*keys).agg(F.max("_n").alias("n"), *total("_x", "_y"), *total("_x", "_x"), *total("_y", "_y"))
    return per.where((F.col("n") >= min_rows) & (moment("_x", "_x") > 0) & (moment("_y", "_y") > 0)).select(
        *keys, "n", (moment("_x", "_y") / (F.sqrt(moment("_x", "_x")) * F.sqrt(moment("_y", "_y")))).alias("rank_ic"))


def rank_ic_summary(df: DataFrame, pred: str, ref: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation over the dates, one row for each of ``keys`` that has a date (without keys always one row)."""
    return daily_rank_ic(df, pred, ref, [*keys, "date"]).groupBy(*keys).agg(F.coalesce(F.avg("rank_ic"), F.lit(0.0)).alias("rank_ic"),
                                            F.coalesce(F.stddev_pop("rank_ic"), F.lit(0.0)).alias("rank_ic_std"),
                                            F.count(F.lit(1)).alias("n_dates"))


def top_precision(df: DataFrame, pred: str, ref: str, top: int, q: float, min_rows: int = 10, keys: Sequence[str] = (), cut: DataFrame | None = None) -> DataFrame:
    """Share of each date's ``top`` best-predicted rows that reach the q-quantile of the reference; ``cut`` brings
    the quantiles (``_cut``) where the caller has them."""
    group = [*keys, "date"]
    cut = ranks.quantiles(df, group, ref, {"_cut": q}) if cut is None else cut
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows)
    w = Window.partitionBy(*group).orderBy(F.desc(pred), "code")
    best = df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    return (best.join(sizes, group).join(cut, group).groupBy(*group)
            .agg(F.avg((F.col(ref) >= F.col("_cut") - 1e-12).cast("int")).alias("precision")))


def classification(df: DataFrame, prob: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) >= 0.5, F.col(prob) >= 0.5

    def n(c):
        return F.sum(F.when(c, 1).otherwise(0))
    tp, fp, fn, tn = n(y & p), n(~y & p), n(y & ~p), n(~y & ~p)
    agg = df.groupBy(*keys).agg(tp.alias("_tp"), fp.alias("_fp"), fn.alias("_fn"), tn.alias("_tn"))
    precision = F.coalesce(F.try_divide("_tp", F.col("_tp") + F.col("_fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide("_tp", F.col("_tp") + F.col("_fn")), F.lit(0.0))
    two = (F.col("_tp") + F.col("_fn") > 0) & (F.col("_fp") + F.col("_tn") > 0)
    acc = (F.col("_tp") + F.col("_tn")) / (F.col("_tp") + F.col("_fp") + F.col("_fn") + F.col("_tn"))
    return agg.select(*keys, F.when(two, acc).otherwise(1.0).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
                      F.coalesce(F.try_divide(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_fp") + F.col("_fn")), F.lit(0.0)).alias("f1"))


def auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), few_groups: bool = False) -> DataFrame:
    """Area under the ROC curve per group, 0.5 with a single class: each positive counts the
    negatives below it, ties by half. Works on the split positions, so a group may be the
    whole table."""
    keys = list(keys)
    group = keys or ["_all"]
    src = df if keys else df.withColumn("_all", F.lit(0))
    pos = ranks.split_positions(src.select(*group, score, label), group, score, {"hits": (F.col(label) >= 0.5).cast("long")}, few_groups=few_groups or not keys)
    below = F.col("before") - F.col("before_hits") + (F.col("cnt") - F.col("hits")) / F.lit(2.0)
    agg = pos.groupBy(*group).agg(F.sum(F.col("hits") * below).alias("_u"), F.max("total_hits").alias("_p"), F.max("n").alias("_n"))
    value = F.try_divide(F.col("_u"), F.col("_p") * (F.col("_n") - F.col("_p")))
    return agg.select(*keys, F.coalesce(value, F.lit(0.5)).alias("auc"))


def dispersion(df: DataFrame, prob: str) -> DataFrame:
    return df.agg(F.stddev_pop(prob).alias("prob_std"), F.countDistinct(F.round(prob, 6)).alias("n_unique"))


def simplex(n_models: int, steps: int = 20) -> list[list[float]]:
    """All weight vectors on the grid of ``steps`` steps that sum to 1: every way to set
    ``n_models - 1`` bars among ``steps`` stars. Their number grows as ``steps`` to the power of
    ``n_models - 1``, so choose fewer steps for many models."""
    places = steps + n_models - 1
    return [[(right - left - 1) / steps for left, right in pairwise((-1, *bars, places))] for bars in combinations(range(places), n_models - 1)]


def mixed_score(scores: Sequence[str], weights: Column) -> Column:
    return F.round(reduce(lambda a, b: a + b, [F.col(s) * weights[i] for i, s in enumerate(scores)]), 9)


def weight_search(df: DataFrame, scores: Sequence[str], label: str, steps: int = 20, only: Sequence[int] | None = None) -> DataFrame:
    """Exact AUC of every weight vector, or of those numbered in ``only``. Each row expands into the fixed grid and folds by
    (vector, score) before the shuffle."""
    grid = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*[F.lit(w) for w in v]).alias("w"))
                     for i, v in enumerate(simplex(len(scores), steps)) if only is None or i in only])
    long = df.select(*scores, label, F.explode(grid).alias("g"))
    long = long.select(F.col("g.id").alias("weight_id"), mixed_score(scores, F.col("g.w")).alias("_s"), label)
    return auc(long, "_s", label, ["weight_id"], few_groups=True)


def weight_bounds(df: DataFrame, scores: Sequence[str], label: str, steps: int = 20, bins: int = 4096) -> DataFrame:
    """(weight_id, low, high): bounds of the AUC of every weight vector from score histograms.

    A task folds its rows into one histogram of the positives and one of all rows for each vector, between the least and the
    largest score; only these are shuffled. Rows of different bins are ordered for certain; those of one bin count for
    ``high`` only. Rows without a score or label count in neither."""
    grid = np.array(simplex(len(scores), steps))
    least, most = df.agg(F.min(F.least(*scores) if len(scores) > 1 else F.col(scores[0])), F.max(F.greatest(*scores) if len(scores) > 1 else F.col(scores[0]))).first()
    least, width = least or 0.0, max((most or 0.0) - (least or 0.0), 1e-9) / bins

    def fold(batches):
        rows, hits = np.zeros((len(grid), bins), np.int64), np.zeros((len(grid), bins), np.int64)
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            x = x[~np.isnan(x).any(1)]
            # rounded as the exact search does, so that equal scores share a bin
            place = np.clip(np.floor((np.round(x[:, :-1] @ grid.T, 9) - least) / width), 0, bins - 1).astype(np.int64)
            for i in range(len(grid)):
                rows[i] += np.bincount(place[:, i], minlength=bins)
                hits[i] += np.bincount(place[x[:, -1] >= 0.5, i], minlength=bins)
        i, b = np.nonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(rows[i, b]), pa.array(hits[i, b])], names=["weight_id", "b", "n", "hits"])
    bars = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*scores, label])]).mapInArrow(fold, "weight_id int, b int, n long, hits long")
    bars = bars.groupBy("weight_id", "b").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    per = Window.partitionBy("weight_id")
    below = F.coalesce(F.sum(F.col("n") - F.col("hits")).over(per.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bars = bars.withColumns({"below": below, "one": (F.col("n") - F.col("hits")) * F.col("hits")})
    agg = bars.groupBy("weight_id").agg(F.sum(F.col("hits") * F.col("below")).alias("sure"), F.sum("one").alias("open"), F.sum("hits").alias("p"), F.sum(F.col("n") - F.col("hits")).alias("q"))
    pairs = F.col("p") * F.col("q")
    # The bin of a score that lies on an edge may be off by one rounding, so the bounds give a little.
    return agg.select("weight_id", F.coalesce(F.try_divide(F.col("sure"), pairs) - 1e-6, F.lit(0.5)).alias("low"),
                      F.coalesce(F.try_divide(F.col("sure") + F.col("open"), pairs) + 1e-6, F.lit(0.5)).alias("high"))


def best_weights(df: DataFrame, scores: Sequence[str], label: str, steps: int = 20) -> DataFrame:
    """The vector of the largest AUC, the first one if several tie. Histogram bounds rule out most vectors;
    the exact search runs for those that can still win (at most one number for each vector reaches the driver)."""
    bounds = weight_bounds(df, scores, label, steps).collect()
    only = [r["weight_id"] for r in bounds if r["high"] >= max(x["low"] for x in bounds)]
    return weight_search(df, scores, label, steps, only or None).orderBy(F.desc(F.round("auc", 12)), "weight_id").limit(1)


# --- features ---------------------------------------------------------------

def target_correlation(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Absolute Pearson correlation per feature over the rows where both are present, 0 for a constant one.

    One pass: each task folds its rows into means, sums of squares about them and extremes, one row for each feature, and
    these are merged; an aggregate expression for each feature would take longer to compile than to run."""
    features = list(features)

    def fold(batches):
        held = [None] * len(features)
        for batch in batches:
            cells = [(c.is_valid().to_numpy(zero_copy_only=False), c.fill_null(0.0).to_numpy()) for c in batch.columns]
            seen, y = cells[-1]
            for i, (there, x) in enumerate(cells[:-1]):
                both = there & seen
                if both.any():
                    held[i] = _joined(held[i], _moments(x[both], y[both]))
        rows = [(i, *h) for i, h in enumerate(held) if h]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.array(v, np.int32 if k == 0 else np.float64) for k, v in enumerate(zip(*rows, strict=True)))], names=names)
    names = ["i", "n", "mx", "my", "xx", "yy", "xy", "least_x", "most_x", "least_y", "most_y"]
    cells = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y"))
    parts = cells.mapInArrow(fold, f"i int, {', '.join(f'{c} double' for c in names[1:])}")
    per = Window.partitionBy("i")
    parts = parts.withColumns({c: F.sum(F.col("n") * F.col(m)).over(per) / F.sum("n").over(per) for c, m in (("ax", "mx"), ("ay", "my"))})
    dx, dy, n = F.col("mx") - F.col("ax"), F.col("my") - F.col("ay"), F.col("n")
    one = parts.groupBy("i").agg(F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"),
                                 *[f(c).alias(c) for c in names[7:] for f in ([F.min] if c.startswith("least") else [F.max])])
    r = F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))
    one = one.select("i", F.when((F.col("least_x") < F.col("most_x")) & (F.col("least_y") < F.col("most_y")), F.abs(r)).alias("score"))
    label = F.array(*[F.lit(f) for f in features])
    every = df.sparkSession.range(len(features)).select(F.col("id").cast("int").alias("i"))
    return every.join(F.broadcast(one), "i", "left").select(F.get(label, "i").alias("feature"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _moments(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Rows, means, sums of squares and products about them, extremes; NaN is larger than all numbers."""
    mx, my = x.mean(), y.mean()
    dx, dy = x - mx, y - my

    def ends(v):
        return np.fmin.reduce(v), v.max()
    return len(x), mx, my, dx @ dx, dy @ dy, dx @ dy, *ends(x), *ends(y)


def _joined(a: tuple[float, ...] | None, b: tuple[float, ...]) -> tuple[float, ...]:
    if a is None:
        return b
    n, share = a[0] + b[0], a[0] * b[0] / (a[0] + b[0])
    dx, dy = b[1] - a[1], b[2] - a[2]
    return (n, a[1] + dx * b[0] / n, a[2] + dy * b[0] / n, a[3] + b[3] + share * dx * dx, a[4] + b[4] + share * dy * dy, a[5] + b[5] + share * dx * dy,
            np.fmin(a[6], b[6]), np.maximum(a[7], b[7]), np.fmin(a[8], b[8]), np.maximum(a[9], b[9]))


def correlation_pairs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every feature pair over the rows where both are present.

    One pass at every size: each task folds its rows into six moment matrices
    (features squared, whatever the rows), Spark adds them up, and a pair's value
    depends on its two features alone. Values are centred by their column mean
    first, so the sums of squares stay accurate.
    """
    features = list(features)
    names = {i: f for i, f in enumerate(features)}

    def fold(batches):
        n = len(features)
        total = np.zeros((6, n, n))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) if batch.num_rows else np.empty((0, n))
            m = ~np.isnan(x)
            x, y = np.where(m, x, 0.0), m.astype(float)
            total += np.stack([y.T @ y, x.T @ y, y.T @ x, (x * x).T @ y, y.T @ (x * x), x.T @ x])
        i, j = np.triu_indices(n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *[pa.array(t[i, j]) for t in total]],
                                         names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])
    # One row: shifted values keep the sums of squares exact enough, and a constant column becomes zero exactly.
    mean = df.agg(*[F.when(F.min(f) == F.max(f), F.min(f)).otherwise(F.avg(f)).alias(f) for f in features])
    shifted = df.select(*features).join(F.broadcast(mean.select(*[F.col(f).alias(f"_m_{f}") for f in features]))).select(
        *[(F.col(f) - F.col(f"_m_{f}")).cast("double").alias(f) for f in features])
    parts = shifted.mapInArrow(fold, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var = [F.greatest(F.col(q) - F.col(u) * F.col(u) / F.col("n"), F.lit(0.0)) for u, q in (("sx", "sxx"), ("sy", "syy"))]
    label = F.array(*[F.lit(names[i]) for i in range(len(features))])
    return s.where("n > 0").select(F.get(label, "i").alias("f1"), F.get(label, "j").alias("f2"), F.try_divide(cov, F.sqrt(var[0] * var[1])).alias("corr"))


def bin_edges(df: DataFrame, cols: Sequence[str], bins: int) -> dict[str, tuple[list[float], list[int]]]:
    """First value of each quantile bin, and the bin's number, of every column; a value's bin is the number of smaller
    rows times ``bins`` over all rows. Equal values share a bin, so numbers may be left out. At most ``bins`` rows a column reach the driver."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature", "value").where(~F.isnan("value"))
    pos = ranks.split_positions(long, ["feature"], "value", few_groups=True)
    edges = pos.groupBy("feature", F.floor(F.col("before") * bins / F.col("n")).cast("int").alias("b")).agg(F.min("value").alias("value"))
    out: dict[str, tuple[list[float], list[int]]] = {c: ([], []) for c in cols}
    for r in sorted(edges.collect(), key=lambda r: r["b"]):
        out[r["feature"]][0].append(r["value"])
        out[r["feature"]][1].append(r["b"])
    return out


def mutual_information(df: DataFrame, features: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Quantile-binned mutual information of every feature with the target, over the rows where both are present.

    The bin edges are exact and small; then one pass folds a contingency table of bins x bins for each
    feature in every task, and only these tables are shuffled. A feature without values has no row."""
    features = list(features)
    edges = bin_edges(df, list(dict.fromkeys([*features, target])), bins)

    def fold(batches):
        total = np.zeros((len(features), bins, bins), np.int64)

        def binned(column, name):
            x = column.to_numpy(zero_copy_only=False).astype(float)
            starts, numbers = edges[name]
            place = np.searchsorted(starts, np.where(np.isnan(x), -np.inf, x), "right") - 1
            return np.where(np.isnan(x) | (place < 0), -1, np.array([*numbers, -1])[place])
        for batch in batches:
            y = binned(batch.column(len(features)), target)
            for i, f in enumerate(features):
                x = binned(batch.column(i), f)
                both = (x >= 0) & (y >= 0)
                total[i] += np.bincount(x[both] * bins + y[both], minlength=bins * bins).reshape(bins, bins)
        i, x, y = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([features[k] for k in i], pa.string()), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(total[i, x, y])],
                                         names=["feature", "bx", "by", "n"])
    tables = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")).mapInArrow(
        fold, "feature string, bx int, by int, n long").groupBy("feature", "bx", "by").agg(F.sum("n").alias("n"))
    tables = tables.withColumns({"_n": F.sum("n").over(Window.partitionBy("feature")), "_x": F.sum("n").over(Window.partitionBy("feature", "bx")),
                                 "_y": F.sum("n").over(Window.partitionBy("feature", "by"))})
    p = F.col("n") / F.col("_n")
    return tables.groupBy("feature").agg(F.sum(p * F.log(F.col("n") * F.col("_n") / (F.col("_x") * F.col("_y")))).alias("score"))


def select_by_threshold(scores: DataFrame, threshold: float) -> DataFrame:
    return scores.where(F.col("score") >= threshold)


def borda(score_tables: dict[str, DataFrame], n: int) -> DataFrame:
    """Sum of rank positions over the score tables (one row per feature each), best n."""
    placed = None
    for df in score_tables.values():
        w = Window.orderBy(F.desc(F.round("score", 9)), "feature")
        one = df.select("feature", (F.row_number().over(w) - 1).alias("place"))
        placed = one if placed is None else placed.unionByName(one)
    return placed.groupBy("feature").agg(F.sum("place").cast("long").alias("points")).orderBy("points", "feature").limit(n)


def drop_redundant(pairs: DataFrame, scores: DataFrame, features: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Sweep from the best score down: a feature stays unless it correlates above the
    threshold with one that stays. Equal scores go in the order of ``features``; a feature
    without a score comes last. Only the strong pairs reach the driver, at most
    features squared, independent of the rows."""
    place = {f: i for i, f in enumerate(features)}
    strong: dict[str, set[str]] = {f: set() for f in features}
    for f1, f2 in pairs.where(F.abs("corr") > threshold).select("f1", "f2").collect():
        strong[f1].add(f2)
        strong[f2].add(f1)
    score = {r["feature"]: r["score"] for r in scores.collect() if r["score"] is not None}
    kept: set[str] = set()
    for f in sorted(features, key=lambda f: (f not in score, -score.get(f, 0.0), place[f])):
        if not strong[f] & kept:
            kept.add(f)
    return [f for f in features if f in kept]


def contributions(row: DataFrame, features: Sequence[str], importance: DataFrame, n: int = 20) -> DataFrame:
    """value x importance per instrument, its n most important factors."""
    long = row.unpivot(["code", "date"], list(features), "feature", "value")
    j = long.join(importance.select("feature", F.col("score").alias("importance")), "feature")
    w = Window.partitionBy("code", "date").orderBy(F.desc(F.round("importance", 9)), "feature")
    return j.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn(
        "contribution", F.coalesce("value", F.lit(0.0)) * F.col("importance"))


def sweep_ic(long: DataFrame, target: str, min_rows: int = 20) -> DataFrame:
    """Mean absolute rank IC per (param, setting) of a long candidate table."""
    ic = daily_rank_ic(long, "value", target, ["param", "setting", "date"], min_rows)
    return ic.groupBy("param", "setting").agg(F.avg(F.abs("rank_ic")).alias("mean_abs_ic"), F.count(F.lit(1)).alias("n_dates"))


def best_setting(scores: DataFrame, base: dict[str, int], gain: float = 1.001) -> DataFrame:
    """Best setting per parameter; it must beat the current one by the gain factor."""
    is_base = reduce(lambda a, b: a | b, [(F.col("param") == p) & (F.col("setting") == v) for p, v in base.items()])
    agg = scores.groupBy("param").agg(
        F.max(F.when(is_base, F.col("mean_abs_ic"))).alias("base_ic"), F.max(F.when(is_base, F.col("setting"))).alias("base_setting"),
        F.min_by("setting", F.struct((-F.round("mean_abs_ic", 9)).alias("a"), "setting")).alias("top_setting"), F.max("mean_abs_ic").alias("top_ic"))
    win = F.col("top_ic") > F.col("base_ic") * gain
    return agg.select("param", "base_setting", "base_ic", F.when(win, F.col("top_setting")).otherwise(F.col("base_setting")).alias("best_setting"),
                      F.when(win, F.col("top_ic")).otherwise(F.col("base_ic")).alias("best_ic"))


def overfit(train: DataFrame, val: DataFrame, limit: float = 0.1) -> DataFrame:
    return train.withColumnRenamed("auc", "train_auc").join(val.withColumnRenamed("auc", "val_auc"), "model").withColumn(
        "gap", F.col("train_auc") - F.col("val_auc")).withColumn("overfit", F.col("gap") > limit)
