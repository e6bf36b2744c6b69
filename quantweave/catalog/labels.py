"""X15-X25: cross-section ranks, labels, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweave.catalog.core import q
from quantweave.catalog.features import feat
from quantweave.catalog.filters import scored
from quantweave.catalog.sqlkit import W, cte
from quantweave.operators import labels as lb

CD = "code date "


def avg_rank(x, part):
    return f"(RANK() OVER (PARTITION BY {part} ORDER BY {x}) + (COUNT(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


def rounded(m):
    return feat(m).select("code", "date", F.round(F.coalesce("roc", F.lit(0.0)), 6).alias("roc"), F.round("bias", 6).alias("bias"),
                          F.round("vol_ma", 6).alias("vol_ma"))


RND = "(SELECT code, date, ROUND(COALESCE(roc, 0), 6) AS roc, ROUND(bias, 6) AS bias, ROUND(vol_ma, 6) AS vol_ma FROM feat) AS s"
X15 = "SELECT code, date, " + ", ".join(f"{avg_rank(c, 'date')} / (COUNT(*) OVER (PARTITION BY date) + 1) AS {c}" for c in ("roc", "bias", "vol_ma")) + f" FROM {RND}"
q("x15_cross_rank_training", CD + "roc:6 bias:6 vol_ma:6", X15, "feat")(lambda m: lb.cross_rank(rounded(m), ["roc", "bias", "vol_ma"], bounded=True))
q("x15_cross_rank_split", CD + "roc:6 bias:6 vol_ma:6", X15, "feat")(lambda m: lb.cross_rank(rounded(m), ["roc", "bias", "vol_ma"]))
q("x16_cross_rank_scoring", CD + "roc:6 bias:6", f"""SELECT code, date, CASE WHEN roc IS NULL THEN 0.5 ELSE
  (RANK() OVER (PARTITION BY date ORDER BY roc NULLS LAST) + (COUNT(*) OVER (PARTITION BY date, roc) - 1) / 2.0) / COUNT(roc) OVER (PARTITION BY date) END AS roc,
  {avg_rank('bias', 'date')} / COUNT(*) OVER (PARTITION BY date) AS bias FROM (SELECT code, date, ROUND(roc, 6) AS roc, ROUND(bias, 6) AS bias FROM feat) AS s""", "feat")(
    lambda m: lb.cross_rank(feat(m).select("code", "date", F.round("roc", 6).alias("roc"), F.round("bias", 6).alias("bias")), ["roc", "bias"],
                            plus_one=False, null_rank=0.5))
FWD = f"({W} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
cte("lab", f"""SELECT *, SIGN(f_return) * POW(ABS(f_return), 1.5) + 0.5 * f_max_return + f_min_return AS label_raw FROM (
  SELECT *, LEAD(close, 5) OVER ({W}) / close - 1 AS f_return, CASE WHEN COUNT(*) OVER {FWD} = 5 THEN MAX(high) OVER {FWD} / close - 1 END AS f_max_return,
    CASE WHEN COUNT(*) OVER {FWD} = 5 THEN MIN(low) OVER {FWD} / close - 1 END AS f_min_return FROM status) AS s""", "status")
cte("labr", "SELECT * REPLACE (ROUND(label_raw, 9) AS label_raw) FROM lab WHERE label_raw IS NOT NULL AND f_return IS NOT NULL", "lab")
cte("ranked", f"""SELECT *, CASE WHEN COUNT(*) OVER (PARTITION BY date) = 1 THEN 0.5 ELSE
  {avg_rank('label_raw', 'date, limit_threshold')} / (COUNT(*) OVER (PARTITION BY date, limit_threshold) + 1) END AS label FROM labr""", "labr")
q("x17_forward_return", CD + "f_return:6", "SELECT * FROM lab", "lab")(lambda m: lb.forward_returns(m.bars()))
q("x18_forward_path", CD + "f_max_return:6 f_min_return:6", "SELECT * FROM lab", "lab")(lambda m: lb.forward_path(m.bars()))
q("x19_path_label", CD + "label_raw:6", "SELECT * FROM lab", "lab")(lambda m: lb.path_label(m.bars()))


def labelled(m, bars=None):
    return lb.labelled(m.bars() if bars is None else bars).withColumn("label_raw", F.round("label_raw", 9))


def narrow(m):
    """The columns of ``labelled`` that ranks and their queries need."""
    return labelled(m).select("code", "date", "limit_threshold", "unbuyable", "label_raw")


q("x20_board_rank", CD + "label:6", "SELECT * FROM ranked", "ranked")(lambda m: lb.board_rank(labelled(m), bounded=True))
q("x20_board_rank_split", CD + "label:6", "SELECT * FROM ranked", "ranked")(lambda m: lb.board_rank(narrow(m)))
q("x21_unbuyable_penalty", CD + "label:6 unbuyable", "SELECT code, date, CASE WHEN unbuyable = 1 THEN 0.05 ELSE label END AS label, unbuyable FROM ranked", "ranked")(
    lambda m: lb.penalise(lb.board_rank(narrow(m))))
SPLIT = "(SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date, code) - 1 AS i, COUNT(*) OVER () AS n FROM labr) AS o WHERE i = FLOOR(n * 0.7::DOUBLE))"
q("x22_time_split", CD + "split_date is_train", f"SELECT code, date, s.d AS split_date, date < s.d AS is_train FROM labr CROSS JOIN (SELECT date AS d FROM {SPLIT} AS y) AS s", "labr")(
    lambda m: lb.time_split(labelled(m)))
q("x23_sample_weight", CD + "weight:6", """SELECT code, date, w / AVG(w) OVER () AS weight FROM (
  SELECT code, date, ABS(f_return / GREATEST(LEAST(limit_threshold, 0.3::DOUBLE), 0.04::DOUBLE)) AS w FROM labr) AS s""", "labr")(
    lambda m: lb.sample_weight(labelled(m)))
q("x24_relevance", CD + "relevance", f"""SELECT r.code, r.date, CAST((SELECT COUNT(*) FROM RANGE(1, 150) AS t(i) WHERE r.k2 * 150 > 2 * r.n * t.i) AS INT) AS relevance FROM (
  SELECT code, date, CAST(2 * {avg_rank('label_raw', 'date')} AS BIGINT) AS k2, COUNT(*) OVER (PARTITION BY date) AS n FROM labr) AS r""", "labr")(
    lambda m: lb.relevance(narrow(m), "label_raw"))
q("x25_tie_breaker", "code tie:6", """SELECT code, CAST((((((('0x' || SUBSTR(md5(code), 1, 8))::UBIGINT % 1000) * 296 + ('0x' || SUBSTR(md5(code), 9, 8))::UBIGINT) % 1000) * 296
  + ('0x' || SUBSTR(md5(code), 17, 8))::UBIGINT) % 1000 * 296 + ('0x' || SUBSTR(md5(code), 25, 8))::UBIGINT) % 1000 AS DOUBLE) / 100000 AS tie FROM stock_basic""", "stock_basic")(
    lambda m: m.stock_basic().withColumn("tie", lb.tie_breaker()))
