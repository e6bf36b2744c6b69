"""X01-X14, X26, X27: feature engineering and assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantweave.catalog.core import CHECKS, q
from quantweave.catalog.filters import TYPE
from quantweave.catalog.joins import reports
from quantweave.catalog.sqlkit import NUM, W, cte, fr, g, lagx
from quantweave.operators import features as x
from quantweave.operators import fundamentals as fu
from quantweave.operators import joins
from quantweave.operators import rolling as r
from quantweave.operators import technical as t
from quantweave.plans import factor_block as fb

CD = "code date "
cte("feat", f"""SELECT code, date, rn, close, volume, (close / {lagx('close', 60)} - 1) * 100 AS roc, COALESCE(100 * (close / {g('AVG', 'close', 36)} - 1), 0) AS bias,
  COALESCE({g('AVG', 'volume', 5)} / {g('AVG', 'volume', 25)}, 0) AS vol_ma FROM b""", "b")
cte("featf", """SELECT f.*, p.epsTTM, p.totalShare, p.roeAvg, p.YOYPNI FROM feat f JOIN pit p ON p.code = f.code AND p.date = f.date""", "feat pit")


def feat(m):
    return t.ma_pair(t.bias(t.roc(t.base(m.bars()))), "volume", 5, "vol_ma").select("code", "date", "close", "volume", "roc", "bias", "vol_ma")


def featf(m):
    df = t.ma_pair(t.bias(t.roc(t.base(fu.pit_series(m.bars(), reports(m))))), "volume", 5, "vol_ma")
    return df.select("code", "date", "close", "volume", "roc", "bias", "vol_ma", "epsTTM", "totalShare", "roeAvg", "YOYPNI")


q("x01_ratio", CD + "roc_div_bias:3 close_div_vol_ma:6", """SELECT code, date, COALESCE(roc / NULLIF(bias, 0), 0) AS roc_div_bias,
  COALESCE(close / NULLIF(vol_ma, 0), 0) AS close_div_vol_ma FROM (SELECT *, ROUND(roc, 6) AS roc, ROUND(bias, 6) AS bias FROM (SELECT code, date, close, vol_ma, roc, bias FROM feat) AS s0)
  AS s""".replace("SELECT *, ROUND(roc, 6) AS roc, ROUND(bias, 6) AS bias", "SELECT code, date, close, vol_ma, ROUND(roc, 6) AS roc, ROUND(bias, 6) AS bias"), "feat")(
    lambda m: x.ratios(feat(m).withColumns({"roc": F.round("roc", 6), "bias": F.round("bias", 6)}), ["roc", "close"], ["bias", "vol_ma"]))
q("x02_product", CD + "roc_mul_bias:5 close_mul_vol_ma:5", """SELECT code, date, COALESCE(roc * bias, 0) AS roc_mul_bias, COALESCE(close * vol_ma, 0) AS close_mul_vol_ma FROM feat""",
  "feat")(lambda m: x.products(feat(m), [("roc", "bias"), ("close", "vol_ma")]))
q("x03_difference", CD + "roc_sub_bias:5 close_sub_vol_ma:5", """SELECT code, date, COALESCE(roc - bias, 0) AS roc_sub_bias, COALESCE(close - vol_ma, 0) AS close_sub_vol_ma FROM feat""",
  "feat")(lambda m: x.differences(feat(m), [("roc", "bias"), ("close", "vol_ma")]))
q("x04_polynomial", CD + "roc_sq:4 roc_bias:4 bias_sq:4 roc_bias_sq:3", """SELECT code, date, COALESCE(roc, 0) * COALESCE(roc, 0) AS roc_sq, COALESCE(roc, 0) * bias AS roc_bias,
  bias * bias AS bias_sq, COALESCE(roc, 0) * bias * bias AS roc_bias_sq FROM feat""", "feat")(
    lambda m: x.polynomials(feat(m), ["roc", "bias"], 3).withColumnsRenamed(
        {"roc^2": "roc_sq", "roc bias": "roc_bias", "bias^2": "bias_sq", "roc bias^2": "roc_bias_sq"}))
q("x05_log", CD + "log_roc:5 log_volume:6", """SELECT code, date, CASE WHEN roc IS NULL THEN 0 ELSE LN(GREATEST(roc, 1e-10)) END AS log_roc, LN(volume) AS log_volume
  FROM (SELECT code, date, volume, ROUND(roc, 6) AS roc FROM feat) AS s""", "feat")(
    lambda m: x.logs(feat(m).withColumn("roc", F.round("roc", 6)), ["roc", "volume"]))
q("x06_sqrt", CD + "sqrt_roc:5 sqrt_volume:6", """SELECT code, date, CASE WHEN roc IS NULL THEN 0 ELSE SQRT(GREATEST(roc, 0)) END AS sqrt_roc, SQRT(volume) AS sqrt_volume
  FROM (SELECT code, date, volume, ROUND(roc, 6) AS roc FROM feat) AS s""", "feat")(
    lambda m: x.roots(feat(m).withColumn("roc", F.round("roc", 6)), ["roc", "volume"]))


def pr(col, n, need):
    return f"""SELECT a.code, a.date, CASE WHEN COUNT(*) >= {need} THEN (COUNT(CASE WHEN z.{col} < a.{col} THEN 1 END)
    + (COUNT(CASE WHEN z.{col} = a.{col} THEN 1 END) + 1) / 2.0) / COUNT(*) END AS pr
  FROM b a JOIN b z ON z.code = a.code AND z.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY a.code, a.date, a.{col}"""


q("x07_rolling_rank", CD + "rank_close:8", f"SELECT code, date, pr AS rank_close FROM ({pr('close', 252, 126)}) AS s", "b")(
    lambda m: x.rolling_rank(m.bars().select("code", "date", "close"), ["close"]))
q("x08_quantile_bucket", CD + "quantile_volume", f"SELECT code, date, CAST(CASE WHEN pr IS NULL THEN 0 ELSE LEAST(FLOOR(pr * 5 + 1e-12), 4) END AS INT) AS quantile_volume FROM ({pr('volume', 252, 63)}) AS s", "b")(
    lambda m: x.quantile_bucket(m.bars().select("code", "date", "volume"), ["volume"]))
q("x09_interaction", CD + "roc_x_roeAvg:5 bias_x_YOYPNI:4 bias_x_roeAvg:5", """SELECT code, date, COALESCE(roc * roeAvg, 0) AS roc_x_roeAvg, COALESCE(bias * YOYPNI, 0) AS bias_x_YOYPNI,
  COALESCE(bias * roeAvg, 0) AS bias_x_roeAvg FROM featf""", "featf")(lambda m: x.interactions(featf(m), ["roc", "bias"], ["roeAvg", "YOYPNI"]))
q("x10_momentum_features", CD + "close_mom_5:6 close_mom_10:6 close_mom_20:6", "SELECT code, date, " + ", ".join(
    f"COALESCE(close / {lagx('close', k)} - 1, 0) AS close_mom_{k}" for k in (5, 10, 20)) + " FROM bars")(
    lambda m: x.momentum(m.bars(), ["close"]))
q("x11_volatility_features", CD + "close_vol_5:6 close_vol_10:6 close_vol_20:6", "SELECT code, date, " + ", ".join(
    f"COALESCE({g('STDDEV_SAMP', 'close', k)}, 0) AS close_vol_{k}" for k in (5, 10, 20)) + " FROM bars")(
    lambda m: x.volatility(m.bars(), ["close"]))
IND = "SELECT b.code, b.date, s.industry FROM bars b LEFT JOIN stock_basic s ON s.code = b.code AND CAST(SUBSTR(b.code, 4) AS BIGINT) % 6 <> 1"


def industries(m):
    dim = m.stock_basic().where(F.substring("code", 4, 20).cast("long") % 6 != 1)
    return joins.lookup(m.bars(), dim, "industry")


q("x12_categorical", CD + "industry industry_encoded industry_top", f"""SELECT i.code, i.date, i.industry, COALESCE(d.idx, 0) AS industry_encoded,
  CASE WHEN d.place <= 10 THEN d.place ELSE 0 END AS industry_top FROM ({IND}) AS i LEFT JOIN (SELECT industry, ROW_NUMBER() OVER (ORDER BY industry) AS idx,
    ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, industry) AS place FROM ({IND}) AS j WHERE industry IS NOT NULL GROUP BY industry) AS d ON d.industry = i.industry""",
  "bars stock_basic")(lambda m: x.encode(industries(m), "industry"))
q("x12_one_hot", "n_hot n_rows", f"""SELECT CAST(COUNT(CASE WHEN d.place <= 10 THEN 1 END) AS BIGINT) AS n_hot, COUNT(*) AS n_rows FROM ({IND}) AS i
  LEFT JOIN (SELECT industry, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, industry) AS place FROM ({IND}) AS j WHERE industry IS NOT NULL GROUP BY industry) AS d
    ON d.industry = i.industry""", "bars stock_basic")(
    lambda m: (lambda df: df.agg(F.sum(sum(F.col(c) for c in df.columns if c.startswith("industry_"))).cast("long").alias("n_hot"),
                                 F.count(F.lit(1)).alias("n_rows")))(x.one_hot(industries(m), "industry")))
FEATURES13 = ["roc", "bias", "vol_ma", "epsTTM", "totalShare", "roeAvg", "YOYPNI"]


def generated_columns():
    """Names the pipeline draws from FEATURES13, each with its own SQL; the draw depends on names only."""
    tech = x.matching(FEATURES13, x.TECHNICAL_KEYWORDS, 100)
    fund = x.matching(FEATURES13, x.FUNDAMENTAL_KEYWORDS, 60)
    ten, four, six, five = x.pick(fund, 10), x.pick(tech, 4), x.pick(tech, 6), x.pick(fund, 5)
    out = {f"{a}_div_{b}": f"COALESCE({a} / NULLIF({b}, 0), 0)" for a in ten[:5] for b in ten[5:10] if a != b}
    out |= {f"{a}_mul_{b}": f"COALESCE({a} * {b}, 0)" for i, a in enumerate(four) for b in four[i + 1:]}
    out |= {f"{a}_sub_{b}": f"COALESCE({a} - {b}, 0)" for i, a in enumerate(six) for b in six[i + 1:]}
    out |= {f"{a}_x_{b}": f"COALESCE({a} * {b}, 0)" for a in six for b in five}
    volume = [c for c in tech if "vol" in c.lower() or "amount" in c.lower()]
    logs = x.pick([c for c in fund if any(k in c.lower() for k in x.LOG_KEYWORDS)] + volume, 8)
    out |= {f"log_{c}": f"CASE WHEN {c} IS NULL THEN 0 ELSE LN(GREATEST({c}, 1e-10)) END" for c in logs}
    out |= {f"sqrt_{c}": f"CASE WHEN {c} IS NULL THEN 0 ELSE SQRT(GREATEST({c}, 0)) END" for c in x.pick(volume, 5)}
    return out


def trailing_rank(col, n=252, need=126):
    return f"""SELECT a.code, a.date, CASE WHEN a.{col} IS NOT NULL AND COUNT(z.{col}) >= {need} THEN (COUNT(CASE WHEN z.{col} < a.{col} THEN 1 END)
    + (COUNT(CASE WHEN z.{col} = a.{col} THEN 1 END) + 1) / 2.0) / COUNT(z.{col}) END AS pr
  FROM featf a JOIN featf z ON z.code = a.code AND z.rn BETWEEN a.rn - {n - 1} AND a.rn GROUP BY a.code, a.date, a.{col}"""


GEN = generated_columns()
RANKED = x.pick(x.matching(FEATURES13, x.FUNDAMENTAL_KEYWORDS, 60), 15)
X13 = (f"SELECT f.code, f.date, {', '.join(f'{e} AS {c}' for c, e in GEN.items())}, {', '.join(f'r_{c}.pr AS rank_{c}' for c in RANKED)}, "
       f"""COALESCE(d.idx, 0) AS industry_encoded, CASE WHEN d.place <= 10 THEN d.place ELSE 0 END AS industry_top
  FROM featf f LEFT JOIN ({IND}) AS i ON i.code = f.code AND i.date = f.date
  LEFT JOIN (SELECT industry, ROW_NUMBER() OVER (ORDER BY industry) AS idx, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, industry) AS place FROM ({IND}) AS j WHERE industry IS NOT NULL GROUP BY industry) AS d
    ON d.industry = i.industry """ + " ".join(f"LEFT JOIN ({trailing_rank(c)}) AS r_{c} ON r_{c}.code = f.code AND r_{c}.date = f.date" for c in RANKED))


def every_step(m):
    dim = m.stock_basic().where(F.substring("code", 4, 20).cast("long") % 6 != 1)
    return x.transform_all(joins.lookup(featf(m), dim, "industry"), FEATURES13, categories=["industry"])


q("x13_transform_pipeline", CD + " ".join(f"{c}:3" for c in GEN) + " " + " ".join(f"rank_{c}:8" for c in RANKED) + " industry_encoded industry_top", X13, "featf bars stock_basic")(every_step)
for method, sql in [("zero", "COALESCE(roc, 0)"), ("mean", "COALESCE(roc, AVG(roc) OVER ())"), ("median", "COALESCE(roc, MEDIAN(roc) OVER ())"),
                    ("forward", f"COALESCE(LAST_VALUE(roc IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 0)"),
                    ("backward", f"COALESCE(FIRST_VALUE(roc IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")]:
    q(f"x14_fill_{method}", CD + "roc:5", f"SELECT code, date, {sql} AS roc FROM (SELECT code, date, CASE WHEN CAST(volume AS BIGINT) % 4 <> 0 THEN roc END AS roc FROM feat) AS s",
      "feat")(lambda m, method=method: x.fill(feat(m).withColumn("roc", F.when(F.col("volume") % 4 != 0, F.col("roc"))), ["roc"], method))
q("x26_base_factors", CD + "roc:5 bias:5 doji hammer up_ratio:6 market_type epsTTM:6 dynamic_pe:8 price_volatility_20:6 return_60d:6", f"""SELECT a.code, a.date,
  COALESCE((a.close / {lagx('a.close', 60).replace('PARTITION BY code ORDER BY date', 'PARTITION BY a.code ORDER BY a.date')} - 1) * 100, 0) AS roc,
  COALESCE(100 * (a.close / CASE WHEN a.rn >= 36 THEN a.m36 END - 1), 0) AS bias,
  CASE WHEN ABS(a.close - a.open) < a.close * 0.003::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS doji,
  CASE WHEN {{hammer}} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hammer, x.up_ratio, {TYPE.replace('code LIKE', 'a.code LIKE').replace('is_st', 'a.is_st')} AS market_type,
  p.epsTTM, a.close / p.epsTTM AS dynamic_pe, COALESCE(a.v20, 0) AS price_volatility_20, COALESCE(a.r60, 0) AS return_60d
  FROM ab a JOIN ax x ON x.date = a.date JOIN pit p ON p.code = a.code AND p.date = a.date""".replace(
      "{hammer}", """a.ls > a.sb * 1.5::DOUBLE AND a.us < a.sb * 0.5::DOUBLE AND a.pos < 0.3::DOUBLE AND NOT COALESCE(a.wid < 0.07::DOUBLE, FALSE)
      AND NOT COALESCE(a.wid < 0.12::DOUBLE AND ABS(a.close / a.m20 - 1) < 0.02::DOUBLE, FALSE)"""), "adj pit", f"""aa AS MATERIALIZED (SELECT *, ROW_NUMBER() OVER ({W}) AS rn,
    close / {lagx('close')} - 1 AS ret, AVG(close) OVER {fr(36)} AS m36, {g('AVG', 'close', 20)} AS m20, LEAST(open, close) - low AS ls, high - GREATEST(open, close) AS us,
    GREATEST(ABS(close - open), close * 0.001::DOUBLE) AS sb, {g('MAX', 'high', 20)} AS h20, {g('MIN', 'low', 20)} AS l20, close / {lagx('close', 60)} - 1 AS r60 FROM adj),
ab AS MATERIALIZED (SELECT *, {g('STDDEV_SAMP', 'ret', 20)} AS v20, (close - l20) / CASE WHEN h20 = l20 THEN 1e-6 ELSE h20 - l20 END AS pos, (h20 - l20) / l20 AS wid FROM aa),
ax AS MATERIALIZED (SELECT date, AVG(CASE WHEN close > open * 1.0001::DOUBLE THEN 1 ELSE 0 END) AS up_ratio FROM adj GROUP BY date)""")(
    lambda m: fb.base_factors(m.bars(), m.adjust_factor(), reports(m)))
_, X26, X26_CTES, X26_EXTRA = CHECKS["x26_base_factors"]
q("x27_full_pipeline", CD + "roc:5 bias:5 doji hammer up_ratio:6 market_type:1 epsTTM:6 dynamic_pe:8 price_volatility_20:6 absent",
  f"""SELECT code, date, roc, bias, doji, hammer, up_ratio, market_type, COALESCE(epsTTM, 0) AS epsTTM, COALESCE(dynamic_pe, 0) AS dynamic_pe, price_volatility_20,
  CAST(0 AS DOUBLE) AS absent FROM ({X26}) AS base""", X26_CTES, X26_EXTRA)(
    lambda m: fb.full_pipeline(m.bars(), m.adjust_factor(), reports(m), ["roc", "bias", "doji", "hammer", "up_ratio", "market_type", "epsTTM", "dynamic_pe",
                                                                         "price_volatility_20", "absent"]))
