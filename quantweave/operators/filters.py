"""Market rules, eligibility gates and row filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantweave.functions.windows import div, lag, lead
from quantweave.sources.payload import safe_double

# Three prefix maps that differ on purpose.
SYNC_PREFIXES = {"sh": ["60"], "sz_main": ["00"], "sz_gem": ["30"], "star": ["68"], "bj": ["8", "4", "9"]}
SELECTOR_PREFIXES = {"sh_main": ["60"], "star": ["68"], "sz_main": ["00"], "sz_gem": ["30"], "bj": ["43", "83", "87", "92"]}
TYPE_PREFIXES = {2: ["300", "301"], 3: ["688", "689"], 4: ["43", "83", "87", "88"]}
# Daily limit thresholds.
LIMITS = {"st": 0.045, "gem_star": 0.195, "bj": 0.295, "main": 0.095}


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes], F.lit(False))


def in_markets(c: Column, markets: Sequence[str], table: dict[str, list[str]]) -> Column:
    return starts_with_any(c, [p for m in markets for p in table.get(m, [])])


def codes_by_market(bars: DataFrame, markets: Sequence[str]) -> DataFrame:
    return bars.select("code").distinct().where(in_markets(F.col("code"), markets, SYNC_PREFIXES))


def market_type(code: str = "code", is_st: str = "is_st") -> Column:
    c = F.col(code)
    out = F.when(F.col(is_st) == 1, 5)
    for kind, prefixes in TYPE_PREFIXES.items():
        out = out.when(starts_with_any(c, prefixes), kind)
    return out.otherwise(1)


def limit_threshold(code: str = "code", is_st: str = "is_st") -> Column:
    c = F.col(code)
    return (F.when(F.col(is_st) == 1, LIMITS["st"])
            .when(starts_with_any(c, SYNC_PREFIXES["sz_gem"] + SYNC_PREFIXES["star"]), LIMITS["gem_star"])
            .when(starts_with_any(c, SYNC_PREFIXES["bj"]), LIMITS["bj"]).otherwise(LIMITS["main"]))


def status_flags(bars: DataFrame) -> DataFrame:
    """market_type, limit threshold, limit-up, suspended and unbuyable per bar."""
    df = bars.withColumn("_pc", lag("close"))
    change = div("close", "_pc") - 1
    df = df.withColumns({"market_type": market_type(), "limit_threshold": limit_threshold(),
                         "is_suspended": (F.coalesce("volume", F.lit(0.0)) == 0).cast("int")})
    hit = (F.col("close") == F.col("high")) & (change > F.col("limit_threshold"))
    df = df.withColumn("is_limit_up", F.coalesce(hit, F.lit(False)).cast("int"))
    return df.withColumn("unbuyable", F.greatest("is_limit_up", "is_suspended"))


def entry_gate(bars: DataFrame, signal_price: str = "close") -> DataFrame:
    """Next-session entry of every bar seen as a signal: the instrument must trade in
    the market's next session, with volume, and not open as a one-price limit-up bar."""
    from quantweave.operators.scans import calendar
    nxt = {f"_n{c}": lead(c) for c in ["date", "open", "high", "low", "close", "volume", "is_st"]}
    df = bars.withColumns(nxt).join(calendar(bars).select("date", "next_date"), "date", "left")
    limit = F.lit(1.0) + limit_threshold("code", "_nis_st")
    one_price = (F.col("_nopen") == F.col("_nhigh")) & (F.col("_nhigh") == F.col("_nlow")) & (F.col("_nlow") == F.col("_nclose"))
    reason = (F.when(F.col("next_date").isNull(), "no_session")
              .when(F.col("_ndate").isNull() | (F.col("_ndate") != F.col("next_date")), "no_bar")
              .when(F.coalesce("_nvolume", F.lit(0.0)) == 0, "suspended")
              .when(one_price & (F.col("_nopen") > F.col(signal_price) * limit), "limit_up"))
    df = df.withColumn("entry_reject", reason)
    ok = F.col("entry_reject").isNull()
    return df.withColumns({"entry_date": F.when(ok, F.col("_ndate")), "entry_price": F.when(ok, F.col("_nopen"))})


@dataclass(frozen=True)
class Criteria:
    """Screening defaults."""
    min_market_cap: float = 0.0
    max_pe: float | None = None
    min_price: float = 0.0
    max_price: float = 22.0
    include_st: bool = True
    max_debt: float | None = None
    markets: Sequence[str] = field(default_factory=lambda: ["sh_main", "sz_main"])


def reject_reason(c: Criteria, cap_gate: bool = True) -> Column:
    """First failing gate of the funnel, null when the instrument passes."""
    price = F.col("current_price")
    r = F.when(~F.coalesce("has_info", F.lit(False)), "no_info")
    if c.markets:
        r = r.when(~in_markets(F.col("code"), c.markets, SELECTOR_PREFIXES), "market")
    if not c.include_st:
        r = r.when((F.coalesce("is_st", F.lit(0)) == 1) | F.coalesce(F.col("code_name").contains("退"), F.lit(False)), "st")
    if cap_gate and c.min_market_cap > 0:
        r = r.when(F.col("market_cap") < c.min_market_cap, "market_cap")
    bad_pe = F.col("pe_ratio") <= 0
    if c.max_pe is not None:
        bad_pe = bad_pe | (F.col("pe_ratio") > c.max_pe)
    r = r.when(bad_pe, "pe")
    if c.max_debt is not None:
        r = r.when(F.col("debt_ratio") > c.max_debt, "debt")
    return r.when((price < c.min_price) | (price > c.max_price), "price")


def funnel(info: DataFrame, c: Criteria, cap_gate: bool = True) -> DataFrame:
    return info.withColumn("reject_reason", reject_reason(c, cap_gate))


def reject_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reject_reason", F.lit("passed")).alias("reject_reason")).agg(
        F.count(F.lit(1)).alias("n"))


def drop_metadata(df: DataFrame, use_amount: bool = False) -> DataFrame:
    extra = [] if use_amount else ["amount", "turnover_rate"]
    return df.drop("date", "is_st", "code", "fore_adjust_factor", "back_adjust_factor", *extra)


def valid_rows(df: DataFrame, features: Sequence[str], label: str, ret: str, start=None, end=None) -> DataFrame:
    from quantweave.operators.scans import between
    return between(df.dropna(subset=[*features, label, ret]), start, end)


def confident(df: DataFrame, min_confidence: float, ranking: bool) -> DataFrame:
    keep = F.col("prob") * 100 >= min_confidence
    return df.where(keep if ranking else keep & (F.col("prob") >= 0.5))


def limit_up_price(ref: str, is_st: str) -> Column:
    r = F.when(F.col(is_st) == 1, 0.05).otherwise(0.10)
    return F.floor(F.col(ref) * (1 + r) * 100) / 100


def limit_down_price(ref: str, is_st: str) -> Column:
    r = F.when(F.col(is_st) == 1, 0.05).otherwise(0.10)
    return (F.floor(F.col(ref) * (1 - r) * 100) + 1) / 100


def lot_size(orders: DataFrame, cash: float, ratio: float, buffer: float, keys: Sequence[str]) -> DataFrame:
    """Board-lot quantity per order; the budget divides cash over the orders of the same ``keys`` group."""
    n = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_orders"))
    budget = F.least(F.lit(cash) / F.col("n_orders"), F.lit(cash * ratio)) - buffer
    return orders.join(n, list(keys)).withColumn("quantity", F.floor(budget / F.col("limit_price") / 100) * 100)


def exchange_symbol(code: str = "code") -> Column:
    c = F.col(code)
    return (F.when(starts_with_any(c, ["60", "68"]), F.concat(F.lit("sh."), c))
            .when(starts_with_any(c, ["00", "30"]), F.concat(F.lit("sz."), c))
            .when(starts_with_any(c, SYNC_PREFIXES["bj"]), F.concat(F.lit("bj."), c)).otherwise(c))


def override(defaults: dict[str, float], layers: Sequence[Column]) -> dict[str, Column]:
    """Criteria columns: first JSON layer that names a key wins, else the default."""
    schema = ", ".join(f"{k} double" for k in defaults)
    parsed = [F.from_json(layer, schema) for layer in layers]
    return {k: F.coalesce(*[p[k] for p in parsed], F.lit(v)) for k, v in defaults.items()}


def numeric_clean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(safe_double(c), F.lit(0.0)) for c in cols})


def align(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Exactly the target features in order; missing ones are 0."""
    return df.select(*keys, *[F.col(f) if f in df.columns else F.lit(0.0).alias(f) for f in features])


def search(instruments: DataFrame, text: str, n: int = 15) -> DataFrame:
    hit = F.col("code").startswith(text) | F.col("code_name").contains(text)
    return instruments.where(hit).orderBy("code").limit(n)


def buy_signal(prob: str = "prob") -> Column:
    return F.when(F.col(prob) >= 0.5, "buy").otherwise("hold")
