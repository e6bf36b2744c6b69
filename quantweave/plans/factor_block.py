"""Base-factor assembly and the full factor pipeline."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from quantweave.functions.trailing import PLACE, numbered, one_pass
from quantweave.operators import adjust, breadth as br, candles, features, filters, fundamentals, joins, rolling
from quantweave.operators import technical as t
from quantweave.operators.kernels import ALL, output_columns
from quantweave.operators.recursive import recursive

STATUS = ["is_limit_up", "is_suspended", "market_type"]


def families() -> dict[str, list[str]]:
    """Factor families in assembly order; label-side columns are excluded."""
    return {"technical": t.WINDOW_FACTORS + [c for c in output_columns(ALL) if c != "atr_abs"], "candles": candles.CANDLE_FACTORS,
            "breadth": br.BREADTH, "status": STATUS, "fundamental": fundamentals.FUNDAMENTAL_FACTORS,
            "rolling": rolling.ROLLING_FACTORS}


def base_factors(bars: DataFrame, factors: DataFrame, reports: DataFrame) -> DataFrame:
    """One wide row per (code, date)."""
    return assembled(bars, factors, reports).drop(PLACE)


def assembled(bars: DataFrame, factors: DataFrame, reports: DataFrame, carry: Sequence[str] = (), lines: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """:func:`base_factors`, and the place of each row for passes to come. Per-instrument work first (a grouped map for the recursive indicators,
    the as-of and breadth joins, windows for running lines); the passes for all trailing aggregates and the forward fill come last and
    move no rows, so that none is shuffled once it is wide. ``carry`` names further columns of the bars that stay; ``lines`` adds columns by windows over the instrument."""
    raw = t.warm(bars, 60)
    adj = adjust.to_sample_end(raw, factors)
    market = br.breadth(adj)
    df = recursive(adj, keep=["open", "high", "low", "close", "volume", "amount", "is_st", *carry])
    df = joins.attach_breadth(fundamentals.fundamental_lines(df, reports), market, br.BREADTH)
    df = t.window_lines(t.base(filters.status_flags(df)))
    had = df.columns
    df = lines(df)
    added = [c for c in df.columns if c not in had]
    df = candles.shape(numbered(rolling.drawdown_line(df)))
    with one_pass() as p:
        columns = {**fundamentals.trend_cols(), **t.window_cols(), **rolling.rolling_cols(), **candles.context_cols(), **candles.strength_cols()}
    df = rolling.clean(p.on(df, columns))
    df = candles.ratios(candles.context_flags(df).withColumns(candles.signals()))
    df = t.fill_block(df, families()["technical"])
    keep = [c for cols in families().values() for c in cols]
    return df.select("code", "date", "open", "high", "low", "close", "volume", "is_st", "limit_threshold", "unbuyable", *keep, *carry, *added, PLACE)


def full_pipeline(bars: DataFrame, factors: DataFrame, reports: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """Assembly -> feature engineering -> fill -> clean -> align."""
    cols = [c for family in families().values() for c in family]
    df = features.transform_all(assembled(bars, factors, reports), cols).drop(PLACE)
    numeric = [c for c in df.columns if c not in ("code", "date")]
    df = filters.numeric_clean(df, numeric)
    return df if targets is None else filters.align(df, ["code", "date"], targets)
