"""Query registry.

``@q(name, spec, body, ctes)`` registers a function of a :class:`Market`.
``spec`` lists the output columns; ``x:6`` rounds a double to 6 decimals on
both engines (after a shift far below the last kept digit, so that exact
half-way values, common with cent prices, round alike in both). ``body`` is the DuckDB check text over the named CTEs; without
it the query is checked by the tests only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantweave.catalog.sqlkit import CTES, DEPENDS
from quantweave.sources.market import Market

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, tuple[str, str, str, str]] = {}


def parse_spec(spec: str) -> list[tuple[str, int | None]]:
    out = []
    for item in spec.split():
        name, _, digits = item.partition(":")
        out.append((name, int(digits) if digits else None))
    return out


def nudge(digits: int) -> float:
    return 1.3 * 10.0 ** -(digits + 3)


def finish(df: DataFrame, spec: str) -> DataFrame:
    cols = []
    for name, digits in parse_spec(spec):
        c = F.col(name)
        if digits is not None:
            r = F.round(c.cast("double") + F.lit(nudge(digits)), digits)
            c = F.when(r == 0, F.lit(0.0)).otherwise(r)
        cols.append(c.alias(name))
    return df.select(*cols)


def with_clause(names: str, recursive: bool) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in DEPENDS.get(name, "").split():
            visit(dep)
        if name not in ordered:
            ordered.append(name)
    for n in names.split():
        visit(n)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(
        f"{n} AS {CTES[n]}" for n in ordered)


def oracle(spec: str, body: str, ctes: str = "bars", extra: str = "") -> str:
    """``extra`` is further CTE text placed after the named ones."""
    cols = []
    for name, digits in parse_spec(spec):
        if digits is None:
            cols.append(name)
        else:
            r = f"ROUND(CAST({name} AS DOUBLE) + CAST({nudge(digits)!r} AS DOUBLE), {digits})"
            cols.append(f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {name}")
    recursive = "UNION ALL SELECT" in extra and "/*rec*/" in extra
    head = with_clause(ctes, recursive) if ctes else "WITH nothing AS (SELECT 1)"
    if extra:
        head += ",\n" + extra
    return f"{head}\nSELECT {', '.join(cols)} FROM (\n{body}\n) AS result_rows"


def q(name: str, spec: str, body: str | None = None, ctes: str = "bars", extra: str = ""):
    def register(fn: Callable[[Market], DataFrame]):
        assert name not in QUERIES, name

        def run(spark: SparkSession, root: str) -> DataFrame:
            return finish(fn(Market(spark, root)), spec)
        QUERIES[name] = run
        if body is not None:
            CHECKS[name] = (spec, body, ctes, extra)
        return fn
    return register


def oracles() -> dict[str, str]:
    return {name: oracle(*args) for name, args in CHECKS.items()}
