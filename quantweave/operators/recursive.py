"""Indicators whose value depends on their own previous value.

A window frame cannot see its own output, so these run as one grouped map per
instrument. A group is at most one row per session (``(code, date)`` is the
bar key), and all requested indicators are computed in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantweave.functions.periods import PERIODS
from quantweave.operators import kernels
from quantweave.operators.kernels import ALL, indicator_table, output_columns

# Ship the kernels with the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(kernels)

INPUT = ["code", "date", "open", "high", "low", "close", "volume"]


def recursive(df: DataFrame, which: Sequence[str] = ALL, params: dict | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``code, date`` plus the columns of the requested indicators; ``keep`` columns pass
    through, which saves joining the result back to the bars."""
    p = {**PERIODS, **(params or {})}
    which, keep = list(which), list(keep)
    source = df.select(*INPUT, *[c for c in keep if c not in INPUT])
    schema = T.StructType([source.schema[c] for c in ["code", "date", *keep]] + [
        T.StructField(c, T.DoubleType()) for c in output_columns(which)])

    build = indicator_table

    def kernel(pdf):
        pdf = pdf.sort_values("date")
        g = {c: pdf[c].to_numpy(dtype=float) for c in INPUT[2:]}
        out = {"code": pdf["code"].to_numpy(), "date": pdf["date"].to_numpy(), **{c: pdf[c].to_numpy() for c in keep}}
        table = build(p)
        for w in which:
            names, f = table[w]
            out.update(zip(names, f(g)))
        return pd.DataFrame(out)  # NaN becomes null on the way to Arrow
    return source.groupBy("code").applyInPandas(kernel, schema)
