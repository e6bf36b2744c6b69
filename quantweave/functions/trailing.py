"""Trailing aggregates of many columns in one pass over the rows of the instruments.

A frame aggregate goes through all rows of its frame again for every row. Inside ``one_pass`` the helpers of
``functions.windows`` (``sma``, ``rstd``, ``lag`` ...) only note what they are asked for and return the column that will hold it;
``on`` then works all of it out on arrays, and the formulas stay Spark columns.

Rows go through a pass in the order of ``numbered``: instruments in one piece, by date. A pass is a column function over the
Arrow batches of a partition, so it moves no rows, only its inputs reach Python, and passes can follow one another without a shuffle. It keeps the last rows of an
instrument that goes on in the next batch, and raises an error where the numbers of the rows don't follow one another.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.indexers import BaseIndexer
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ship the kernels with the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ASKED: ContextVar[Pass | None] = ContextVar("asked", default=None)
#: Number of a row inside its instrument, by date; while a table has it, its rows have not been moved.
PLACE = "_place"


def numbered(df: DataFrame) -> DataFrame:
    return df if PLACE in df.columns else df.withColumn(PLACE, F.row_number().over(Window.partitionBy("code").orderBy("date")))


class Pass:
    """The aggregates that one pass has to add, in the order in which they were asked for."""

    def __init__(self):
        self.inputs: dict[str, tuple[str, Column]] = {}
        self.steps: dict[tuple, str] = {}
        self.made: dict[str, str] = {}

    def _input(self, x: str | Column) -> str:
        c = F.col(x) if isinstance(x, str) else x
        if str(c) in self.made:  # the result of an earlier step
            return self.made[str(c)]
        return self.inputs.setdefault(str(c), (f"_x{len(self.inputs)}", c))[0]

    def add(self, op: str, n: int, *xs: str | Column) -> Column:
        """Column of ``op`` over the last ``n`` rows (``lag``: ``n`` rows earlier)."""
        key = (op, n, *[self._input(x) for x in xs])
        out = F.col(self.steps.setdefault(key, f"_t{len(self.steps)}"))
        self.made[str(out)] = self.steps[key]
        return out

    def on(self, df: DataFrame, columns: dict[str, Column]) -> DataFrame:
        """``df`` with ``columns``, which are formulas on what was asked for."""
        if not self.steps:
            return df.withColumns(columns)
        steps, reach = [(out, *key) for key, out in self.steps.items()], {}
        for out, _, n, *xs in steps:
            reach[out] = n + max(reach.get(x, 0) for x in xs)
        made = through(df, dict(self.inputs.values()), list(self.steps.values()), max(reach.values()), _steps(list(dict(self.inputs.values())), steps))
        return made.withColumns(columns).drop(*self.steps.values())


@contextmanager
def one_pass() -> Iterator[Pass]:
    token = ASKED.set(Pass())
    try:
        yield ASKED.get()
    finally:
        ASKED.reset(token)


def through(df: DataFrame, inputs: dict[str, Column], added: Sequence[str], reach: int, work: Callable) -> DataFrame:
    """``df`` with the double columns ``added`` that ``work(place, cells)`` makes of ``inputs``; a cell is (values, present), and a row
    may depend on the ``reach`` rows before it and on itself."""
    had = PLACE in df.columns
    wide = numbered(df).withColumns({name: c.cast("double") for name, c in inputs.items()})
    run = F.arrow_udf(_stream(list(added), reach, work), ", ".join(f"{c} double" for c in added)).asNondeterministic()  # never worked out twice, nor moved
    wide = wide.withColumn("_made", run(F.struct(F.xxhash64("code").alias("code"), PLACE, *inputs)))
    return wide.withColumns({c: F.col("_made")[c] for c in added}).drop("_made", *inputs, *([] if had else [PLACE]))


def _stream(added: Sequence[str], reach: int, work: Callable):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        before = None  # (code, place, cells) of the last rows of the batch before
        for batch in batches:
            code, place = batch.field(0).to_numpy(), batch.field(1).to_numpy().astype(np.int64)
            cells = [_cell(batch.field(i)) for i in range(2, batch.type.num_fields)]
            kept = 0
            if before is not None:
                kept = len(before[0])
                code, place = np.concatenate([before[0], code]), np.concatenate([before[1], place])
                cells = [(np.concatenate([a, x]), np.concatenate([b, there])) for (a, b), (x, there) in zip(before[2], cells, strict=True)]
            follows = (code[1:] == code[:-1]) & (place[1:] == place[:-1] + 1)
            if not (follows | (place[1:] == 1)).all() or (before is None and len(place) and place[0] != 1):
                raise ValueError("the rows of an instrument are not in one piece, by date")
            made = work(place, cells)
            yield pa.StructArray.from_arrays([pa.array(x[kept:], pa.float64(), mask=~there[kept:]) for x, there in made], added)
            if len(place):
                n = max(len(place) - int(min(place[-1], reach + 1)), 0)
                before = code[n:], place[n:], [(x[n:], there[n:]) for x, there in cells]
    return run


def _cell(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    there = c.is_valid().to_numpy(zero_copy_only=False) if c.null_count else np.ones(len(c), bool)
    return (c.fill_null(0.0) if c.null_count else c).to_numpy(), there


def _steps(given: Sequence[str], steps: Sequence[tuple]):
    def work(place, values):
        cells, held = dict(zip(given, values, strict=True)), {}  # centred frames, which several steps share
        with np.errstate(all="ignore"):
            for name, op, n, *xs in steps:
                cells[name] = _work(op, n, place, [cells[i] for i in xs], held.setdefault((n, *xs), {}))
        return [cells[name] for name, *_ in steps]
    return work


def filled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with the last known value of the double columns ``cols``."""
    return through(df, {f"_x{i}": F.col(c) for i, c in enumerate(cols)}, [f"_f{i}" for i in range(len(cols))], 0, _Filled()).withColumns(
        {c: F.col(f"_f{i}") for i, c in enumerate(cols)}).drop(*[f"_f{i}" for i in range(len(cols))])


class _Filled:
    """Keeps the filled last row of the batch before, which takes the place of its unfilled one."""

    def __init__(self):
        self.last = None

    def __call__(self, place, cells):
        at, out = np.arange(len(place)), []
        first = np.maximum(at - place + 1, 0)
        for i, (x, there) in enumerate(cells):
            if self.last is not None:
                x, there = x.copy(), there.copy()
                x[0], there[0] = self.last[i]
            known = np.maximum.accumulate(np.where(there, at, -1))
            out.append((x[known], known >= first))
        if len(place):
            self.last = [(x[-1], there[-1]) for x, there in out]
        return out


def ranked(df: DataFrame, cols: Sequence[str], window: int, need: int, prefix: str) -> DataFrame:
    """``df`` with the average-tie percentile of each of ``cols`` in its last ``window`` rows, null without ``need`` values. Rows without
    code or date have no rank and take part in none."""
    whole = F.col("code").isNotNull() & F.col("date").isNotNull()
    return through(df, {f"_x{i}": F.when(whole, F.col(c)) for i, c in enumerate(cols)}, [prefix + c for c in cols], window - 1, _ranks(window, need))


class _Frames(BaseIndexer):
    """The last ``window_size`` rows of the same instrument."""

    def __init__(self, place, window: int):
        super().__init__(window_size=window)
        self.place = place

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        end = np.arange(1, num_values + 1, dtype=np.int64)
        return np.maximum(end - np.minimum(self.place, self.window_size), 0), end


def _ranks(window: int, need: int):
    def work(place, cells):
        out = []
        for x, there in cells:
            s = pd.Series(np.where(there, x, np.nan))
            r = s.rolling(_Frames(place, window), min_periods=need).rank(pct=True).to_numpy()
            out.append((r, ~np.isnan(r) & s.notna().to_numpy()))
        return out
    return work


def _frames(x: np.ndarray, n: int) -> np.ndarray:
    """The frames of ``n`` values as columns, oldest value first: a view."""
    x = np.ascontiguousarray(x)
    return np.ndarray((n, len(x) - n + 1), x.dtype, x, 0, (x.itemsize, x.itemsize))


def _work(op: str, n: int, place: np.ndarray, given: list[tuple[np.ndarray, np.ndarray]], held: dict) -> tuple[np.ndarray, np.ndarray]:
    """(values, present) of one step; all but ``lag`` and the two ages need ``n`` present values."""
    x, there = given[0]
    size = len(x)
    value, ok = np.zeros(size), np.zeros(size, bool)
    if op == "lag":
        value[n:], ok[n:] = x[:max(size - n, 0)], there[:max(size - n, 0)] & (place[n:] > n)
        return value, ok
    if size < n:
        return value, ok
    whole = place[n - 1:] >= n  # frames of one instrument
    some = None if 2 * whole.sum() > len(whole) else np.flatnonzero(whole)  # only these are worked out

    def frames(v):
        w = _frames(v, n)
        return w if some is None else w[:, some]
    rows = slice(n - 1, None) if some is None else some + n - 1
    if op in ("age_max", "age_min"):
        # Nulls sort below all values, NaN above; of equal values the latest counts.
        w = frames(np.where(there, np.where(np.isnan(x), np.inf, x), -np.inf))[::-1]
        value[rows], ok[n - 1:] = w.argmax(axis=0) if op == "age_max" else w.argmin(axis=0), whole
        return value, ok
    for _, t in given[1:]:
        there = there & t
    if there.all():
        ok[n - 1:] = whole
    else:
        count = np.concatenate([[0], np.cumsum(there)])
        ok[n - 1:] = whole & (count[n:] - count[:-n] == n)
    w = frames(x)
    if op == "fall_square":
        top = w.max(axis=0)
        value[rows] = ((x[rows] - top) / top) ** 2
        ok[rows] &= top != 0
    else:
        value[rows] = _aggregate(op, n, w, frames(given[1][0]) if len(given) > 1 else None, held)
        if op in ("skewness", "kurtosis"):
            ok[rows] &= ~np.isneginf(value[rows])  # equal values have neither
    return value, ok


def _centred(w: np.ndarray) -> np.ndarray:
    d = w - w[0]  # equal values give exact zeros
    d -= d.mean(axis=0)
    return d


def _squares(d: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->j", d, d)


def _aggregate(op: str, n: int, w: np.ndarray, other: np.ndarray | None, held: dict) -> np.ndarray:
    if op in ("sum", "avg"):
        total = np.add.reduce(w, axis=0)
        return total if op == "sum" else total / n
    if op == "max":
        return w.max(axis=0)
    if op == "min":
        return np.fmin.reduce(w, axis=0)
    if op == "slope":
        # Row by row, as ``regr_slope`` adds up, so that slopes near 0 round alike.
        mean, moment = w[0], np.zeros(w.shape[1])
        for k in range(1, n):
            mean = mean + (w[k] - mean) / (k + 1)
            moment += (k + 1) / 2 * (w[k] - mean)
        return moment / (n * (n * n - 1) / 12)
    if "d" not in held:
        held["d"] = _centred(w)
    d = held["d"]
    if op == "mean_abs_dev":
        return np.abs(d).sum(axis=0) / n
    if op == "covar_samp":
        return np.einsum("ij,ij->j", d, _centred(other)) / (n - 1)
    if "m2" not in held:
        held["m2"] = _squares(d)
    m2 = held["m2"]
    if op in ("var_samp", "stddev_samp", "stddev_pop"):
        v = m2 / (n if op == "stddev_pop" else n - 1)
        return v if op == "var_samp" else np.sqrt(v)
    if op == "skewness":
        return np.where(m2 == 0, -np.inf, np.sqrt(n) * np.einsum("ij,ij,ij->j", d, d, d) / m2 ** 1.5)
    if op == "kurtosis":
        return np.where(m2 == 0, -np.inf, n * _squares(d * d) / (m2 * m2) - 3)
    raise ValueError(op)
