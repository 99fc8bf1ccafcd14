"""One-dimensional maps: iteration, Lyapunov exponents by several methods, bifurcation points.

Every parameter value is a row and a fold over the steps, so a sweep needs no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div, ieee_ln

DELTA, TAIL = 1e-10, 300


def logistic(x: Column, r: Column) -> Column:
    return r * x * (1 - x)


def _steps(n: int) -> Column:
    return F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")


def iterate(r: Column, x0: float, n: int) -> Column:
    return F.aggregate(_steps(n), F.lit(float(x0)), lambda x, _: logistic(x, r))


def lyapunov_direct(r: Column, x0: float, n: int, discard: int = 100, base2: bool = False) -> Column:
    """Mean log growth of a small distance. A distance of 0 makes everything after it -inf or NaN, as in the method."""
    kind = "struct<x:double,le:double,delta:double>"
    start = F.struct(iterate(r, x0, discard).alias("x"), F.lit(0.0).alias("le"), F.lit(DELTA).alias("delta")).cast(kind)

    def step(acc: Column, _: Column) -> Column:
        new = logistic(acc["x"], r)
        gap = F.abs(logistic(acc["x"] + acc["delta"], r) - new)
        # gap / |gap| * delta: delta again, or NaN
        kept = F.when((gap == 0) | F.isnan(gap), F.lit(math.nan)).otherwise(acc["delta"])
        return F.struct(new.alias("x"), (acc["le"] + ieee_ln(F.abs(ieee_div(gap, acc["delta"])))).alias("le"), kept.alias("delta")).cast(kind)

    mean = F.aggregate(_steps(n), start, step, lambda acc: acc["le"]) / F.lit(float(n))
    return mean / F.lit(math.log(2)) if base2 else mean


def lyapunov_derivative(r: Column, x0: float, n: int, discard: int = 100) -> Column:
    """Mean of ln |f'(x)|, f' = r (1 - 2 x)."""
    kind = "struct<x:double,le:double>"
    start = F.struct(iterate(r, x0, discard).alias("x"), F.lit(0.0).alias("le")).cast(kind)
    step = lambda acc, _: F.struct(logistic(acc["x"], r).alias("x"), (acc["le"] + ieee_ln(F.abs(r * (1 - 2 * acc["x"])))).alias("le")).cast(kind)
    return F.aggregate(_steps(n), start, step, lambda acc: acc["le"]) / F.lit(float(n))


def tail(r: Column, x0: float, n: int, discard: int = 100, last: int = TAIL) -> Column:
    """The last iterates: ``last`` of n."""
    first = iterate(r, x0, discard + max(0, n - last))
    start = F.struct(first.alias("x"), F.array().cast("array<double>").alias("t"))
    step = lambda acc, _: F.struct(logistic(acc["x"], r).alias("x"), F.concat(acc["t"], F.array(logistic(acc["x"], r))).alias("t"))
    return F.aggregate(_steps(min(n, last)), start, step, lambda acc: acc["t"])


def spread(grid: DataFrame, tasks: int = 0) -> DataFrame:
    """The rows of a sweep over all cores."""
    return grid.repartition(tasks or grid.sparkSession.sparkContext.defaultParallelism)


def sweep(grid: DataFrame, x0: float = 0.5, n: int = 10_000, discard: int = 100) -> DataFrame:
    """``id, r, le, tail``."""
    r = F.col("r")
    return spread(grid).select("id", "r", lyapunov_direct(r, x0, n, discard).alias("le"), tail(r, x0, n, discard).alias("tail"))


def bifurcation(swept: DataFrame) -> DataFrame:
    return swept.select("id", "r", F.posexplode("tail").alias("step", "x"))


def sign_class(le: Column) -> Column:
    return F.when(le > 0, "diverges").when(le < 0, "converges").otherwise("neutral")


def sum_class(spectrum: Column) -> Column:
    """Of the sum of a spectrum: 0 conservative, below dissipative, above chaotic."""
    total = F.aggregate(spectrum, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.abs(total) < 1e-9, "conservative").when(total < 0, "dissipative").otherwise("chaotic")


def fractal_dimension(spectrum: Column) -> Column:
    """Kaplan and Yorke's, from a spectrum sorted downwards."""
    s = F.sort_array(spectrum, asc=False)
    sums = F.transform(s, lambda _, i: F.aggregate(F.slice(s, F.lit(1), i + 1), F.lit(0.0), lambda a, x: a + x))
    j = F.size(F.filter(sums, lambda v: v >= 0))
    part = F.get(sums, j - 1) / F.abs(F.get(s, j))
    return F.when(j == 0, F.lit(0.0)).when(j == F.size(s), j.cast("double")).otherwise(j + part)


def henon(state: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The next states (systems x 2) of Henon maps with parameters a and b, and their Jacobians."""
    x, y = state.T
    one, zero = np.ones_like(x), np.zeros_like(x)
    jac = np.stack([np.stack([-2 * p["a"] * x, one], 1), np.stack([p["b"], zero], 1)], 1)
    return np.stack([1 - p["a"] * x * x + y, p["b"] * x], 1), jac


def lorenz(state: np.ndarray, p: dict[str, np.ndarray], h: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """The next states (systems x 3) of Lorenz flows (sigma, rho, beta) after a Runge-Kutta step of ``h``, and the step's Jacobians."""

    def slope(s: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y, z = s.T
        one, zero = np.ones_like(x), np.zeros_like(x)
        jac = np.stack([np.stack([-p["sigma"], p["sigma"], zero], 1), np.stack([p["rho"] - z, -one, -x], 1), np.stack([y, x, -p["beta"]], 1)], 1)
        return np.stack([p["sigma"] * (y - x), x * (p["rho"] - z) - y, x * y - p["beta"] * z], 1), jac @ m

    m = np.broadcast_to(np.eye(3), (len(state), 3, 3))
    a, ma = slope(state, m)
    b, mb = slope(state + h / 2 * a, m + h / 2 * ma)
    c, mc = slope(state + h / 2 * b, m + h / 2 * mb)
    d, md = slope(state + h * c, m + h * mc)
    return state + h / 6 * (a + 2 * b + 2 * c + d), m + h / 6 * (ma + 2 * mb + 2 * mc + md)


def spectrum_qr(systems: DataFrame, n: int = 2000, discard: int = 100, step=henon, start: tuple[float, ...] = (0.1, 0.1), time: float = 1.0, base2: bool = False) -> DataFrame:
    """``id, spectrum`` of systems (id and the columns that ``step`` takes as parameters) by QR of the Jacobian along the orbit,
    all systems of a batch at once. ``time`` is what a step takes; ``base2`` gives bits."""
    names = [c for c in systems.columns if c != "id"]
    unit = time * n * (math.log(2) if base2 else 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = {c: batch[c].to_numpy(float) for c in names}
            state = np.tile(np.array(start, float), (len(batch), 1))
            q, total = np.broadcast_to(np.eye(len(start)), (len(batch), len(start), len(start))), np.zeros((len(batch), len(start)))
            for i in range(n + discard if len(batch) else 0):
                state, jac = step(state, p)
                q, r = np.linalg.qr(jac @ q)
                if i >= discard:
                    total += np.log(np.abs(np.diagonal(r, axis1=1, axis2=2)))
            yield pd.DataFrame({"id": batch["id"], "spectrum": list(-np.sort(-total / unit, axis=1))})

    return systems.mapInPandas(run, "id bigint, spectrum array<double>")


def largest_wolf(series: DataFrame, horizon: int = 1, gap: int = 10, least: float = 1e-3) -> DataFrame:
    """``id, le`` of scalar series (id, xs) by Wolf's method: follow a neighbour of the orbit (embedding of 2, at a distance of at
    least ``least``) for ``horizon`` steps, add the log growth of the distance, then take a fresh neighbour of the new point."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                v = np.asarray(row.xs, float)
                e = np.stack([v[:-1], v[1:]], 1)
                m, at, total, taken = len(e) - horizon, 0, 0.0, 0
                while at < m:
                    d = np.sqrt(((e[:m] - e[at]) ** 2).sum(1))
                    d[max(0, at - gap) : at + gap + 1] = np.inf
                    d[d < least] = np.inf
                    near = int(d.argmin())
                    after = float(np.sqrt(((e[at + horizon] - e[near + horizon]) ** 2).sum()))
                    if np.isfinite(d[near]) and after > 0:
                        total += math.log(after / d[near])
                        taken += horizon
                    at += horizon
                out.append((row.id, total / taken if taken else math.nan))
            yield pd.DataFrame(out, columns=["id", "le"])

    return series.select("id", "xs").mapInPandas(run, "id bigint, le double")


def largest_rosenstein(series: DataFrame, reach: int = 10, gap: int = 10) -> DataFrame:
    """``id, le`` of scalar series (id, xs) by the divergence of nearest neighbours (embedding of 2)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                v = np.asarray(row.xs, float)
                e = np.stack([v[:-1], v[1:]], 1)
                m = len(e) - reach
                near = np.empty(m, int)
                for i in range(m):  # a row at a time: memory grows with the series, not its square
                    d = ((e[:m] - e[i]) ** 2).sum(1)
                    d[max(0, i - gap) : i + gap + 1] = np.inf
                    near[i] = d.argmin()
                curve = []
                for k in range(reach):
                    d = np.sqrt(((e[np.arange(m) + k] - e[near + k]) ** 2).sum(1))
                    curve.append(np.log(d[d > 0]).mean())
                out.append((row.id, float(np.polyfit(np.arange(5), curve[:5], 1)[0])))
            yield pd.DataFrame(out, columns=["id", "le"])

    return series.select("id", "xs").mapInPandas(run, "id bigint, le double")
