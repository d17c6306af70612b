"""Smoothing of many short curves at once: splines with a chosen stiffness, and robust local lines.

Spark gathers each key's curve as an array; a task then works on all curves of a batch together, in numpy arrays of
curves and positions. A curve has a bounded number of points, such as the cycles of a unit or the samples of a cycle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stiffnesses that are tried, in cubes of a curve's mean distance of points.
TRIED = 10.0 ** np.linspace(-4, 6, 21)
#: Numbers in an array of curves, stiffnesses and positions.
AT_ONCE = 1 << 21


def curves(df: DataFrame, x: str, ys: list[str], keys: list[str]) -> DataFrame:
    """keys and ``curve``: the points of each key with all values, by rising x; points of one x are averaged. A key without any has an empty one."""
    ok = F.col(x).isNotNull()
    for y in ys:
        ok = ok & F.col(y).isNotNull()
    merged = df.groupBy(*keys, F.when(ok, F.col(x)).cast("double").alias("__x")).agg(*(F.avg(F.when(ok, F.col(y)).cast("double")).alias(f"__y{i}") for i, y in enumerate(ys)))
    point = F.when(F.col("__x").isNotNull(), F.struct("__x", *(f"__y{i}" for i in range(len(ys)))))
    return merged.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("curve"))


def map_curves(df: DataFrame, x: str, ys: list[str], keys: list[str], made: str, run: Callable[[list[np.ndarray], list[np.ndarray]], list[tuple]]) -> DataFrame:
    """A row for each point that ``run`` gives for a curve: it gets all x and all values (curves of points by ys) of a batch and returns columns for each curve."""
    found = curves(df, x, ys, keys)
    schema = T.StructType([*found.select(*keys).schema.fields, *T._parse_datatype_string(made).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            flat = [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()]
            xs = [flat[0][a:z] for a, z in zip(ends, ends[1:])]
            values = [np.column_stack([c[a:z] for c in flat[1:]]) for a, z in zip(ends, ends[1:])]
            done = run(xs, values)
            rows = np.repeat(np.arange(len(done)), [len(d[0]) for d in done])
            columns = [np.concatenate(c) for c in zip(*done)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(rows)) for k in range(len(keys))), *(pa.array(c, batch_type) for c, batch_type in zip(columns, types))], names=schema.names)

    types = [{"int": pa.int32(), "double": pa.float64()}[f.dataType.simpleString()] for f in schema.fields[len(keys) :]]
    return found.select(*keys, "curve").mapInArrow(work, schema)


def _padded(rows: list[np.ndarray], size: int, fill: float = 0.0) -> np.ndarray:
    out = np.full((len(rows), size), fill)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _bands(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distances, and the bands of the two matrices of a natural spline: R (curvature) and E = Q'Q (second differences)."""
    h = np.diff(x)
    r = 1 / h
    middle = -(r[:-1] + r[1:])
    return h, r, middle, (h[:-1] + h[1:]) / 3, h[1:-1] / 6, r[:-1] ** 2 + middle**2 + r[1:] ** 2, middle[:-1] * r[1:-1] + r[1:-1] * middle[1:], r[1:-2] * r[2:-1]


def _solve(main: np.ndarray, one: np.ndarray, two: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Solve symmetric systems of five diagonals, all in one pass over the positions; also the inverses' main, next and second next diagonal.

    Arrays have positions last; ``right`` may have an axis more, before the positions, for several right sides.
    """
    n = main.shape[-1]
    zero = np.zeros(main.shape[:-1])
    d, a, b = (np.zeros((n + 2, *main.shape[:-1])) for _ in range(3))
    z = np.zeros((n + 2, *right.shape[:-1]))
    wide = (lambda v: v[..., None]) if right.ndim > main.ndim else (lambda v: v)
    for i in range(n):  # places n and n + 1 stay zero and serve as places before the first
        d[i] = main[..., i] - a[i - 1] ** 2 * d[i - 1] - b[i - 2] ** 2 * d[i - 2]
        a[i] = (one[..., i] - b[i - 1] * a[i - 1] * d[i - 1]) / d[i] if i < n - 1 else zero
        b[i] = two[..., i] / d[i] if i < n - 2 else zero
        z[i] = right[..., i] - wide(a[i - 1]) * z[i - 1] - wide(b[i - 2]) * z[i - 2]
    u = np.zeros_like(z)
    s0, s1, s2 = (np.zeros_like(d) for _ in range(3))
    for i in range(n - 1, -1, -1):
        u[i] = z[i] / wide(d[i]) - wide(a[i]) * u[i + 1] - wide(b[i]) * u[i + 2]
        s1[i] = -a[i] * s0[i + 1] - b[i] * s1[i + 1]
        s2[i] = -a[i] * s1[i + 1] - b[i] * s0[i + 2]
        s0[i] = 1 / d[i] - a[i] * s1[i] - b[i] * s2[i]
    back = lambda v: np.moveaxis(v[:n], 0, -1)
    return back(u), back(s0), back(s1), back(s2)


def fit_splines(xs: list[np.ndarray], ys: list[np.ndarray], stiffness: float | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Levels and second derivatives at the points of natural cubic smoothing splines, and the stiffness of each curve and value.

    A spline minimises the squared distance from the points plus the stiffness times the integral of the squared second
    derivative. Without a given stiffness the one of TRIED is taken that has the least generalised cross-validation, n RSS / tr(I - A)^2,
    whose trace comes from the inverse's diagonals. ``xs`` have three points at least, ``ys`` are points by values.
    """
    n = np.array([len(x) for x in xs])
    size = int(n.max())
    parts = [_bands(x) for x in xs]
    r0, r1, e0, e1, e2 = (_padded([p[k] for p in parts], size - 2) for k in (3, 4, 5, 6, 7))
    tried = np.full((len(xs), 1), stiffness) if stiffness is not None else np.array([(x[-1] - x[0]) / (len(x) - 1) for x in xs])[:, None] ** 3 * TRIED
    outside = np.arange(size - 2) >= (n - 2)[:, None]
    w = tried[:, :, None]
    main = np.where(outside[:, None, :], 1.0, r0[:, None, :] + w * e0[:, None, :])
    bend = np.stack([_padded([np.diff(np.diff(y[:, v]) * p[1]) for y, p in zip(ys, parts)], size - 2) for v in range(ys[0].shape[1])], axis=1)
    right = np.broadcast_to(bend[:, None], (len(xs), tried.shape[1], *bend.shape[1:]))
    u, s0, s1, s2 = _solve(main, r1[:, None, :] + w * e1[:, None, :], w * e2[:, None, :], right)
    trace = tried * ((s0 * e0[:, None, :]).sum(-1) + 2 * (s1 * e1[:, None, :]).sum(-1) + 2 * (s2 * e2[:, None, :]).sum(-1))
    # |Q u|^2 is u'E u
    square = (u**2 * e0[:, None, None, :]).sum(-1) + 2 * (u[..., :-1] * u[..., 1:] * e1[:, None, None, : size - 3]).sum(-1) + 2 * (u[..., :-2] * u[..., 2:] * e2[:, None, None, : max(0, size - 4)]).sum(-1)
    score = n[:, None, None] * tried[:, :, None] ** 2 * square / trace[:, :, None] ** 2
    best = np.argmin(score, axis=1)
    levels, bends = [], []
    for k, (x, y, (h, r, middle, *_)) in enumerate(zip(xs, ys, parts)):
        inner = np.stack([u[k, best[k, v], v, : len(x) - 2] for v in range(y.shape[1])], axis=1)
        pull = np.zeros_like(y)
        pull[:-2] += r[:-1, None] * inner
        pull[1:-1] += middle[:, None] * inner
        pull[2:] += r[1:, None] * inner
        levels.append(y - tried[k, best[k]] * pull)
        bends.append(np.pad(inner, ((1, 1), (0, 0))))
    return levels, bends, np.take_along_axis(tried, best, axis=1)


def _at(x: np.ndarray, level: np.ndarray, bend: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Values of a spline at the places ``at``; 0 outside its points."""
    h = np.diff(x)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    a, b = ((x[k + 1] - at) / h[k])[:, None], ((at - x[k]) / h[k])[:, None]
    value = a * level[k] + b * level[k + 1] + ((a**3 - a) * bend[k] + (b**3 - b) * bend[k + 1]) * (h[k] ** 2)[:, None] / 6
    return np.where(((at < x[0]) | (at > x[-1]))[:, None], 0.0, value)


def _lots(xs: list[np.ndarray], each: int) -> Iterator[list[int]]:
    """Curves of like length, so many that their arrays have AT_ONCE numbers or about as many."""
    lot: list[int] = []
    for k in sorted((k for k, x in enumerate(xs) if len(x) > 2), key=lambda k: len(xs[k])):
        if lot and (len(lot) + 1) * len(xs[k]) * each > AT_ONCE:
            yield lot
            lot = []
        lot.append(k)
    if lot:
        yield lot


def spline_resample(df: DataFrame, x: str, ys: list[str], keys: list[str], points: int, first: float, last: float, stiffness: float | None = None) -> DataFrame:
    """Each ``y`` of every key as a smoothing spline on an even grid: keys, grid_idx, v and the ys; zeros outside the points and for keys of fewer than three.

    Without a ``stiffness`` each curve's own is chosen by generalised cross-validation.
    """
    at = np.linspace(first, last, points)

    def run(xs: list[np.ndarray], values: list[np.ndarray]) -> list[tuple]:
        out = [np.zeros((points, len(ys)))] * len(xs)
        for lot in _lots(xs, (1 if stiffness is not None else len(TRIED)) * (len(ys) + 6)):
            levels, bends, _ = fit_splines([xs[k] for k in lot], [values[k] for k in lot], stiffness)
            for k, level, bend in zip(lot, levels, bends):
                out[k] = _at(xs[k], level, bend, at)
        return [(np.arange(points), at, *y.T) for y in out]

    return map_curves(df, x, ys, keys, ", ".join(["grid_idx int", "v double", *(f"`{y}` double" for y in ys)]), run)


def local_lines(x: np.ndarray, y: np.ndarray, nearest: int, passes: int = 5) -> np.ndarray:
    """Robust local regression: at each point the line through its nearest points, by tricube weights of distance and bisquare weights of the last residuals.

    The window is the ``nearest`` points in order of x around a point, the left one of equally near ends. Distances are measured in the farthest of them. Weights of residuals
    reach to six median residuals. Where a line has no spread to stand on, the weighted mean stands in its place.
    """
    n, size = len(x), min(nearest, len(x))
    if not n:
        return y
    # the window of a point moves on while its next point is nearer than its first
    start = np.zeros(n, dtype=int)
    for _ in range(n):
        ahead = np.minimum(start + size, n - 1)
        move = (start + size < n) & (x[ahead] - x < x - x[start])
        if not move.any():
            break
        start += move
    at = start[:, None] + np.arange(size)
    apart = np.abs(x[at] - x[:, None])
    reach = apart.max(axis=1, keepdims=True)
    near = np.where(reach > 0, (1 - np.divide(apart, reach, out=np.zeros_like(apart), where=reach > 0) ** 3) ** 3, 1.0)
    trust, out = np.ones(n), y
    for turn in range(passes + 1):
        w = near * trust[at]
        w = np.where(w.sum(axis=1, keepdims=True) > 0, w, near)
        total = w.sum(axis=1)
        mx, my = (w * x[at]).sum(axis=1) / total, (w * y[at]).sum(axis=1) / total
        dx = x[at] - mx[:, None]
        spread = (w * dx**2).sum(axis=1)
        slope = np.divide((w * dx * (y[at] - my[:, None])).sum(axis=1), spread, out=np.zeros(n), where=spread > 1e-12 * total * np.maximum(reach[:, 0], 1e-300) ** 2)
        out = my + slope * (x - mx)
        size_of = np.median(np.abs(y - out))
        if turn == passes or size_of <= 1e-12 * max(1.0, float(np.abs(y).max())):
            break
        trust = np.clip(1 - ((y - out) / (6 * size_of)) ** 2, 0, None) ** 2
    return out


def robust_smooth(df: DataFrame, x: str, y: str, keys: list[str], nearest: int = 9, passes: int = 5) -> DataFrame:
    """keys, ``x`` and ``y`` smoothed by local_lines() along every key; rows without a value are left out and those of one x averaged."""
    return map_curves(df, x, [y], keys, f"`{x}` double, `{y}` double", lambda xs, values: [(a, local_lines(a, v[:, 0], nearest, passes)) for a, v in zip(xs, values)])
