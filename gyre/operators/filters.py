"""Kernels, convolution that knows missing values, erosion of masks, tidal filters, thinning of points."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyre.errors import TimeStepError
from gyre.operators.distance import radius_average
from gyre.operators.thinning import thinned
from gyre.scratch import written

# The first half and the centre of the Demerliac filter; the other half mirrors the first.
_DEMERLIAC = [
    1, 3, 8, 15, 21, 32, 45, 55, 72, 91, 105, 128, 153, 171, 200, 231, 253, 288, 325, 351, 392, 435, 465, 512, 558, 586, 624,
    658, 678, 704, 726, 738, 752, 762, 766, 768,
]


def tidal_weights(name: str) -> list[float]:
    """Hourly weights of ``demerliac``, ``godin`` (running means over 24, 24 and 25 hours) or ``mean`` (25 hours)."""
    if name == "demerliac":
        return [float(x) for x in _DEMERLIAC + _DEMERLIAC[-2::-1]]
    if name == "godin":
        return [float(x) for x in np.convolve(np.convolve(np.ones(24), np.ones(24)), np.ones(25))]
    if name == "mean":
        return [1.0] * 25
    raise ValueError(name)


def window_values(window: str | list | Callable, size: int, **kw) -> np.ndarray:
    """Values of a window of ``size`` points: ones, triangle, hann, hamming, blackman, bartlett, gaussian (std, size / 6 by default), a list stretched to the size, or a function of it."""
    if callable(window):
        return np.asarray(window(size, **kw), float)
    if not isinstance(window, str):
        return np.interp(np.linspace(0, 1, size), np.linspace(0, 1, len(window)), np.asarray(window, float))
    x = np.arange(size) - (size - 1) / 2
    makers = {
        "ones": lambda: np.ones(size),
        "boxcar": lambda: np.ones(size),
        "triang": lambda: 1 - np.abs(x) / ((size + size % 2) / 2 if size % 2 == 0 else (size + 1) / 2),
        "hann": lambda: np.hanning(size),
        "hamming": lambda: np.hamming(size),
        "blackman": lambda: np.blackman(size),
        "bartlett": lambda: np.bartlett(size),
        "gaussian": lambda: np.exp(-0.5 * (x / kw.get("std", size / 6)) ** 2),
    }
    return makers[window]()


def orthogonal_kernel(sizes: list, window: str | list | Callable = "ones", fill: float = 0.0) -> np.ndarray:
    """The outer product of one window a dimension; a size that is no odd whole number is padded with ``fill`` at both ends."""
    axes = []
    for s in sizes:
        if np.ndim(s):
            axes.append(np.asarray(s, float))
            continue
        inner = int(s)
        values = window_values(window, inner)
        axes.append(np.concatenate([[fill], values, [fill]]) if s != inner else values)
    out = axes[0]
    for a in axes[1:]:
        out = np.multiply.outer(out, a)
    return out


def isotropic_kernel(shape: tuple[int, ...], window: str | list | Callable = "gaussian", fill: float = 0.0) -> np.ndarray:
    """A kernel that depends on the distance from its centre only: the window from its middle outwards."""
    n = 2 * max(shape)
    values, places = window_values(window, n), np.linspace(0, 1, n)
    axes = [(np.arange(s) - (s - 1) / 2) / max(s, 1) for s in shape]
    r = np.sqrt(sum(g**2 for g in np.meshgrid(*axes, indexing="ij")))
    return np.where(r <= 0.5, np.interp(0.5 - r, places, values), fill)


def shapiro_kernel(n_dims: int) -> np.ndarray:
    """One dimension: the identity; two: a cross of ones with 2 at its centre."""
    if n_dims == 1:
        return np.array([0.0, 1.0, 0.0])
    out = np.zeros((3,) * n_dims)
    for i in range(n_dims):
        for k in (0, 2):
            at = [1] * n_dims
            at[i] = k
            out[tuple(at)] = 1
    out[(1,) * n_dims] = 2
    return out


def make_kernel(kernel, n_dims: int, window="ones", isotropic: bool = False) -> np.ndarray:
    """A kernel from a size, a size for each dimension, lists of weights, or an array."""
    if isinstance(kernel, np.ndarray):
        return kernel.astype(float)
    sizes = list(kernel) if isinstance(kernel, (list, tuple)) else [kernel] * n_dims
    return isotropic_kernel(tuple(sizes), window) if isotropic else orthogonal_kernel(sizes, window)


def least_weight(kernel: np.ndarray, na_thres: float) -> float:
    """The weight of valid values up to which a result is missing."""
    return float(kernel.sum() * min(max(1e-6, 1 - na_thres), 1 - 1e-6))


def _result(sum_col: Column, weight: Column, kernel: np.ndarray, normalize: bool, na_thres: float) -> Column:
    return F.when(weight > least_weight(kernel, na_thres), sum_col / weight if normalize else sum_col)


def axis_kernels(kernel, dims: list[str], window="ones") -> list[np.ndarray] | None:
    """One kernel a dimension where a kernel is their outer product by its form: a dict by dimension, or sizes; else None.

    In a dict a dimension has a size or a list of weights; dimensions that are left out are not convolved over.
    """
    if isinstance(kernel, dict):
        if unknown := [d for d in kernel if d not in dims]:
            raise ValueError(f"no such dimensions: {unknown}")
        return [orthogonal_kernel([kernel.get(d, 1)], window) for d in dims]
    if isinstance(kernel, np.ndarray):
        return None
    return [orthogonal_kernel([s], window) for s in (kernel if isinstance(kernel, (list, tuple)) else [kernel] * len(dims))]


def convolve(
    df: DataFrame, keys: list[str], dims: list[str], v: str, kernel, normalize: bool = False, na_thres: float = 0.0, out: str | None = None, window="ones",
) -> DataFrame:
    """Convolution over the dimensions, zeros outside: missing values have no weight, and too little weight gives a missing result.

    Dimensions are whole-number indices, and neighbours are those whose index says so; cells need not be there.
    Each cell sends its products to the cells around it, summed before the shuffle; a kernel that is an outer product
    (``axis_kernels``) goes one dimension after the other where that takes fewer products. Over one dimension a window over
    a range of the index gives the neighbours.
    """
    separate = axis_kernels(kernel, dims, window)
    kernel = make_kernel(kernel, len(dims), window) if separate is None else reduce(np.multiply.outer, separate)
    out = out or v
    if len(dims) == 1:
        return _convolve1d(df, keys, dims[0], v, kernel, normalize, na_thres, out)
    rows = df.select(*keys, *dims, F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias("_s"), F.col(v).isNotNull().cast("double").alias("_q"), F.lit(True).alias("_cell"))
    if separate and kernel.size > 2 * sum(len(k) for k in separate):
        for i, one in enumerate(separate):
            if one.size > 1 or one[0] != 1:
                rows = _sent(rows, keys, dims, one.reshape([-1 if j == i else 1 for j in range(len(dims))]))
    else:
        rows = _sent(rows, keys, dims, kernel)
    return rows.where("_cell").select(*keys, *dims, _result(F.col("_s"), F.col("_q"), kernel, normalize, na_thres).alias(out))


def _sent(rows: DataFrame, keys: list[str], dims: list[str], kernel: np.ndarray) -> DataFrame:
    """Sums of what the cells around each place send to it; _cell is whether one stands there itself, and _own its own value if asked for."""
    centre = [n // 2 for n in kernel.shape]
    here = lambda at: all(i == c for i, c in zip(at, centre))
    items = [(*[i - c for i, c in zip(at, centre)], float(kernel[at]), here(at)) for at in np.ndindex(*kernel.shape) if kernel[at] or here(at)]
    names = [*[f"o{j}" for j in range(len(dims))], "w", "here"]
    offsets = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, item)]) for item in items])
    sent = rows.select("*", F.explode(offsets).alias("_o"))
    target = [(F.col(d) + F.col(f"_o.o{j}")).alias(d) for j, d in enumerate(dims)]
    own = [F.when(F.col("_o.here"), F.col("_own")).alias("_own")] if "_own" in rows.columns else []
    sums = sent.select(*keys, *target, (F.col("_s") * F.col("_o.w")).alias("_s"), (F.col("_q") * F.col("_o.w")).alias("_q"), (F.col("_cell") & F.col("_o.here")).alias("_cell"), *own)
    found = [F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.max("_cell").alias("_cell"), *([F.max("_own").alias("_own")] if own else [])]
    return sums.groupBy(*keys, *dims).agg(*found)


def _convolve1d(df: DataFrame, keys: list[str], dim: str, v: str, kernel: np.ndarray, normalize: bool, na_thres: float, out: str) -> DataFrame:
    weights = F.array(*[F.lit(float(x)) for x in kernel])
    rows = _ranged(df.select(*keys, dim, F.col(v).cast("double").alias("_v"), F.col(dim).cast("long").alias("_i")), keys, weights, len(kernel))
    return rows.select(*keys, dim, _result(F.col("_s"), F.col("_q"), kernel, normalize, na_thres).alias(out))


def _ranged(rows: DataFrame, keys: list[str], weights: Column, most: int) -> DataFrame:
    """Add _s and _q, the weighted sum of the values _v around each row by the index _i, and the weight of those that are there.

    ``weights`` is an array of up to ``most`` weights, of the row's own.
    """
    w = Window.partitionBy(*keys).orderBy("_i").rangeBetween(-(most - 1 - most // 2), most // 2)
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col("_v").alias("v"))).over(w)
    rows = rows.withColumn("_w", weights).withColumn("_near", near)
    place = lambda x: (F.col("_i") - x["i"] + F.floor(F.size("_w") / 2)).cast("int")
    weight = lambda x: F.when(place(x) >= 0, F.coalesce(F.get(F.col("_w"), place(x)), F.lit(0.0))).otherwise(F.lit(0.0))
    met = F.transform(F.filter("_near", lambda x: x["v"].isNotNull()), lambda x: F.struct(weight(x).alias("w"), x["v"].alias("v")))
    rows = rows.withColumn("_met", met)
    total = F.aggregate("_met", F.lit(0.0), lambda s, x: s + x["w"] * x["v"])
    return rows.withColumn("_s", total).withColumn("_q", F.aggregate("_met", F.lit(0.0), lambda s, x: s + x["w"])).drop("_near", "_met")


def smooth(df: DataFrame, keys: list[str], dims: list[str], v: str, kernel=None, na_thres: float = 0.0) -> DataFrame:
    """Normalised convolution, by default with the Shapiro kernel."""
    return convolve(df, keys, dims, v, shapiro_kernel(len(dims)) if kernel is None else kernel, True, na_thres)


def erode(df: DataFrame, keys: list[str], dims: list[str], v: str, until: int | None = 1, kernel=None, mask: str | None = None, most: int = 1000) -> DataFrame:
    """Fill missing values next to valid ones with the mean of their neighbours, ``until`` times over.

    With ``mask`` (a boolean column, true where values may stay missing) until no other value is missing, at
    most ``most`` times; every 8 passes are written to the shared folder.
    """
    weights = shapiro_kernel(len(dims)) if kernel is None else make_kernel(kernel, len(dims))
    rest = [c for c in df.columns if c not in (*keys, *dims, v)]
    cells, out = df.select(*keys, *dims, *rest), df.select(*keys, *dims, v)
    for i in range(until if mask is None else most):
        if mask is not None:
            left = out.where(F.col(v).isNull()).join(cells.where(~F.col(mask)), [*keys, *dims], "left_semi")
            if left.isEmpty():
                break
        # A cell's own value comes along with what it is sent, so that a pass is one shuffle.
        value = F.col(v).cast("double")
        rows = out.select(*keys, *dims, F.coalesce(value, F.lit(0.0)).alias("_s"), value.isNotNull().cast("double").alias("_q"), F.lit(True).alias("_cell"), value.alias("_own"))
        near = _sent(rows, keys, dims, weights).where("_cell")
        out = near.select(*keys, *dims, F.coalesce("_own", _result(F.col("_s"), F.col("_q"), weights, True, 1.0)).alias(v))
        if i % 8 == 7:
            out = written(out, "erode")
    return out.join(cells, [*keys, *dims]) if rest else out


def regular_hours(df: DataFrame, keys: list[str], time: str, v: str) -> DataFrame:
    """Hourly means with every hour from the first to the last of a key, missing where there is none: keys, hour, v."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", time).alias("hour")).agg(F.avg(v).alias(v))
    span = hourly.groupBy(*keys).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    hours = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("hour"))
    return hours.join(hourly, [*keys, "hour"], "left")


def tidal_filter(df: DataFrame, keys: list[str], time: str, v: str, name: str = "demerliac", na_thres: float = 0.0, dt_tol: float = 0.01) -> DataFrame:
    """A tidal filter over rows an hour apart at most; each key has a time step of its own, to which the weights are fitted.

    Rows of a key that are not equally far apart, or more than an hour, are an error.
    """
    of_key = Window.partitionBy(*keys)
    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    rows = df.select(*keys, time, F.col(v).cast("double").alias("_v"), seconds.alias("_t"))
    rows = rows.withColumn("_dt", F.col("_t") - F.lag("_t").over(of_key.orderBy("_t")))
    rows = rows.withColumn("_step", F.avg("_dt").over(of_key)).withColumn("_first", F.min("_t").over(of_key))
    steps = rows.groupBy(*keys).agg(F.min("_dt").alias("lo"), F.max("_dt").alias("hi"), F.first("_step").alias("mean"))
    odd, slow, finest = steps.agg(F.max(F.col("hi") - F.col("lo") > dt_tol * F.col("mean")), F.max("mean"), F.min("mean")).first()
    if odd:
        raise TimeStepError("the time steps are not regular")
    if slow is not None and slow > 3600 * (1 + dt_tol):
        raise TimeStepError(f"the rows are {slow} s apart; an hour at most is needed")
    hourly = tidal_weights(name)
    last = len(hourly) - 1
    given = F.array(*map(F.lit, hourly))
    rate = F.when(F.col("_step") < 3600 * (1 - dt_tol), 3600 / F.col("_step")).otherwise(F.lit(1.0))
    n = F.round(last * F.coalesce(rate, F.lit(1.0))).cast("int")

    def between(k: Column) -> Column:
        at = k * last / n
        low = F.floor(at).cast("int")
        return F.get(given, low) + (at - low) * (F.coalesce(F.get(given, low + 1), F.lit(0.0)) - F.get(given, low))

    weights = F.when(n == last, given).otherwise(F.transform(F.sequence(F.lit(0), n), between))
    finest = finest if finest is not None and finest < 3600 * (1 - dt_tol) else 3600.0
    index = F.coalesce(F.round((F.col("_t") - F.col("_first")) / F.col("_step")), F.lit(0)).cast("long")
    rows = _ranged(rows.withColumn("_i", index), keys, weights, int(round(last * 3600 / finest)) + 2)
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    value = F.when(F.col("_q") > total * min(max(1e-6, 1 - na_thres), 1 - 1e-6), F.col("_s") / F.col("_q"))
    return rows.select(*keys, time, value.alias(v))


def decimate(points: DataFrame, radius: float, method: str = "pick", order: str = "id", value: str = "value", smooth_factor: float = 1.0) -> DataFrame:
    """Thin points (id, lon, lat, value): in order, keep a point unless a kept one is nearer than ``radius`` metres.

    ``average`` gives each kept point the mean of the points within ``radius * smooth_factor``.
    """
    kept = thinned(points, radius, order, value)
    if method == "pick":
        return kept
    means = radius_average(points, kept, radius * smooth_factor, value).withColumnRenamed("value", "_mean")
    return kept.join(means, "id").select("id", "lon", "lat", F.col("_mean").alias(value))
