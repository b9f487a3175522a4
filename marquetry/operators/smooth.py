"""Smoothed curves over a numeric axis."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.plans.quantiles import exact_quantiles
from marquetry.plans.skew import scalar_row


def piecewise_grid(segments: Sequence[tuple[float, float, int]]) -> list[float]:
    """Evenly spaced points per (from, to, points) segment; only the last one includes its end."""
    out: list[float] = []
    for i, (lo, hi, n) in enumerate(segments):
        out += np.linspace(lo, hi, n, endpoint=i == len(segments) - 1).tolist()
    return out


def price_grid(lo: float, hi: float, breaks: tuple[float, float] = (5.0, 25.0), points: int = 30) -> list[float]:
    return piecewise_grid([(lo, breaks[0], points), (breaks[0], breaks[1], points), (breaks[1], hi, points)])


def step_edges(segments: Sequence[tuple[float, float, float]]) -> list[float]:
    """Edges of piecewise-constant bin widths, (from, to, width) per segment, without repeats."""
    edges: set[float] = set()
    for lo, hi, width in segments:
        edges.update(round(lo + i * width, 9) for i in range(int(round((hi - lo) / width)) + 1))
    return sorted(edges)


# -- Savitzky-Golay -----------------------------------------------------------------


def savgol_weights(bins: int, window: int, order: int) -> list[tuple[int, int, float]]:
    """(target, source, weight) for every bin; the ends use the polynomial of the outermost window."""
    if window > bins:
        window = bins if bins % 2 else bins - 1
    if window <= order:
        raise ValueError("the window must be longer than the polynomial order")
    half = window // 2
    fit = np.linalg.pinv(np.vander(np.arange(window) - half, order + 1, increasing=True))
    out = []
    for target in range(bins):
        start = min(max(target - half, 0), bins - window)
        offset = target - start - half
        weights = np.array([float(offset) ** k for k in range(order + 1)]) @ fit
        out += [(target, start + i, float(w)) for i, w in enumerate(weights)]
    return out


def savgol(df: DataFrame, pos: str, values: Sequence[str], bins: int, window: int = 13, order: int = 2) -> DataFrame:
    """Smooth columns of a binned series (``pos`` = 0..bins-1), negatives clipped to 0.

    The weights are a table of ``bins * window`` numbers known beforehand, so they are broadcast.
    """
    table = df.sparkSession.createDataFrame(savgol_weights(bins, window, order), "target int, source int, w double")
    joined = df.join(F.broadcast(table), F.col(pos) == F.col("source"))
    sums = [F.greatest(F.sum(F.col("w") * F.col(v)), F.lit(0.0)).alias(v) for v in values]
    return joined.groupBy(F.col("target").alias(pos)).agg(*sums)


def compare_distributions(
    df: DataFrame, col: str, predicate: Column, width: float = 0.5, top: float = 80.0, window: int = 13, order: int = 2
) -> DataFrame:
    """Smoothed histogram of a subset and of everything, the latter rescaled to the subset's mass.

    Bins of equal width, the last one open-ended; values below 0 fall out.
    """
    bins = int(round(top / width))
    index = F.least(F.floor(F.col(col) / width), F.lit(bins - 1)).cast("int")
    rows = df.where(F.col(col) >= 0)
    counted = rows.groupBy(index.alias("bin")).agg(
        F.count_if(predicate).cast("double").alias("subset"), F.count(F.lit(1)).cast("double").alias("overall")
    )
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    full = frame.join(F.broadcast(counted), "bin", "left").fillna(0.0)
    smooth = savgol(full, "bin", ["subset", "overall"], bins, window, order)
    # a whole-frame window over `bins` rows
    everything = Window.partitionBy()
    scaled = F.try_divide(F.col("overall"), F.sum("overall").over(everything)) * F.sum("subset").over(everything)
    return smooth.select("bin", ((F.col("bin") + 0.5) * width).alias("center"), "subset", scaled.alias("overall"))


# -- kernel density -----------------------------------------------------------------


def kde(df: DataFrame, col: str, points: int, scale_bins: int | None = None) -> DataFrame:
    """Gaussian density (Scott bandwidth) at evenly spaced points over the observed range.

    Every grid point is one sum of the same aggregate, combined map-side, so no rows are paired with the grid and
    only one row per task is shuffled. ``scale_bins`` scales to the counts of a histogram with that many bins.
    Fewer than two rows or no variance give no rows.
    """
    rows = df.select(F.col(col).cast("double").alias("x")).where("x is not null")
    s = scalar_row(rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_samp("x").alias("sd")))
    valued = rows.withColumn("s", s)
    bandwidth = F.col("s.sd") * F.pow(F.col("s.n").cast("double"), -0.2)
    step = (F.col("s.hi") - F.col("s.lo")) / F.lit(points - 1)

    def kernel(i: int) -> Column:
        z = (F.col("s.lo") + step * i - F.col("x")) / bandwidth
        return F.coalesce(F.sum(F.exp(z * z * -0.5)), F.lit(0.0)).alias(f"k{i}")

    usable = valued.where((F.col("s.n") >= 2) & (F.col("s.sd") > 0))
    sums = usable.agg(*[kernel(i) for i in range(points)]).select(F.array(*[f"k{i}" for i in range(points)]).alias("k"))
    out = sums.select(F.posexplode("k").alias("i", "k")).withColumn("s", s).where((F.col("s.n") >= 2) & (F.col("s.sd") > 0))
    density = F.col("k") / (F.col("s.n") * bandwidth * F.lit(float(np.sqrt(2 * np.pi))))
    if scale_bins:
        density = density * F.col("s.n") * (F.col("s.hi") - F.col("s.lo")) / F.lit(scale_bins)
    return out.select((F.col("s.lo") + step * F.col("i")).alias("x"), density.alias("density"))


# -- sliding windows ----------------------------------------------------------------


def _windows(x: Column, centers: Sequence[float], half_widths: Sequence[float]) -> Column:
    """The windows that cover ``x``, from a grid carried in the plan."""
    grid = F.array(*[F.struct(F.lit(float(c)).alias("center"), F.lit(float(w)).alias("half")) for c, w in zip(centers, half_widths)])
    return F.filter(grid, lambda g: (x >= g["center"] - g["half"]) & (x <= g["center"] + g["half"]))


def triangular_mean(df: DataFrame, val: str, x: str, centers: Sequence[float], half_widths: Sequence[float]) -> DataFrame:
    """Mean around each centre, weights falling linearly to 0 at the window's edge; null without weight.

    The axis is cut at all centres and window edges. Rows are reduced to sums per piece in one map-side aggregate; the weight is
    linear within a piece, so each window's mean follows from the sums of its pieces. No row is copied into windows.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(val).cast("double").alias("v")).dropna()
    pairs = list(zip(map(float, centers), map(float, half_widths)))
    edges = sorted({e for c, h in pairs for e in (c - h, c, c + h)})
    if len(edges) < 2:
        edges = [*edges, float("inf")]
    cut = Bucketizer(splits=[float("-inf"), *edges, *([float("inf")] if edges[-1] != float("inf") else [])], inputCol="x", outputCol="piece")
    sums = cut.transform(rows).groupBy("piece").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("v").alias("sv"), F.sum(F.col("x") * F.col("v")).alias("sxv")
    )
    at = F.col("piece").cast("int")  # piece i lies between edges i - 1 and i
    marks = F.array(*[F.lit(e) for e in edges])
    placed = sums.where((at > 0) & (at < len(edges))).select(
        "n", "sx", "sv", "sxv", F.get(marks, at - 1).alias("lo"), F.get(marks, at).alias("hi")
    )
    grid = F.array(*[F.struct(F.lit(c).alias("center"), F.lit(h).alias("half")) for c, h in pairs])
    inside = F.filter(grid, lambda g: (F.col("lo") >= g["center"] - g["half"]) & (F.col("hi") <= g["center"] + g["half"]))
    hits = placed.select("*", F.explode(inside).alias("g"))  # pieces times windows, whatever the number of rows
    slope = F.when(F.col("lo") >= F.col("g.center"), -1.0).otherwise(1.0) / F.col("g.half")
    weigh = lambda one, with_x: F.sum(F.col(one) - slope * F.col("g.center") * F.col(one) + slope * F.col(with_x))
    totals = hits.groupBy(F.col("g.center").alias("center")).agg(weigh("sv", "sxv").alias("top"), weigh("n", "sx").alias("weight"))
    weight = F.when(F.abs("weight") > 1e-12, F.col("weight"))
    return totals.select("center", F.try_divide(F.col("top"), weight).alias("mean"))


def sliding_curve(
    df: DataFrame,
    val: str,
    x: str,
    grid: Sequence[float],
    half_width: Callable[[float], float] = lambda p: 0.7 + 0.15 * p,
    p: float = 5.0,
) -> DataFrame:
    """Triangular mean along a grid with a band as wide as +- ``p`` percentiles around the median."""
    halves = [half_width(g) for g in grid]
    means = triangular_mean(df, val, x, grid, halves)
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(val).cast("double").alias("v")).dropna()
    covered = rows.select("v", F.explode(_windows(F.col("x"), grid, halves)).alias("g")).select("v", F.col("g.center").alias("center"))
    probs = {"q_low": 0.5 - p / 100, "median": 0.5, "q_high": 0.5 + p / 100}
    bands = exact_quantiles(covered, "v", probs, ["center"], max_groups=len(grid))
    # one row per grid point on both sides
    return means.join(F.broadcast(bands), "center").select(
        "center", "mean",
        (F.col("mean") - (F.col("median") - F.col("q_low"))).alias("lower"),
        (F.col("mean") + (F.col("q_high") - F.col("median"))).alias("upper"),
    )
