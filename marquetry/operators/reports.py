"""Counts, shares, distributions and keyword effects over a catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions import metrics as M
from marquetry.functions import parsing as P
from marquetry.operators.filters import below_quantile, keep_top_n
from marquetry.plans.quantiles import exact_quantiles, melt
from marquetry.plans.skew import attach_group_stats, null_safe, with_scalars


def count_by(df: DataFrame, keys: Sequence[str], out: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def sum_by(df: DataFrame, keys: Sequence[str], col: str, out: str = "total") -> DataFrame:
    """Group sums; a group without values sums to 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(col), F.lit(0)).alias(out))


def stats_by(df: DataFrame, key: str, col: str, max_groups: int | None = None) -> DataFrame:
    """Exact median and mean per group; groups without values stay, with nulls."""
    means = df.groupBy(key).agg(F.avg(col).alias("mean"))
    medians = exact_quantiles(df, col, {"median": 0.5}, [key], max_groups)
    both = means.alias("l").join(medians.alias("r"), null_safe([key], "l", "r"), "left")
    return both.select(F.col(f"l.`{key}`").alias(key), "median", "mean")


def mean_ratio_by(df: DataFrame, key: str, num: str, den: Column, out: str = "mean_ratio") -> DataFrame:
    """Mean of per-row ratios; rows with a zero denominator do not count."""
    return df.groupBy(key).agg(F.avg(F.try_divide(F.col(num).cast("double"), den)).alias(out))


def category_share_long(df: DataFrame, row: str, list_col: str, n: int = 15) -> DataFrame:
    """Share of each top-``n`` keyword among the kept keywords of its row group."""
    exploded = df.select(row, F.explode(list_col).alias("item"))
    counts = count_by(exploded, [row, "item"])
    kept = keep_top_n_counts(counts, "item", "count", n)
    # one value per (row, item) with at most n items each: the window is tiny
    total = F.sum("count").over(Window.partitionBy(row))
    return kept.select(row, "item", "count", (F.col("count") / total).alias("share"))


def keep_top_n_counts(counts: DataFrame, col: str, weight: str, n: int) -> DataFrame:
    top = counts.groupBy(col).agg(F.sum(weight).alias("_w")).orderBy(F.desc("_w"), col).limit(n).select(col)
    return counts.join(F.broadcast(top), col, "left_semi")


def category_share(df: DataFrame, row: str, list_col: str, items: Sequence[str]) -> DataFrame:
    """Wide form for a given keyword list: missing keyword -> 0, rows sum to 1."""
    long = df.select(row, F.explode(list_col).alias("item")).where(F.col("item").isin(*items))
    return row_share(pivot_count(long, row, "item", items), items)


def bracket_share(
    df: DataFrame, row: str, price: str, brackets: Sequence = K.PRICE_BRACKETS
) -> DataFrame:
    """Share of each price bracket per row group; unknown prices are left out of the total."""
    labels = [b[0] for b in brackets]
    labelled = df.select(row, M.price_bracket(F.col(price), brackets).alias("bracket"))
    return row_share(pivot_count(labelled, row, "bracket", labels), labels)


def pivot_count(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).fillna(0)


def pivot_sum(df: DataFrame, row: str, col: str, value: str, values: Sequence[str], scale: float = 1.0) -> DataFrame:
    wide = df.groupBy(row).pivot(col, list(values)).agg(F.sum(value)).fillna(0)
    return wide.select(row, *[(F.col(f"`{v}`") / F.lit(scale)).alias(v) for v in values])


def row_share(pivot: DataFrame, cols: Sequence[str]) -> DataFrame:
    total = sum((F.col(f"`{c}`") for c in cols[1:]), F.col(f"`{cols[0]}`"))
    rest = [c for c in pivot.columns if c not in cols]
    return pivot.select(*rest, *[F.try_divide(F.col(f"`{c}`").cast("double"), total).alias(c) for c in cols])


def shrunk_effect(
    df: DataFrame, list_col: str, metric: str, partition: str | None = None, k: float = 10.0
) -> DataFrame:
    """Keyword mean blended with the global mean (weight ``k``) and its relative difference.

    With ``partition`` all groups (monetisation models) are handled in one pass; the global mean
    spans all of them.
    """
    keys = ([partition] if partition else []) + ["item"]
    lead = [partition] if partition else []
    overall = df.agg(F.avg(metric).alias("m")).select("m").scalar()
    stats = df.select(*lead, F.explode(list_col).alias("item"), metric).groupBy(*keys).agg(
        F.avg(metric).alias("mean_metric"), F.count("item").alias("count")
    )
    n = F.col("count")
    m = F.col("_overall")
    step = stats.withColumn("_overall", overall).withColumn("smoothed_mean", (n * F.col("mean_metric") + F.lit(k) * m) / (n + F.lit(k)))
    return step.withColumn("relative_diff", (F.col("smoothed_mean") - m) / m).drop("_overall")


def top_bottom(df: DataFrame, by: str, n: int, tie: str, partition: str | None = None) -> DataFrame:
    """The ``n`` best and ``n`` worst rows, labelled Top / Bottom, per partition or overall."""
    known = df.where(F.col(by).isNotNull())
    if partition is None:
        top = known.orderBy(F.desc(by), tie).limit(n).withColumn("category", F.lit("Top"))
        bottom = known.orderBy(F.asc(by), tie).limit(n).withColumn("category", F.lit("Bottom"))
        return top.unionByName(bottom)
    rank = F.row_number().over(Window.partitionBy(partition).orderBy(F.desc(by), tie))
    low = F.row_number().over(Window.partitionBy(partition).orderBy(F.asc(by), tie))
    top = known.withColumn("_r", rank).where(F.col("_r") <= n).withColumn("category", F.lit("Top"))
    bottom = known.withColumn("_r", low).where(F.col("_r") <= n).withColumn("category", F.lit("Bottom"))
    return top.unionByName(bottom).drop("_r")


def histogram(df: DataFrame, col: str, bins: int, weight: str | None = None) -> DataFrame:
    """Equal-width bins over the observed range, last bin closed, empty bins included.

    Rows without a weight are left out before the range is taken.
    """
    rows = df.where(F.col(col).isNotNull())
    if weight:
        rows = rows.where(F.col(weight).isNotNull())
    span = rows.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    rows = with_scalars(rows, span)
    # a constant column gets a unit range around it
    flat = F.col("_s.hi") == F.col("_s.lo")
    lo = F.when(flat, F.col("_s.lo") - 0.5).otherwise(F.col("_s.lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_s.hi") - F.col("_s.lo")) / F.lit(bins)
    index = F.least(F.floor((F.col(col) - lo) / width), F.lit(bins - 1)).cast("int")
    value = F.sum(weight) if weight else F.count(F.lit(1))
    counted = rows.groupBy(index.alias("bin")).agg(value.alias("value"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = with_scalars(frame.join(F.broadcast(counted), "bin", "left"), span)
    return filled.select(
        "bin", (lo + F.col("bin") * width).alias("left"), (lo + (F.col("bin") + 1) * width).alias("right"),
        F.coalesce("value", F.lit(0)).alias("value"),
    )


def common_values(
    df: DataFrame,
    col: str,
    score: str,
    owners: str,
    segments: Sequence[tuple[float, float, float]] = K.COMMON_PRICE_SEGMENTS,
    tail_width: float = 1.0,
    top_n: int = 25,
) -> DataFrame:
    """The most frequent narrow price bins with mode, median score, median owners and share.

    Left-closed bins; past the last segment they have ``tail_width`` and end at the last whole step
    not above max + 1, so negative prices fall out, as do values at or past the last edge.
    """
    start = segments[-1][1]
    scope = df.agg(F.max(col).cast("double").alias("hi"), F.count(F.lit(1)).alias("n"))
    x = F.col("_x")
    # the last edge is the last whole step below max + 1
    last_edge = F.lit(start) + (F.ceil((F.col("_s.hi") + 1 - start) / tail_width) - 1) * tail_width

    def segment(lo: float, width: float) -> Column:
        return F.struct(F.lit(float(lo)).alias("lo"), F.lit(float(width)).alias("width"))

    chosen = F.when((x >= start) & (x < last_edge), segment(start, tail_width))
    for lo, hi, width in segments:
        chosen = chosen.when((x >= lo) & (x < hi), segment(lo, width))
    rows = with_scalars(df.select(F.col(col).cast("double").alias("_x"), score, owners), scope)
    rows = rows.withColumn("_seg", chosen).where(F.col("_seg").isNotNull())
    # the epsilon puts 0.3 into [0.3, 0.4) although 0.3 / 0.1 < 3 in binary
    left = F.col("_seg.lo") + F.floor((x - F.col("_seg.lo")) / F.col("_seg.width") + F.lit(1e-9)) * F.col("_seg.width")
    binned = rows.withColumn("_left", left).select(
        F.round("_left", 6).alias("start"), F.round(F.col("_left") + F.col("_seg.width"), 6).alias("end"), x.alias("price"), score, owners
    )

    # one aggregate over (bin, price) gives the counts and the modes
    prices = binned.groupBy("start", "end", "price").agg(F.count(F.lit(1)).alias("_c"))
    most = F.min_by("price", F.struct(-F.col("_c"), F.col("price")))
    bins = prices.groupBy("start", "end").agg(F.sum("_c").alias("count"), most.alias("mode_price"))
    top = bins.orderBy(F.desc("count"), "start").limit(top_n)
    kept = binned.join(F.broadcast(top.select("start")), "start", "left_semi")
    # both medians in one pass; bins and columns are known to be few
    medians = exact_quantiles(melt(kept, [score, owners], ["start"]), "value", {"median": 0.5}, ["start", "column"], max_groups=2 * top_n)
    wide = medians.groupBy("start").agg(
        F.max(F.when(F.col("column") == score, F.col("median"))).alias("median_score"),
        F.max(F.when(F.col("column") == owners, F.col("median"))).alias("median_owners"),
    )
    # both sides have at most top_n rows
    out = top.join(F.broadcast(wide), "start", "left")
    share = F.col("count") / F.col("_s.n")
    return with_scalars(out, scope).select(
        F.format_string("$%.2f (%.2f - %.2f)", "mode_price", "start", "end").alias("label"),
        F.when(share < 0.01, "<0.01").otherwise(F.format_string("%.2f", share)).alias("proportion"),
        "count", "median_score", "median_owners", "mode_price", "start", "end",
    )


def bracket_ratio_diff(
    df: DataFrame,
    price: str,
    pos: str,
    neg: str,
    edges: Sequence[float] = K.PRICE_RATIO_EDGES,
    labels: Sequence[str] = K.PRICE_RATIO_LABELS,
) -> DataFrame:
    """Pooled positive ratio per price bracket minus the pooled ratio of everything in scope."""
    total = df.agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    overall = F.try_divide(F.col("_s.p").cast("double"), F.col("_s.p") + F.col("_s.n"))
    names = F.array(*[F.lit(x) for x in labels])
    binned = df.select(P.bucketize(price, edges).alias("bin"), pos, neg).where(F.col("bin").isNotNull())
    sums = binned.groupBy("bin").agg(F.coalesce(F.sum(pos), F.lit(0)).alias("positive"), F.coalesce(F.sum(neg), F.lit(0)).alias("negative"))
    ratio = F.try_divide(F.col("positive").cast("double"), F.col("positive") + F.col("negative"))
    return with_scalars(sums, total).select(
        F.get(names, F.col("bin")).alias("bracket"), "positive", "negative", ratio.alias("ratio"), (ratio - overall).alias("ratio_diff")
    )


def deviation_from_expected(df: DataFrame, group: str, predicate: Column, confidence: float = 0.95) -> DataFrame:
    """Observed count per group against the count expected from the overall share, with an interval."""
    counts = df.groupBy(group).agg(F.count_if(predicate).alias("observed"), F.count(F.lit(1)).alias("total"))
    overall = counts.agg(F.sum("observed").alias("o"), F.sum("total").alias("t"))
    share = F.coalesce(F.try_divide(F.col("_s.o").cast("double"), F.col("_s.t")), F.lit(0.0))
    lo, hi = M.binom_ci(F.col("observed"), F.col("total"), confidence)
    expected = F.col("total") * share

    def percent(value: Column, reference: Column) -> Column:
        return F.try_divide(value - reference, reference) * 100

    return with_scalars(counts, overall).select(
        group, "observed", "total", expected.alias("expected"),
        percent(F.col("observed"), expected).alias("percent_deviation"),
        percent(lo, share).alias("ci_lower"), percent(hi, share).alias("ci_upper"),
    )


def median_band(df: DataFrame, key: str, col: str, p: float = 5.0, max_groups: int | None = None) -> DataFrame:
    """Median per group with the band of +- ``p`` percentiles around it."""
    probs = {"lower": 0.5 - p / 100, "median": 0.5, "upper": 0.5 + p / 100}
    return exact_quantiles(df, col, probs, [key], max_groups)


def median_ci_by(
    df: DataFrame, key: str, col: str, above: float | None = None, top: float | None = 0.99,
    confidence: float = 0.95, max_groups: int | None = None,
) -> DataFrame:
    """Median, count and interval per group after dropping low values and the top share; bounds >= 0."""
    rows = df if above is None else df.where(F.col(col) > above)
    if top is not None:
        rows = below_quantile(rows, col, top)
    spread = rows.groupBy(key).agg(F.stddev_samp(F.col(col).cast("double")).alias("_sd"))
    medians = exact_quantiles(rows, col, {"median": 0.5}, [key], max_groups, count_as="count")
    joined = medians.alias("l").join(spread.alias("r"), null_safe([key], "l", "r")).select("l.*", "_sd")
    lo, hi = M.median_ci(F.col("median"), F.col("_sd"), F.col("count"), confidence)
    clip = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    return joined.select(key, "median", "count", clip(lo).alias("ci_lower"), clip(hi).alias("ci_upper"))


def interaction_effect(df: DataFrame, list_col: str, anchor: str, metric: str, min_n: int = 10, n: int = 10) -> DataFrame:
    """Mean metric of titles that combine ``anchor`` with another keyword, minus the anchor's own mean."""
    scope = df.where(F.array_contains(list_col, anchor)).select(list_col, metric)
    base = scope.agg(F.avg(metric).alias("m")).select("m").scalar()
    stats = scope.select(F.explode(F.array_distinct(list_col)).alias("item"), metric).where(F.col("item") != anchor)
    stats = stats.groupBy("item").agg(F.count(F.lit(1)).alias("count"), F.avg(metric).alias("_m")).where(F.col("count") >= min_n)
    return top_bottom(stats.select("item", "count", (F.col("_m") - base).alias("delta")), "delta", n, "item")


def box_stats(df: DataFrame, cat: str, metric: str, whisker: float = 1.5, max_groups: int | None = None) -> DataFrame:
    """Quartiles and whisker ends per category."""
    quartiles = exact_quantiles(df, metric, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [cat], max_groups, count_as="count")
    rows = attach_group_stats(df.select(cat, metric).where(F.col(metric).isNotNull()), quartiles, [cat], "count", max_groups)
    reach = (F.col("q3") - F.col("q1")) * whisker
    inside = F.col(metric).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(cat, "count", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(metric))).alias("whisker_low"), F.max(F.when(inside, F.col(metric))).alias("whisker_high")
    )


def rank_factors(results: DataFrame, name: str = "factor", value: str = "variance_explained") -> DataFrame:
    """Factors by explained variance with their tier: >= 0.05, >= 0.01, below."""
    tier = F.when(F.col(value) >= 0.05, "significant").when(F.col(value) >= 0.01, "small but noticeable").otherwise("none")
    return results.withColumn("tier", tier).orderBy(F.desc_nulls_last(value), name)


def titles_in_scope(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("titles"))


def explode_counts(df: DataFrame, list_col: str) -> DataFrame:
    return df.select(F.explode(list_col).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("count"))


def keep_top_items(df: DataFrame, list_col: str, n: int) -> DataFrame:
    """Exploded rows of the ``n`` most frequent keywords."""
    return keep_top_n(df.withColumn("item", F.explode(list_col)), "item", n)
