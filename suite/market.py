"""Filters, reports, statistics and smoothing over the items view."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions import metrics as M
from marquetry.operators import filters as H
from marquetry.operators import reports as I
from marquetry.operators import smooth as S
from marquetry.operators import stats as J
from marquetry.plans import ranking
from marquetry.plans.quantiles import exact_quantiles, mode_by
from marquetry.plans.skew import with_scalars
from suite.items import MODELS, YEARS, items, joined, over_items, query, r6, table

# -- filters ------------------------------------------------------------------------


@query("h01_year_range", over_items("select item_id, release_year from items where release_year between 1996 and 1998"))
def _(spark, sf):
    return H.between(items(spark, sf), "release_year", 1996, 1998).select("item_id", "release_year")


@query("h02_has_item", over_items("select item_id from items where list_contains(tags, 'ring')"))
def _(spark, sf):
    return H.has_item(items(spark, sf), "tags", "ring").select("item_id")


@query("h03_thresholds", over_items("select item_id, total_reviews from items where total_reviews >= 3 and ratio >= 0.2 and ratio <= 0.9 and owners > 10 and len(tags) < 8"))
def _(spark, sf):
    rows = items(spark, sf).withColumn("n_tags", F.size("tags"))
    kept = H.thresholds(rows, at_least={"total_reviews": 3, "ratio": 0.2}, above={"owners": 10}, at_most={"ratio": 0.9}, below={"n_tags": 8})
    return kept.select("item_id", "total_reviews")


@query("h04_trim_quantiles", over_items("select item_id from items, q where owners >= lo and owners <= hi", q="select quantile_cont(owners, 0.01) lo, quantile_cont(owners, 0.99) hi from items"))
def _(spark, sf):
    return H.trim_quantiles(items(spark, sf), "owners").select("item_id")


@query("h05_below_top_percent", over_items("select item_id from items where price < (select quantile_cont(price, 0.99) from items)"))
def _(spark, sf):
    return H.below_quantile(items(spark, sf), "price", 0.99).select("item_id")


@query("h06_top_decile", over_items("select item_id from items where owners > (select quantile_cont(owners, 0.9) from items)"))
def _(spark, sf):
    return H.above_quantile(items(spark, sf), "owners", 0.9).select("item_id")


_IQR = "select quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 from items"


@query("h07_iqr_drop", over_items("select item_id from items, q where total_reviews between floor(q1 - 1.5 * (q3 - q1)) and ceil(q3 + 1.5 * (q3 - q1))", q=_IQR.format(c="total_reviews")))
def _(spark, sf):
    return H.iqr_outliers(items(spark, sf), "total_reviews").select("item_id")


@query("h07_iqr_cap", over_items("select item_id, round(case when owners is null then null else greatest(least(owners, q3 + 0.5 * (q3 - q1)), q1 - 0.5 * (q3 - q1)) end, 6) as owners from items, q", q=_IQR.format(c="owners")))
def _(spark, sf):
    return H.iqr_outliers(items(spark, sf), "owners", k=0.5, cap=True).select("item_id", r6("owners"))


@query("h08_price_range", over_items("select item_id, price from items where price between 60 and 80"))
def _(spark, sf):
    return H.between(items(spark, sf), "price", 60, 80).select("item_id", "price")


@query("h09_keep_top_n", over_items("select item_id, factor from items where factor in (select factor from items group by factor order by count(*) desc, factor limit 2)"))
def _(spark, sf):
    return H.keep_top_n(items(spark, sf), "factor", 2).select("item_id", "factor")


@query("h10_facet_counts", over_items("select w as value, count(*) as count, w || ' (' || count(*) || ')' as label from (select unnest(tags) as w from items) group by w"))
def _(spark, sf):
    return H.facet_counts(items(spark, sf), "tags", by_label=True)


@query("h11_extent", over_items("select min(release_year) as lo, max(release_year) as hi from items"))
def _(spark, sf):
    return H.extent(items(spark, sf), "release_year")


@query("h12_sample_warnings", over_items("select release_date, count(*) as count from items group by 1 having count(*) < 5 order by 1 limit 3"))
def _(spark, sf):
    return H.sample_warnings(items(spark, sf), "release_date", min_n=5)


@query("h12_sample_size_level", over_items("select count(*) as titles, case when count(*) < 50 then 'limited' when count(*) < 250 then 'noisy' else 'ok' end as level from items where model = 'P'"))
def _(spark, sf):
    return H.sample_size_level(items(spark, sf).where("model = 'P'"))


# -- counts, shares and pivots ------------------------------------------------------


@query("i01_releases_per_year", over_items("select release_year, count(*) as count from items group by 1"))
def releases_per_year(spark, sf):
    return I.count_by(items(spark, sf), ["release_year"])


@query("i02_owners_per_year", over_items("select release_year, round(sum(owners), 6) as total from items group by 1"))
def _(spark, sf):
    return I.sum_by(items(spark, sf), ["release_year"], "owners").select("release_year", r6("total"))


_SHARE = """select release_year, item, count, round(count / sum(count) over (partition by release_year), 6) as share from (
  select release_year, item, count(*) as count from x where item in (select item from x group by item order by count(*) desc, item limit {n}) group by 1, 2)"""


@query("i03_keyword_share_per_year", over_items(_SHARE.format(n=5), x="select release_year, unnest(tags) as item from items"))
def _(spark, sf):
    return I.category_share_long(items(spark, sf), "release_year", "tags", 5).select("release_year", "item", "count", r6("share"))


@query("i04_keyword_share_top15", over_items(_SHARE.format(n=15), x="select release_year, unnest(tags) as item from items"))
def _(spark, sf):
    return I.category_share_long(items(spark, sf), "release_year", "tags").select("release_year", "item", "count", r6("share"))


@query(
    "i04_keyword_share_wide",
    over_items(
        "select release_year, round(a / (a + b), 6) as ring, round(b / (a + b), 6) as bolt from (select release_year, count_if(list_contains(tags, 'ring')) as a, count_if(list_contains(tags, 'bolt')) as b from items group by 1)"
    ),
)
def _(spark, sf):
    return I.category_share(items(spark, sf), "release_year", "tags", ["ring", "bolt"]).select("release_year", r6("ring"), r6("bolt"))


@query("i05_owner_stats_per_year", over_items("select release_year, round(median(owners), 6) as median, round(avg(owners), 6) as mean from items group by 1"))
def _(spark, sf):
    return I.stats_by(items(spark, sf), "release_year", "owners", YEARS).select("release_year", r6("median"), r6("mean"))


@query("i05_owner_stats_many_groups", over_items("select release_date, round(median(owners), 6) as median, round(avg(owners), 6) as mean from items group by 1"))
def _(spark, sf):
    return I.stats_by(items(spark, sf), "release_date", "owners").select("release_date", r6("median"), r6("mean"))


@query("i06_top_decile_median", over_items("select release_year, round(median(owners), 6) as median from items where owners > (select quantile_cont(owners, 0.9) from items) group by 1"))
def _(spark, sf):
    top = H.above_quantile(items(spark, sf), "owners", 0.9)
    return exact_quantiles(top, "owners", {"median": 0.5}, ["release_year"], YEARS).select("release_year", r6("median"))


@query("i07_mean_ratio_per_year", over_items("select release_year, round(avg(ratio), 6) as mean_ratio from items where pos is not null and neg is not null group by 1"))
def _(spark, sf):
    rows = items(spark, sf).dropna(subset=["pos", "neg"])
    return I.mean_ratio_by(rows, "release_year", "pos", F.col("pos") + F.col("neg")).select("release_year", r6("mean_ratio"))


_BRACKETS = (("Free", None), ("<100", 100), ("100-200", 200), ("200-300", 300), ("300+", None))


@query(
    "i08_price_bracket_share",
    over_items(
        'select release_year, round(a / t, 6) as "Free", round(b / t, 6) as "<100", round(c / t, 6) as "100-200", round(d / t, 6) as "200-300", round(e / t, 6) as "300+" from b',
        b="select release_year, count_if(price = 0) a, count_if(price > 0 and price < 100) b, count_if(price >= 100 and price < 200) c, count_if(price >= 200 and price < 300) d, count_if(price >= 300) e, count(price) t from items group by 1",
    ),
)
def _(spark, sf):
    out = I.bracket_share(items(spark, sf), "release_year", "price", _BRACKETS)
    return out.select("release_year", *[F.round(F.col(f"`{b[0]}`"), 6).alias(b[0]) for b in _BRACKETS])


@query("i09_models_per_year", over_items("select release_year, count_if(model = 'F')::bigint as \"F\", count_if(model = 'O')::bigint as \"O\", count_if(model = 'P')::bigint as \"P\" from items group by 1"))
def _(spark, sf):
    return I.pivot_count(items(spark, sf), "release_year", "model", MODELS)


_CAP = "select release_year, model, least(greatest(owners, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) as v from items, q where owners is not null"


def _pivot_sql(expr: str) -> str:
    return ", ".join(expr.format(m=m) + f' as "{m}"' for m in MODELS)


@query(
    "i10_capped_owners_per_model",
    over_items("select release_year, " + _pivot_sql("round(coalesce(sum(v) filter (model = '{m}'), 0) / 1000000.0, 6)") + " from c group by 1", q=_IQR.format(c="owners"), c=_CAP),
)
def _(spark, sf):
    capped = H.iqr_outliers(items(spark, sf), "owners", cap=True)
    return I.pivot_sum(capped, "release_year", "model", "owners", MODELS, 1e6).select("release_year", *[r6(m) for m in MODELS])


@query(
    "i11_capped_revenue_per_model",
    over_items(
        "select release_year, " + _pivot_sql("round(coalesce(sum(v) filter (model = '{m}'), 0), 2)") + " from c group by 1",
        rev="select release_year, model, owners * price as revenue from items",
        q="select quantile_cont(revenue, 0.25) q1, quantile_cont(revenue, 0.75) q3 from rev",
        c="select release_year, model, least(greatest(revenue, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) as v from rev, q where revenue is not null",
    ),
)
def _(spark, sf):
    rows = items(spark, sf).withColumn("revenue", F.col("owners") * F.col("price"))
    out = I.pivot_sum(H.iqr_outliers(rows, "revenue", cap=True), "release_year", "model", "revenue", MODELS)
    return out.select("release_year", *[F.round(m, 2).alias(m) for m in MODELS])


@query("i12_model_shares", over_items("select release_year, " + _pivot_sql("round(count_if(model = '{m}') / count(*), 6)") + " from items group by 1"))
def _(spark, sf):
    return I.row_share(I.pivot_count(items(spark, sf), "release_year", "model", MODELS), MODELS).select("release_year", *[r6(m) for m in MODELS])


_EFFECT = {
    "g": "select avg(ratio) as m from items",
    "e": "select model, item, avg(ratio) as mean_metric, count(item) as count from (select model, unnest(tags) as item, ratio from items) group by 1, 2",
    "s": "select e.*, (count * mean_metric + 10 * m) / (count + 10) as smoothed_mean, ((count * mean_metric + 10 * m) / (count + 10) - m) / m as relative_diff from e, g",
}


@query("i13_shrunk_keyword_effect", over_items("select model, item, count, round(mean_metric, 6) as mean_metric, round(smoothed_mean, 6) as smoothed_mean, round(relative_diff, 6) as relative_diff from s", **_EFFECT))
def _(spark, sf):
    out = I.shrunk_effect(items(spark, sf), "tags", "ratio", "model")
    return out.select("model", "item", "count", r6("mean_metric"), r6("smoothed_mean"), r6("relative_diff"))


@query(
    "i14_top_bottom_keywords",
    over_items(
        """select model, item, round(relative_diff, 6) as relative_diff, 'Top' as category from (select *, row_number() over (partition by model order by relative_diff desc, item) as k from s) where k <= 5
union all select model, item, round(relative_diff, 6), 'Bottom' from (select *, row_number() over (partition by model order by relative_diff, item) as k from s) where k <= 5""",
        **_EFFECT,
    ),
)
def _(spark, sf):
    effects = I.shrunk_effect(items(spark, sf), "tags", "ratio", "model")
    return I.top_bottom(effects, "relative_diff", 5, "item", "model").select("model", "item", r6("relative_diff"), "category")


_HIST = """select bin, round(lo + bin * w, 6) as "left", round(lo + (bin + 1) * w, 6) as "right", coalesce(value, 0) as value
from (select cast(range as integer) as bin from range(20)) left join c using (bin), s"""


@query(
    "i15_price_histogram",
    over_items(_HIST, s="select min(price) lo, (max(price) - min(price)) / 20 w from items",
               c="select cast(least(floor((price - lo) / w), 19) as integer) as bin, count(*) as value from items, s where price is not null group by 1"),
)
def _(spark, sf):
    return I.histogram(items(spark, sf), "price", 20).select("bin", r6("left"), r6("right"), "value")


@query(
    "i16_owner_weighted_histogram",
    over_items(_HIST.replace("coalesce(value, 0)", "coalesce(round(value, 6), 0)"), s="select min(price) lo, (max(price) - min(price)) / 20 w from items where owners is not null",
               c="select cast(least(floor((price - lo) / w), 19) as integer) as bin, sum(owners) as value from items, s where price is not null and owners is not null group by 1"),
)
def _(spark, sf):
    return I.histogram(items(spark, sf), "price", 20, weight="owners").select("bin", r6("left"), r6("right"), r6("value"))


@query(
    "i17_common_prices",
    over_items(
        """select format('${:.2f} ({:.2f} - {:.2f})', mode_price, start, "end") as label, case when count / n < 0.01 then '<0.01' else format('{:.2f}', count / n) end as proportion,
  count, round(median_score, 6) as median_score, round(median_owners, 6) as median_owners from t join md using (start), tot""",
        x="select price / 10 as p, ratio, owners from items",
        tot="select count(*) n, max(p) hi from x",
        b="""select p, ratio, owners, case when p < 2 then round(floor(p / 0.1 + 1e-9) * 0.1, 6) when p < 5 then 2 + floor((p - 2) / 0.25 + 1e-9) * 0.25
  when p < 15 then 5 + floor((p - 5) / 0.5 + 1e-9) * 0.5 else floor(p) end as start,
  case when p < 2 then 0.1 when p < 5 then 0.25 when p < 15 then 0.5 else 1.0 end as width from x, tot where p is not null and p >= 0 and p < 15 + ceil(hi + 1 - 15) - 1""",
        t="select start, round(start + any_value(width), 6) as \"end\", count(*) as count, median(ratio) as median_score, median(owners) as median_owners from b group by start order by count desc, start limit 25",
        md="select start, p as mode_price from (select start, p, row_number() over (partition by start order by count(*) desc, p) as k from b group by 1, 2) where k = 1",
    ),
)
def _(spark, sf):
    rows = items(spark, sf).withColumn("p", F.col("price") / 10)
    out = I.common_values(rows, "p", "ratio", "owners")
    return out.select("label", "proportion", "count", r6("median_score"), r6("median_owners"))


@query(
    "i18_price_bracket_ratio_diff",
    over_items(
        "select bracket, positive, negative, round(positive / (positive + negative), 6) as ratio, round(positive / (positive + negative) - (select sum(pos) / sum(pos + neg) from items), 6) as ratio_diff from b",
        b="""select case when price > -0.001 and price <= 0.001 then '0' when price > 0.001 and price <= 100 then 'low' when price > 100 and price <= 300 then 'mid' when price > 300 then 'high' end as bracket,
  cast(coalesce(sum(pos), 0) as bigint) as positive, cast(coalesce(sum(neg), 0) as bigint) as negative from items where price is not null group by 1""",
    ),
)
def _(spark, sf):
    out = I.bracket_ratio_diff(items(spark, sf), "price", "pos", "neg", (-0.001, 0.001, 100, 300, float("inf")), ("0", "low", "mid", "high"))
    return out.select("bracket", "positive", "negative", r6("ratio"), r6("ratio_diff"))


_Z = M.z_two_sided(0.95)
_DEVIATION = {
    "c": "select release_year, count_if(list_contains(tags, 'ring'))::bigint as observed, count(*) as total from items group by 1",
    "g": "select sum(observed) / sum(total) as p from c",
    "d": f"select *, total * p as expected, observed / total as ph, {_Z} * sqrt((observed / total) * (1 - observed / total) / total) as m from c, g",
}


@query(
    "i19_deviation_from_expected",
    over_items(
        """select release_year, observed, total, round(expected, 6) as expected, round((observed - expected) / expected * 100, 6) as percent_deviation,
  round((least(greatest(ph - m, 0), 1) - p) / p * 100, 6) as ci_lower, round((least(greatest(ph + m, 0), 1) - p) / p * 100, 6) as ci_upper from d""",
        **_DEVIATION,
    ),
)
def _(spark, sf):
    out = I.deviation_from_expected(items(spark, sf), "release_year", F.array_contains("tags", "ring"))
    return out.select("release_year", "observed", "total", r6("expected"), r6("percent_deviation"), r6("ci_lower"), r6("ci_upper"))


@query("i20_median_band", over_items("select release_year, round(quantile_cont(ratio, 0.45), 6) as lower, round(median(ratio), 6) as median, round(quantile_cont(ratio, 0.55), 6) as upper from items where total_reviews >= 2 and ratio >= 0.1 group by 1"))
def _(spark, sf):
    rows = H.thresholds(items(spark, sf), at_least={"total_reviews": 2, "ratio": 0.1})
    return I.median_band(rows, "release_year", "ratio", 5, YEARS).select("release_year", r6("lower"), r6("median"), r6("upper"))


_CI = f"""select {{k}}, round(md, 6) as median, n as count, round(greatest(md - {_Z} * 1.2533 * sd / sqrt(n), 0), 6) as ci_lower, round(greatest(md + {_Z} * 1.2533 * sd / sqrt(n), 0), 6) as ci_upper
from (select {{k}}, median({{v}}) md, count({{v}}) n, stddev_samp({{v}}) sd from r where {{v}} < (select quantile_cont({{v}}, 0.99) from r) group by 1)"""


@query("i21_median_owners_ci", over_items(_CI.format(k="release_year", v="owners"), r="select * from items where owners > 5"))
def _(spark, sf):
    out = I.median_ci_by(items(spark, sf), "release_year", "owners", above=5, max_groups=YEARS)
    return out.select("release_year", r6("median"), "count", r6("ci_lower"), r6("ci_upper"))


@query("i22_median_price_ci", over_items(_CI.format(k="factor", v="price"), r="select * from items where price > 0.1"))
def _(spark, sf):
    out = I.median_ci_by(items(spark, sf), "factor", "price", above=0.1, max_groups=YEARS)
    return out.select("factor", r6("median"), "count", r6("ci_lower"), r6("ci_upper"))


@query("i22_global_median", over_items("select round(median(price), 6) as median from items where price > 0.1"))
def _(spark, sf):
    return exact_quantiles(items(spark, sf).where("price > 0.1"), "price", {"median": 0.5}).select(r6("median"))


_WEIGHTS = ", ".join(f"({t}, {s}, {w!r})" for t, s, w in S.savgol_weights(50, 13, 2))


@query(
    "i23_k01_smoothed_distributions",
    over_items(
        "select bin, round(subset, 6) as subset, round(overall / sum(overall) over () * sum(subset) over (), 6) as overall from m",
        w=f"select * from (values {_WEIGHTS}) v(target, source, w)",
        h="select cast(least(floor(price / 10), 49) as integer) as bin, count_if(list_contains(tags, 'ring')) as s, count(*) as o from items where price >= 0 group by 1",
        f="select cast(range as integer) as bin, coalesce(s, 0) as s, coalesce(o, 0) as o from range(50) left join h on h.bin = range",
        m="select target as bin, greatest(sum(w * s), 0) as subset, greatest(sum(w * o), 0) as overall from w join f on f.bin = source group by 1",
    ),
)
def _(spark, sf):
    out = S.compare_distributions(items(spark, sf), "price", F.array_contains("tags", "ring"), width=10, top=500)
    return out.select("bin", r6("subset"), r6("overall"))


@query(
    "i24_keyword_interactions",
    over_items(
        """select item, count, round(delta, 6) as delta, 'Top' as category from (select * from d order by delta desc, item limit 3)
union all select item, count, round(delta, 6), 'Bottom' from (select * from d order by delta, item limit 3)""",
        a="select tags, ratio from items where list_contains(tags, 'ring')",
        d="select item, count(*) as count, avg(ratio) - (select avg(ratio) from a) as delta from (select unnest(tags) as item, ratio from a) where item <> 'ring' group by 1 having count(*) >= 10",
    ),
)
def _(spark, sf):
    return I.interaction_effect(items(spark, sf), "tags", "ring", "ratio", n=3).select("item", "count", r6("delta"), "category")


@query(
    "i26_box_stats",
    over_items(
        """select factor, n as count, round(q1, 4) as q1, round(md, 4) as median, round(q3, 4) as q3,
  round(min(price) filter (price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
  round(max(price) filter (price between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high from items join q using (factor) where price is not null group by 1, 2, 3, 4, 5, q1, md, q3""",
        q="select factor, count(price) n, quantile_cont(price, 0.25) q1, median(price) md, quantile_cont(price, 0.75) q3 from items group by 1",
    ),
)
def _(spark, sf):
    out = I.box_stats(items(spark, sf), "factor", "price", max_groups=YEARS)
    return out.select("factor", "count", *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], r6("whisker_low"), r6("whisker_high"))


@query("i27_titles_in_scope", over_items("select count(*) as titles from items where release_year = 1997 and model = 'O'"))
def _(spark, sf):
    return I.titles_in_scope(items(spark, sf).where("release_year = 1997 and model = 'O'"))


# -- statistics ---------------------------------------------------------------------


@query(
    "j01_binomial_interval",
    over_items("select release_year, observed, total, round(least(greatest(ph - m, 0), 1), 6) as lo, round(least(greatest(ph + m, 0), 1), 6) as hi from d", **_DEVIATION),
)
def _(spark, sf):
    counts = items(spark, sf).groupBy("release_year").agg(F.count_if(F.array_contains("tags", "ring")).alias("observed"), F.count(F.lit(1)).alias("total"))
    lo, hi = M.binom_ci(F.col("observed"), F.col("total"))
    return counts.select("release_year", "observed", "total", r6(lo, "lo"), r6(hi, "hi"))


@query("j02_median_interval", over_items(f"select model, round(median(price), 6) as median, round(median(price) - {_Z} * 1.2533 * stddev_samp(price) / sqrt(count(price)), 6) as lo, round(median(price) + {_Z} * 1.2533 * stddev_samp(price) / sqrt(count(price)), 6) as hi from items group by 1"))
def _(spark, sf):
    rows = items(spark, sf)
    medians = exact_quantiles(rows, "price", {"median": 0.5}, ["model"], YEARS, count_as="n")
    both = medians.join(rows.groupBy("model").agg(F.stddev_samp("price").alias("sd")), "model")
    lo, hi = M.median_ci(F.col("median"), F.col("sd"), F.col("n"))
    return both.select("model", r6("median"), r6(lo, "lo"), r6(hi, "hi"))


_ADJUST = """select item_id, factor, release_year, (ratio - avg(ratio) over y) / nullif(stddev_samp(ratio) over y, 0) * (select stddev_samp(ratio) from items) + (select avg(ratio) from items) as a
from items window y as (partition by release_year)"""


@query("j03_adjust_for_year", over_items("select item_id, round(a, 6) as adjusted from a", a=_ADJUST))
def _(spark, sf):
    out = J.adjust_for_group(items(spark, sf), "ratio", "release_year", "adjusted", max_groups=YEARS)
    return out.select("item_id", r6("adjusted"))


@query("j03_adjust_many_groups", over_items("select item_id, round(a, 6) as adjusted from a", a=_ADJUST.replace("partition by release_year", "partition by release_date")))
def _(spark, sf):
    return J.adjust_for_group(items(spark, sf), "ratio", "release_date", "adjusted").select("item_id", r6("adjusted"))


@query(
    "j04_linear_regression",
    over_items("select regr_count(owners, price)::bigint as n, round(regr_intercept(owners, price), 6) as intercept, round(regr_slope(owners, price), 6) as slope, round(regr_r2(owners, price), 6) as r_squared, round(regr_r2(owners, price) / (1 - regr_r2(owners, price)), 6) as cohen_f2 from items"),
)
def _(spark, sf):
    fit = J.poly_regression(items(spark, sf), "price", "owners", 1)
    return fit.select("n", r6(F.col("coefficients")[0], "intercept"), r6(F.col("coefficients")[1], "slope"), r6("r_squared"), r6("cohen_f2"))


_NORMAL = {
    "z": "select (price - (select avg(price) from items where price is not null and owners is not null)) / 100 as z, owners as y from items where price is not null and owners is not null",
    "m": "select count(*) s0, sum(z) s1, sum(z*z) s2, sum(z*z*z) s3, sum(z*z*z*z) s4, sum(y) t0, sum(z*y) t1, sum(z*z*y) t2, sum(y*y) yy from z",
    "d": "select *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) as det from m",
    "b": """select *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det as b0,
  (s0*(t1*s4-t2*s3) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det as b1,
  (s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / det as b2 from d""",
}


@query("j04_quadratic_regression", over_items("select s0 as n, round(1 - (yy - b0*t0 - b1*t1 - b2*t2) / (yy - t0*t0/s0), 6) as r_squared from b", **_NORMAL))
def _(spark, sf):
    return J.poly_regression(items(spark, sf), "price", "owners", 2).select("n", r6("r_squared"))


@query(
    "j05_welch_ttest",
    over_items(
        """select '0' as group_1, '1' as group_2, round((m1 - m2) / sqrt(e1 + e2), 6) as t_stat, round((e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)), 4) as dof,
  round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) as cohen_d from (select *, v1 / n1 as e1, v2 / n2 as e2 from g)""",
        g="select count(n_chars) filter (toxic = 0) n1, avg(n_chars) filter (toxic = 0) m1, var_samp(n_chars) filter (toxic = 0) v1, count(n_chars) filter (toxic = 1) n2, avg(n_chars) filter (toxic = 1) m2, var_samp(n_chars) filter (toxic = 1) v2 from documents join labels using (doc_id)",
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    out = J.welch_ttest(rows, "n_chars", "toxic", p_value=False)
    return out.select("group_1", "group_2", r6("t_stat"), F.round("dof", 4).alias("dof"), r6("cohen_d"))


_ANOVA = """select k as groups, n, round((ssb / (k - 1)) / (ssw / (n - k)), 6) as f_stat, round(ssb / (ssb + ssw), 6) as eta_squared
from (select count(*) k, sum(n) n, sum(n * (m - (select avg({y}) from {t}))^2) ssb, sum((n - 1) * v) ssw from (select {c}, count({y}) n, avg({y}) m, var_samp({y}) v from {t} where {y} is not null group by 1))"""


@query("j06_anova", over_items(_ANOVA.format(y="ratio", c="factor", t="items").replace("sum(n) n,", "cast(sum(n) as bigint) n,")))
def _(spark, sf):
    return J.anova(items(spark, sf), "ratio", "factor", p_value=False).select("groups", "n", r6("f_stat"), r6("eta_squared"))


@query(
    "j07_categorical_factor_by_year",
    over_items(_ANOVA.format(y="a", c="factor", t="a").replace("sum(n) n,", "cast(sum(n) as bigint) n,").replace("select k as groups, n,", "select 'factor' as factor, n,").replace("round((ssb / (k - 1)) / (ssw / (n - k)), 6) as f_stat, ", "").replace("6) as eta_squared", "3) as variance_explained"),
               a=_ADJUST.replace("from items window", "from items where ratio is not null window")),
)
def _(spark, sf):
    out = J.categorical_factors(items(spark, sf), "ratio", [J.Factor("factor", F.col("factor"))])
    return out.select("factor", "n", "variance_explained")


@query("j08_numeric_factor", over_items("select 'price' as factor, regr_count(ratio, price)::bigint as n, round(regr_r2(ratio, price), 3) as variance_explained from items where price > 0"))
def _(spark, sf):
    out = J.numeric_factors(items(spark, sf), "ratio", [J.Factor("price", F.col("price"), F.col("price") > 0)])
    return out.select("factor", "n", "variance_explained")


def _factors():
    numeric = [
        J.Factor("price", F.col("price"), F.col("price") > 0, trim=(0.01, 0.99)),
        J.Factor("owners", F.col("owners"), F.col("total_reviews") >= 2, degree=2),
        J.Factor("tags", F.size("tags")),
    ]
    categorical = [J.Factor("factor", F.col("factor")), J.Factor("model", F.col("model"))]
    return numeric, categorical


@query("j09_i25_factor_battery")
def _(spark, sf):
    return I.rank_factors(J.factor_battery(items(spark, sf), "ratio", *_factors()))


def battery_titles(spark, sf):
    """Items as catalog titles, with every column that the catalog's own battery reads."""
    k = F.col("item_id")
    words = lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: i.cast("string"))).otherwise(F.array())
    pick = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    return items(spark, sf).select(
        "release_year", "tags", F.col("ratio").alias("steam_positive_review_ratio"), (F.col("total_reviews") * 3).alias("steam_total_reviews"),
        (k % 120).alias("achievements_count"), F.when(k % 4 != 0, F.col("owners") / 3).alias("average_time_to_beat"),
        words((k % 25).cast("int")).alias("languages_supported"), words(((k + F.col("pos")) % 22).cast("int")).alias("languages_with_full_audio"),
        F.col("price").alias("price_original"), (F.col("pos") % 6).alias("steam_store_movie_count"),
        (F.col("neg") * 3 + k % 7).alias("steam_store_screenshot_count"), pick(["full", "partial", None, "none", "odd"], k % 5).alias("controller_support"),
        F.when(k % 3 == 0, F.col("pos") > 2).alias("early_access"), pick(["Easy", "Tough", None, "Simple", "Odd"], (k + F.col("pos")) % 5).alias("gamefaqs_difficulty_rating"),
        (F.col("pos") > F.col("neg")).alias("has_demos"), (k % 2 == 0).alias("runs_on_linux"), (F.col("neg") > 3).alias("runs_on_mac"),
        F.lit(True).alias("runs_on_steam_deck"), (F.col("owners") > 100).alias("runs_on_windows"), (F.col("model") == "P").alias("vr_supported"),
    )


_BATTERY = {
    "c": """select item_id as k, release_year as yr, ratio as y, item_id % 120 as ach, case when item_id % 4 <> 0 then owners / 3 end as ttb, item_id % 25 as langs,
  (item_id + pos) % 22 as audio, price, pos % 6 as movies, neg * 3 + item_id % 7 as shots, len(tags) as tags, total_reviews * 3 >= 10 and ratio > 0 as rated,
  ['3. Full', '2. Partial', 'unknown', '1. None', null][item_id % 5 + 1] as ctrl, case when item_id % 3 = 0 then (pos > 2)::varchar else 'unknown' end as early,
  ['Easy', 'Tough', 'unknown', 'Simple', null][(item_id + pos) % 5 + 1] as hard, pos > neg as demos, item_id % 2 = 0 as linux, neg > 3 as mac,
  owners > 100 as win, model = 'P' as vr from items""",
    "nums": """select 'achievements_count' as factor, 2 as deg, 0.0 as lo, 1.0 as hi, cast(ach as double) as x, y from c where ach > 0 and ach < 100
  union all select 'average_time_to_beat', 1, 0.01, 0.99, ttb, y from c
  union all select 'languages_supported_count', 1, 0.0, 1.0, langs, y from c where rated and langs < 20
  union all select 'languages_with_full_audio_count', 2, 0.0, 1.0, audio, y from c where audio > 0 and audio < 20
  union all select 'price_original', 1, 0.01, 0.99, price, y from c where rated and price > 0
  union all select 'steam_store_movie_count', 1, 0.01, 0.99, movies, y from c
  union all select 'steam_store_screenshot_count', 2, 0.0, 0.99, shots, y from c
  union all select 'tags_count', 1, 0.0, 1.0, tags, y from c""",
    "known": "select * from nums where x is not null and y is not null",
    "ends": """select factor, case any_value(lo) when 0.01 then quantile_cont(x, 0.01) else min(x) end as a,
  case any_value(hi) when 0.99 then quantile_cont(x, 0.99) else max(x) end as b from known group by 1""",
    "kept": "select known.* from known join ends using (factor) where x between a and b",
    "z": "select k.factor, deg, (x - mx) / sx as z, y - my as y from kept k join (select factor, avg(x) mx, stddev_pop(x) sx, avg(y) my from kept group by 1) using (factor)",
    "m": """select factor, any_value(deg) deg, count(*) s0, sum(z) s1, sum(z*z) s2, sum(z*z*z) s3, sum(z*z*z*z) s4, sum(y) t0, sum(z*y) t1, sum(z*z*y) t2, sum(y*y) yy,
  regr_r2(y, z) r1 from z group by 1""",
    "d": "select *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) as det from m",
    "b": _NORMAL["b"],
    "cats": " union all ".join(
        f"select '{name}' as factor, yr, cast({col} as varchar) as label, y from c"
        for name, col in {"controller_support": "ctrl", "early_access": "early", "gamefaqs_difficulty_rating": "hard", "has_demos": "demos",
                          "runs_on_linux": "linux", "runs_on_mac": "mac", "runs_on_windows": "win", "vr_supported": "vr"}.items()
    ),
    "adj": """select factor, label, (y - avg(y) over g) / nullif(stddev_samp(y) over g, 0) * stddev_samp(y) over f + avg(y) over f as a
  from cats where label is not null and y is not null window g as (partition by factor, yr), f as (partition by factor)""",
    "groups": "select factor, label, count(a) n, avg(a) m, sum(a * a) - count(a) * avg(a) * avg(a) ss from adj where a is not null group by 1, 2",
    "anova": """select factor, cast(sum(n) as bigint) n, sum(n * (m - om) * (m - om)) ssb, sum(ss) ssw from groups
  join (select factor, avg(a) om from adj group by 1) using (factor) group by 1 having count(*) >= 2""",
    "found": """select factor, s0 as n, round(case deg when 1 then r1 else 1 - (yy - b0*t0 - b1*t1 - b2*t2) / (yy - t0*t0/s0) end, 3) as variance_explained from b
  union all select factor, n, round(ssb / (ssb + ssw), 3) from anova""",
}


@query(
    "j09_i25_catalog_battery",
    over_items(
        """select factor, n, variance_explained, case when variance_explained >= 0.05 then 'significant' when variance_explained >= 0.01 then 'small but noticeable' else 'none' end as tier
from found""",
        **_BATTERY,
    ),
)
def _(spark, sf):
    """The catalog's 17 factors with their own row filters, trims and degrees (a factor with one group has no result)."""
    ranked = I.rank_factors(J.factor_battery(battery_titles(spark, sf), "steam_positive_review_ratio", *J.catalog_factors()))
    return ranked.select("factor", "n", "variance_explained", "tier")


@query(
    "j10_quadratic_trend",
    over_items(
        "select x as release_year, y as median, round(b0 + b1 * (x - 1998) + b2 * (x - 1998)^2, 4) as trend from (select release_year x, median(owners) y from items group by 1), b",
        z="select release_year - 1998 as z, median(owners) as y from items group by 1",
        **{k: v for k, v in _NORMAL.items() if k != "z"},
    ),
)
def _(spark, sf):
    series = exact_quantiles(items(spark, sf), "owners", {"median": 0.5}, ["release_year"], YEARS)
    return J.trend(series, "release_year", "median").select("release_year", "median", F.round("trend", 4).alias("trend"))


# -- smoothing ----------------------------------------------------------------------


@query(
    "k02_price_density",
    over_items(
        "select round(g, 6) as x, round(sum(exp(-0.5 * ((g - price) / h)^2)) / (h * sqrt(2 * pi())) * w, 6) as density from items, p where price is not null group by g, h, w",
        s="select count(price) n, min(price) lo, max(price) hi, stddev_samp(price) sd from items",
        p="select lo + range * (hi - lo) / 39 as g, sd * pow(n, -0.2) as h, (hi - lo) / 20 as w from s, range(40)",
    ),
)
def _(spark, sf):
    return S.kde(items(spark, sf), "price", 40, scale_bins=20).select(r6("x"), r6("density"))


_GRID = S.price_grid(0.0, 490.0, breaks=(50.0, 250.0), points=10)
_HALVES = [7.0 + 0.15 * g for g in _GRID]
_GRID_SQL = "select * from (values " + ", ".join(f"(cast({c!r} as double), cast({w!r} as double))" for c, w in zip(_GRID, _HALVES)) + ") v(center, half)"


@query(
    "k03_triangular_mean",
    over_items("select round(center, 6) as center, round(sum((1 - abs(price - center) / half) * ratio) / nullif(sum(1 - abs(price - center) / half), 0), 6) as mean from items, g where price between center - half and center + half and ratio is not null group by 1", g=_GRID_SQL),
)
def _(spark, sf):
    return S.triangular_mean(items(spark, sf), "ratio", "price", _GRID, _HALVES).select(r6("center"), r6("mean"))


@query(
    "k04_sliding_curve",
    over_items(
        """select round(center, 6) as center, round(m, 6) as mean, round(m - (q50 - q45), 6) as lower, round(m + (q55 - q50), 6) as upper from (
  select center, sum((1 - abs(price - center) / half) * ratio) / nullif(sum(1 - abs(price - center) / half), 0) as m, quantile_cont(ratio, 0.45) q45, median(ratio) q50, quantile_cont(ratio, 0.55) q55
  from items, g where price between center - half and center + half and ratio is not null group by 1)""",
        g=_GRID_SQL,
    ),
)
def _(spark, sf):
    out = S.sliding_curve(items(spark, sf), "ratio", "price", _GRID, half_width=lambda p: 7.0 + 0.15 * p)
    return out.select(r6("center"), r6("mean"), r6("lower"), r6("upper"))


# -- sorting and modes --------------------------------------------------------------


@query("m02_top_k", over_items("select item_id, owners from items order by owners desc nulls last, item_id limit 25"))
def _(spark, sf):
    return items(spark, sf).orderBy(F.desc_nulls_last("owners"), "item_id").limit(25).select("item_id", "owners")


@query("m03_skip_top_k", over_items("select item_id from (select item_id, row_number() over (order by owners desc nulls last, item_id) as k from items) where k > 25"))
def _(spark, sf):
    return H.drop_top_k(items(spark, sf), "owners", 25, "item_id").select("item_id")


@query("m05_list_set_operations", over_items("select item_id, array_to_string(list_sort(list_filter(tags, lambda x: x not in ('ring', 'bolt'))), '|') as minus, array_to_string(list_sort(list_distinct(list_concat(tags, ['ring', 'bolt']))), '|') as both from items"))
def _(spark, sf):
    other = F.array(F.lit("ring"), F.lit("bolt"))
    return items(spark, sf).select("item_id", joined(F.array_sort(F.array_except("tags", other)), "minus"), joined(F.array_sort(F.array_union("tags", other)), "both"))


@query("m08_explode_counts", over_items("select w as item, count(*) as count from (select unnest(tags) as w from items) group by 1"))
def _(spark, sf):
    return I.explode_counts(items(spark, sf), "tags")


@query("m08_mode_per_year", over_items("select release_year, total_reviews as mode from (select release_year, total_reviews, row_number() over (partition by release_year order by count(*) desc, total_reviews) as k from items where total_reviews is not null group by 1, 2) where k = 1"))
def _(spark, sf):
    return mode_by(items(spark, sf), "total_reviews", ["release_year"])


@query(
    "m01_global_sort",
    over_items("select item_id, price, row_number() over (order by price desc nulls last, model, item_id) as place from items"),
)
def _(spark, sf):
    order = [F.desc_nulls_last("price"), F.asc("model"), F.asc("item_id")]
    return ranking.place_rows(items(spark, sf).select("item_id", "price", "model"), order).drop("model")


@query(
    "k05_piecewise_grid",
    over_items(
        "select round(point, 6) as point, count(price) as below from g left join (select price from items where price is not null) on price <= point + 1e-9 group by 1",
        g="""select i * 5.0 / 30 as point from range(30) t(i) union all select 5 + i * 20.0 / 30 from range(30) t(i)
  union all select 25 + i * 475.0 / 29 from range(30) t(i)""",
    ),
)
def _(spark, sf):
    """Prices at or below each point of the three-segment grid."""
    grid = S.price_grid(0.0, 500.0)
    at = sum((F.when(F.col("price") > point + 1e-9, 1).otherwise(0) for point in grid), F.lit(0))
    counts = items(spark, sf).where("price is not null").groupBy(at.alias("first")).agg(F.count(F.lit(1)).alias("n"))
    points = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("point")) for i, p in enumerate(grid)]))
    rows = spark.range(1).select(points.alias("g")).select("g.*")
    rows = with_scalars(rows, counts.agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("m")))
    totals = F.col("_s.m")
    below = F.aggregate(F.sequence(F.lit(0), F.col("i")), F.lit(0).cast("bigint"), lambda a, k: a + F.coalesce(F.try_element_at(totals, k), F.lit(0).cast("bigint")))
    return rows.select(F.round("point", 6).alias("point"), below.alias("below"))


@query(
    "k05_step_bins",
    over_items(
        """select lo, count(*) as n from (select case when price < 5 then floor(price / 0.5) * 0.5 when price < 25 then 5 + floor((price - 5) / 2.5) * 2.5
  else 25 + floor((price - 25) / 25) * 25 end as lo from items where price is not null and price < 500) group by 1"""
    ),
)
def _(spark, sf):
    """Left-closed bins of piecewise-constant width."""
    edges = S.step_edges([(0, 5, 0.5), (5, 25, 2.5), (25, 500, 25)])
    lo = F.element_at(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= F.col("price")), -1)
    return items(spark, sf).where("price < 500").select(lo.alias("lo")).groupBy("lo").agg(F.count(F.lit(1)).alias("n"))
