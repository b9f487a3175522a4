"""From cleaned records to a model-ready matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry import constants as K
from marquetry.functions import parsing as P
from marquetry.plans.quantiles import WIDE_ACCURACY, exact_quantiles, melt
from marquetry.plans.ranking import dense_index
from marquetry.plans.skew import lookup_join, with_scalars
from marquetry.sources.writers import checkpoint

# fill policies understood by fill_policy besides constants and callables
MEDIAN, KEEP, EMPTY_LIST = "median", "keep", "empty_list"


def fill_policy(df: DataFrame, policy: Mapping[str, object]) -> DataFrame:
    """Fill nulls column by column.

    A policy is ``MEDIAN``, ``KEEP``, ``EMPTY_LIST``, ``("value", constant)`` or a Column -> Column
    function. All medians come from one pass. A column without a policy is an error.
    """
    unknown = [c for c in df.columns if c not in policy]
    if unknown:
        raise ValueError(f"no fill policy for {unknown}")
    wanted = [c for c in df.columns if policy[c] == MEDIAN]
    rows = with_scalars(df, _median_row(df, wanted), "_medians") if wanted else df
    types = dict(df.dtypes)
    out = []
    for c in df.columns:
        col, rule = F.col(f"`{c}`"), policy[c]
        if rule == MEDIAN:
            col = F.coalesce(col.cast("double"), F.col("_medians").getField(c))
        elif rule == EMPTY_LIST:
            col = F.coalesce(col, F.array().cast(types[c]))
        elif isinstance(rule, tuple) and rule[0] == "value":
            col = F.coalesce(col, F.lit(rule[1]))
        elif callable(rule):
            col = rule(col)
        elif rule != KEEP:
            raise ValueError(f"unknown policy {rule!r} for {c}")
        out.append(col.alias(c))
    return rows.select(out)


def _median_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column."""
    long = exact_quantiles(melt(df, cols), "value", {"median": 0.5}, ["column"], max_groups=len(cols), accuracy=WIDE_ACCURACY)
    return long.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(c) for c in cols])


# --- fixed values: fill policies of the catalog's no-null layer ---
NO_NULL_POLICY: dict[str, object] = {
    "achievements_count": MEDIAN,
    "appid": KEEP,
    "average_non_steam_review_score": MEDIAN,
    "average_time_to_beat": MEDIAN,
    "categories": EMPTY_LIST,
    "controller_support": KEEP,
    "developers": KEEP,
    "dlc_count": MEDIAN,
    "early_access": ("value", False),
    "estimated_gross_revenue_boxleiter": ("value", 0),
    "estimated_ltarpu": ("value", 0),
    "estimated_owners_boxleiter": ("value", 0),
    "gamefaqs_difficulty_rating": KEEP,
    "genres": EMPTY_LIST,
    "has_demos": ("value", False),
    "has_drm": ("value", False),
    "is_released": ("value", True),
    "languages_supported": EMPTY_LIST,
    "languages_with_full_audio": EMPTY_LIST,
    "monetization_model": ("value", "unknown"),
    "name": KEEP,
    "peak_ccu": ("value", 0),
    "playtime_avg": ("value", 0),
    "playtime_avg_2_weeks": ("value", 0),
    "playtime_median": ("value", 0),
    "playtime_median_2_weeks": ("value", 0),
    "price_latest": ("value", 0),
    "price_original": KEEP,
    "publishers": KEEP,
    "recommendations": ("value", 0),
    "release_day_of_month": ("value", 0),
    "release_month": ("value", 0),
    "release_year": ("value", 0),
    "required_age": ("value", 0),
    "runs_on_linux": ("value", False),
    "runs_on_mac": ("value", False),
    "runs_on_steam_deck": ("value", True),
    "runs_on_windows": ("value", True),
    "steam_negative_reviews": ("value", 0),
    "steam_positive_review_ratio": ("value", 0),
    "steam_positive_reviews": ("value", 0),
    "steam_store_movie_count": ("value", 0),
    "steam_store_screenshot_count": ("value", 0),
    "steam_total_reviews": ("value", 0),
    "tags": EMPTY_LIST,
    "vr_only": ("value", False),
    "vr_supported": ("value", False),
}
LABEL_COLUMNS = (
    "developers",
    "early_access",
    "has_demos",
    "has_drm",
    "monetization_model",
    "publishers",
    "runs_on_linux",
    "runs_on_mac",
    "runs_on_steam_deck",
    "runs_on_windows",
    "vr_only",
    "vr_supported",
)
LIST_PREFIXES = {
    "categories": "~category_",
    "genres": "~genre_",
    "languages_supported": "~lang_",
    "languages_with_full_audio": "~lang_audio_",
    "tags": "~tag_",
}


def difficulty_code(col: str | Column) -> Column:
    return P.recode(col, K.DIFFICULTY_CODES, -1, lower=True)


def controller_code(col: str | Column) -> Column:
    return P.recode(col, K.CONTROLLER_CODES, -1.0)


HEAVY_CODES = 10_000  # most frequent values whose codes are broadcast
HEAVY_TERMS = 100_000  # most frequent terms of a vocabulary whose places are


def label_codes(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Distinct values of ``col`` numbered by first appearance along ``order_col``, with row counts."""
    known = df.where(F.col(col).isNotNull())
    first = known.groupBy(col).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("rows"))
    numbered = dense_index(first, "_first", "code", tie=col)
    return numbered.select(col, F.col("code").cast("int").alias("code"), "rows")


def label_encode(df: DataFrame, cols: Sequence[str], order_col: str, heavy: int = HEAVY_CODES) -> DataFrame:
    """Replace each column by its first-appearance code, null -> -1. Any number of values is fine.

    One long-form pass finds the values of all columns. The codes of columns with at most ``heavy`` values are broadcast, and
    the rows stay where they are. Of the other columns the ``heavy`` most frequent values are, so no task receives a hot
    value; what is open then is looked up in long form (row, column, value) for all those columns together: three exchanges,
    however many they are.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols])
    long = df.select(F.col(f"`{order_col}`").alias("_o"), F.explode(pairs).alias("_p")).where("_p.value is not null")
    found = long.groupBy("_p.column", "_p.value").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("rows"))
    found = checkpoint(found)
    sizes = {r["column"]: r["count"] for r in found.groupBy("column").count().collect()}
    many = [c for c in cols if sizes.get(c, 0) > heavy]
    by = Window.partitionBy("column").orderBy("_first", "value")
    few = found.where(~F.col("column").isin(*many)).withColumn("code", F.row_number().over(by) - 1)
    codes = {c: few.where(F.col("column") == c) for c in cols if c not in many}
    large = {}
    for c in many:
        own = found.where(F.col("column") == c).select("column", "value", "_first", "rows")
        large[c] = checkpoint(dense_index(own, "_first", "code", tie="value"))
        codes[c] = large[c].orderBy(F.desc("rows"), "value").limit(heavy)
    frame = checkpoint(df.withColumn("_row", F.monotonically_increasing_id())) if many else df
    for c in cols:
        known = codes[c].select(F.col("value").alias("_value"), F.col("code").cast("int").alias("_code"))
        frame = frame.join(F.broadcast(known), F.col(f"`{c}`").cast("string") == F.col("_value"), "left")
        frame = frame.withColumnRenamed("_code", f"_code_{c}").drop("_value")
    if many:
        open_ = F.array_compact(F.array(*[
            F.when(F.col(f"`_code_{c}`").isNull(), F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))) for c in many
        ]))
        asked = frame.select("_row", F.explode(open_).alias("_p")).select("_row", "_p.*").where("value is not null")
        table = reduce(DataFrame.unionByName, [large[c].select("column", "value", F.col("code").cast("int").alias("_code")) for c in many])
        met = asked.join(table, ["column", "value"]).groupBy("_row")
        met = met.agg(*[F.max(F.when(F.col("column") == c, F.col("_code"))).alias(f"_late_{i}") for i, c in enumerate(many)])
        frame = frame.join(met, "_row", "left").drop("_row")
    late = {c: [F.col(f"_late_{i}")] for i, c in enumerate(many)}
    coded = {c: F.coalesce(F.col(f"`_code_{c}`"), *late.get(c, []), F.lit(-1)) for c in cols}
    return frame.select(*[coded[c].alias(c) if c in coded else F.col(f"`{c}`") for c in df.columns])


def list_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{c}_count": F.when(F.col(c).isNotNull(), F.size(c)) for c in cols})


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def null_total(df: DataFrame) -> DataFrame:
    """One row: nulls in the whole frame."""
    per_row = sum((F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns[1:]), F.col(f"`{df.columns[0]}`").isNull().cast("bigint"))
    return df.agg(F.coalesce(F.sum(per_row), F.lit(0)).alias("nulls"))


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(col).alias("term")).distinct()


def multi_hot_sparse(df: DataFrame, col: str, out: str):
    """Sparse 0/1 vector over the list's whole vocabulary; returns (frame, fitted model with the terms).

    The terms are counted first, so none is left out; the model holds every term in the driver, so this is for lists with
    a bounded vocabulary, such as tags. ``multi_hot_places`` takes any.
    """
    terms = vocabulary(df, col).where("term is not null").count()
    model = CountVectorizer(inputCol=col, outputCol=out, binary=True, vocabSize=max(1, terms)).fit(df)
    return model.transform(df).drop(col), model


def multi_hot_places(df: DataFrame, col: str, out: str) -> tuple[DataFrame, DataFrame]:
    """The sorted places of a list's terms in its whole vocabulary, of any size; returns (frame, table of term and code).

    The places are the ones of a sparse 0/1 vector. Null terms have none, a null list has null. Rows are numbered and
    stored first, so ids need not exist or differ; the vocabulary stays a distributed table, which the pairs of row and
    term meet in a join safe for hot terms.
    """
    given = {"_row": F.monotonically_increasing_id(), "_known": F.col(f"`{col}`").isNotNull()}
    rows = checkpoint(df.withColumns({**given, col: F.array_distinct(F.array_compact(col))}))
    pairs = rows.select("_row", F.explode(col).alias("_term"))
    # the terms are counted where they are found, so the pairs need not be read again to see which are hot
    terms = pairs.groupBy(F.col("_term").alias("term")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_order", F.xxhash64("term"))
    counted = checkpoint(dense_index(checkpoint(terms), "_order", "code", tie="term").select("term", "code", "_rows"))
    codes = counted.select("term", "code")
    met = lookup_join(pairs, codes, "_term", "term", HEAVY_TERMS, counted.select(F.col("term").alias("_k"), F.col("_rows").alias("_w")))
    places = met.groupBy("_row").agg(F.sort_array(F.collect_list("code")).alias("_places"))
    own = rows.drop(col)
    none = F.array().cast("array<bigint>")
    filled = own.join(places, "_row", "left").withColumn(out, F.when(F.col("_known"), F.coalesce("_places", none)))
    return filled.drop("_row", "_known", "_places"), codes


def multi_hot(df: DataFrame, col: str, prefix: str, terms: Sequence[str]) -> DataFrame:
    """One 0/1 column per term, in one projection; the list column is dropped."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != col]
    flags = [F.coalesce(F.array_contains(col, t), F.lit(False)).cast("int").alias(prefix + t) for t in terms]
    return df.select(*keep, *flags)


def drop_leakage(df: DataFrame, cols: Sequence[str] = K.LEAKAGE) -> DataFrame:
    return df.drop(*cols)


def review_bin(col: str | Column, edges: Sequence[float] = K.REVIEW_BIN_EDGES) -> Column:
    return P.bucketize(col, edges, closed="right")


def bin_table(df: DataFrame, bin_col: str) -> DataFrame:
    """Count and percentage per bin."""
    counts = df.groupBy(bin_col).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("t")).select("t").scalar()
    return counts.select(bin_col, "count", F.round(F.col("count") / total * 100, 2).alias("percentage"))


def inference_set(df: DataFrame, target: str = "steam_total_reviews", leakage: Sequence[str] = K.LEAKAGE) -> DataFrame:
    """Features known before release plus the binned target, complete rows only."""
    return drop_leakage(df.withColumn(f"{target}_bin", review_bin(target)), leakage).dropna("any")


def baseline_row(
    df: DataFrame,
    modes: Sequence[str] = (),
    medians: Sequence[str] = (),
    rounded: Sequence[str] = (),
    overrides: Mapping[str, object] | None = None,
    missing: object = 0,
) -> DataFrame:
    """One typical record: modes (smallest on ties), medians, rounded medians, fixed overrides.

    Modes and medians each take one long-form pass over all their columns.
    """
    overrides = dict(overrides or {})
    parts: dict[str, Column] = {}
    row = df.sparkSession.range(1)
    if modes:
        types = dict(df.dtypes)
        counts = melt(df, modes, dtype="string").where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
        numeric = F.col("value").try_cast("double")
        # numbers compare as numbers, text as text
        top = counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("_c"), numeric, F.col("value"))).alias("mode"))
        row = with_scalars(row, top.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(c) for c in modes]), "_modes")
        parts.update({c: F.col("_modes").getField(c).cast(types[c]) for c in modes})
    if medians or rounded:
        row = with_scalars(row, _median_row(df, [*medians, *rounded]), "_medians")
        parts.update({c: F.col("_medians").getField(c) for c in medians})
        parts.update({c: F.bround(F.col("_medians").getField(c)).cast("bigint") for c in rounded})
    parts.update({c: F.lit(v) for c, v in overrides.items()})
    out = [parts.get(c, F.lit(missing)).alias(c) for c in df.columns]
    return row.select(out)


def profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Data dictionary: distinct count, mode, mean, median, min and max per numeric column."""
    long = melt(df, cols).where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("_c"))
    facts = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct_count"),
        F.min_by("value", F.struct(-F.col("_c"), F.col("value"))).alias("mode"),
        (F.sum(F.col("value") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    medians = exact_quantiles(long, "value", {"median": 0.5}, ["column"], max_groups=len(cols), accuracy=WIDE_ACCURACY)
    return facts.join(F.broadcast(medians), "column").select("column", "distinct_count", "mode", "mean", "median", "min", "max")


def flag_terms(df: DataFrame, cols: Mapping[str, str] = LIST_PREFIXES) -> dict[str, list[str]]:
    """The sorted terms of each list column: what becomes flag columns, so its number is that of columns."""
    have = [c for c in cols if c in df.columns]
    # a list is laid out whole and then by its terms: no struct is made per term
    lists = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("terms")) for c in have])
    rows = df.select(F.inline(lists)).select("column", F.explode("terms").alias("term")).where("term is not null").distinct().collect()
    return {c: sorted(r["term"] for r in rows if r["column"] == c) for c in have}


def flag_columns(df: DataFrame, terms: Mapping[str, Sequence[str]], prefixes: Mapping[str, str] = LIST_PREFIXES) -> DataFrame:
    """One 0/1 column per term of each list, in one projection; the lists are dropped."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in terms]
    flags = [
        F.coalesce(F.array_contains(c, t), F.lit(False)).cast("int").alias(prefixes[c] + t) for c, own in terms.items() for t in own
    ]
    return df.select(*keep, *flags)


def feature_layers(df: DataFrame, key: str = "appid", flags: bool = True) -> tuple[DataFrame, DataFrame]:
    """Preprocessed records -> (null-tolerant layer, null-free layer), lists as counts and, with ``flags``, as flag columns."""
    df = df.withColumns({"release_month": F.month("release_date"), "release_day_of_month": F.dayofmonth("release_date")})
    df = df.drop("release_date")
    lists = [c for c in LIST_PREFIXES if c in df.columns]
    allow = df.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists},
            "developers": P.first_of_list("developers"),
            "publishers": P.first_of_list("publishers"),
            "controller_support": controller_code("controller_support"),
            "gamefaqs_difficulty_rating": difficulty_code("gamefaqs_difficulty_rating"),
        }
    )
    allow = label_encode(allow, LABEL_COLUMNS, key)
    # label codes are never null, so only the other columns need a policy
    policy = {c: (KEEP if c in LABEL_COLUMNS else NO_NULL_POLICY.get(c)) for c in allow.columns}
    missing = [c for c, rule in policy.items() if rule is None]
    if missing:
        raise ValueError(f"no fill policy for {missing}")
    no_na = drop_any_null(list_counts(fill_policy(allow, policy), lists))
    allow = list_counts(allow, lists)
    if not flags or not lists:
        return allow, no_na
    terms = flag_terms(df)
    return flag_columns(allow, terms), flag_columns(no_na, terms)
