"""Derived business metrics as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquetry import constants as K


def total_and_ratio(pos: str, neg: str) -> tuple[Column, Column]:
    total = F.col(pos) + F.col(neg)
    return total, F.try_divide(F.col(pos).cast("double"), total)


def is_released(col: str) -> Column:
    return F.coalesce(~F.lower(F.col(col)).isin(*K.UNRELEASED), F.lit(False))


def estimate_owners(
    reviews: Column,
    year: Column,
    price: Column,
    open_start: bool = False,
    min_reviews: int = 1,
) -> Column:
    """Owners from review counts. ``open_start`` applies the first year's factor to earlier years too."""
    large = F.when(reviews > K.LARGE_REVIEWS, K.LARGE_REVIEWS_FACTOR).otherwise(1.0)
    first = min(K.REVIEW_INFLATION)
    inflation = F.when(year > 2020, K.REVIEW_INFLATION_AFTER_2020 / 80)
    for y, share in K.REVIEW_INFLATION.items():
        inflation = inflation.when((year <= y) if open_start and y == first else (year == y), share / 80)
    a, b, c = K.COMMITMENT
    commitment = F.lit(a) + F.lit(b) * F.exp(F.lit(-c) * price)
    owners = F.bround(reviews * K.OWNERS_PER_REVIEW * large * inflation.otherwise(1.0) * commitment).cast("bigint")
    return F.when(reviews >= min_reviews, owners)


def years_since(col: str, as_of: date | Column) -> Column:
    return F.datediff(F.lit(as_of), F.col(col)) / F.lit(365.25)


def dislike_squared(neg: Column, total: Column) -> Column:
    return F.pow(F.try_divide(neg.cast("double"), total), 2)


def discount_factor(dislike: Column, age: Column) -> Column:
    a, b = K.DISCOUNT
    c, d = K.DISCOUNT_WITHOUT_AGE
    return F.coalesce(F.lit(a) * F.exp(-dislike * age) + F.lit(b), F.lit(c) - F.lit(d) * dislike)


def decayed_score(tags: Column, values: Mapping[str, float] = K.TAG_VALUES, decay: float = K.TAG_DECAY) -> Column:
    """1 + sum of values, largest magnitude first, each further one worth ``decay`` of the last; per sign."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    worth = F.filter(F.transform(tags, lambda t: F.try_element_at(table, t)), lambda v: v.isNotNull())

    def side(keep) -> Column:
        ordered = F.sort_array(F.transform(F.filter(worth, keep), F.abs), asc=False)
        weighted = F.transform(ordered, lambda v, i: v * F.pow(F.lit(decay), i))
        return F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v)

    return F.lit(1.0) + side(lambda v: v > 0) - side(lambda v: v < 0)


def revenue_per_user(model: Column, price: Column, discount: Column, age: Column, tag_score: Column) -> Column:
    a, b, c, d = K.FREE_TO_PLAY_CURVE
    curve = F.lit(a) + F.lit(b - a) / (F.lit(1.0) + F.pow(age / F.lit(c), d))
    return (
        F.when(model == "paid", F.bround(price * discount))
        .when(model == "f2p", curve * tag_score)
        .when(model == "free", 0.0)
    )


def monetization_model(f2p: Column, free: Column, *prices: Column) -> Column:
    paid = F.lit(False)
    for p in prices:
        paid = paid | F.coalesce(p > 0, F.lit(False))
    return F.when(f2p, "f2p").when(free, "free").when(paid, "paid")


def price_bracket(price: Column, brackets: Sequence = K.PRICE_BRACKETS) -> Column:
    """Ordered bracket label: first = exactly 0, then upper bounds, last = open; null -> "Unknown"."""
    out = F.when(price.isNull(), "Unknown").when(price == 0, brackets[0][0])
    for label, upper in brackets[1:-1]:
        out = out.when(price < upper, label)
    return out.otherwise(brackets[-1][0])


def z_two_sided(confidence: float) -> float:
    return NormalDist().inv_cdf((1 + confidence) / 2)


def binom_ci(successes: Column, totals: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Normal-approximation interval of a proportion, clipped to [0, 1]; no trials -> 0, 0."""
    p = F.coalesce(F.try_divide(successes.cast("double"), totals), F.lit(0.0))
    se = F.coalesce(F.sqrt(F.try_divide(p * (1 - p), totals)), F.lit(0.0))
    margin = F.lit(z_two_sided(confidence)) * se
    return (
        F.least(F.greatest(p - margin, F.lit(0.0)), F.lit(1.0)),
        F.least(F.greatest(p + margin, F.lit(0.0)), F.lit(1.0)),
    )


def median_ci(median: Column, sd: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    margin = F.lit(z_two_sided(confidence) * 1.2533) * sd / F.sqrt(n)
    return median - margin, median + margin


def level(value: Column, steps: Sequence[tuple[float, str]], below: str, ascending: bool = False) -> Column:
    """Verdict word: first step reached (``>=``), or undercut (``<``) when ``ascending``."""
    out = None
    for limit, word in steps:
        hit = value < limit if ascending else value >= limit
        out = F.when(hit, word) if out is None else out.when(hit, word)
    return out.otherwise(below)
