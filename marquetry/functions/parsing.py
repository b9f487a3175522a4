"""Reshaping and type coercion of single columns (malformed input becomes null or a default)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquetry.constants import DATE_FORMATS, DATE_SENTINELS, LANGUAGES

ColumnLike = str | Column


def _c(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _empty() -> Column:
    return F.array().cast("array<string>")


# -- source reshaping ---------------------------------------------------------------


def split_list(col: ColumnLike, sep: str = ",") -> Column:
    """Split on ``sep`` without trimming; null gives an empty list."""
    return F.coalesce(F.split(_c(col), re.escape(sep)), _empty())


def count_items(col: ColumnLike, sep: str = ",") -> Column:
    """Number of separated items, null -> 0 (an empty string is one item)."""
    return F.coalesce(F.size(F.split(_c(col), re.escape(sep))), F.lit(0))


def range_midpoint(col: ColumnLike, sep: str = " - ") -> Column:
    """``"100 - 200"`` -> 150.0; a part that is no integer makes the whole value 0."""
    parts = F.transform(F.split(_c(col), re.escape(sep)), lambda p: F.trim(p).try_cast("bigint"))
    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p)
    return F.coalesce(total.cast("double") / F.size(parts), F.lit(0.0))


def normalize_range(col: ColumnLike) -> Column:
    """``10,000 .. 20,000`` -> ``10000 - 20000``."""
    return F.replace(F.replace(_c(col), F.lit(","), F.lit("")), F.lit(" .. "), F.lit(" - "))


def flags_from(col: ColumnLike, tokens: Mapping[str, str], is_array: bool = False) -> list[Column]:
    """One boolean column per ``{flag: token}``; membership in a list or in a text."""
    test = F.array_contains if is_array else F.contains
    return [test(_c(col), F.lit(token)).alias(flag) for flag, token in tokens.items()]


def cents_to_units(col: ColumnLike) -> Column:
    return _c(col).try_cast("double") / 100.0


def null_if_out_of_range(col: ColumnLike, hi: float = 150.0) -> Column:
    """Numbers below ``hi``; anything else, text included, becomes null."""
    x = to_double(col)
    return F.when(x < hi, x)


def null_if_sentinel(col: ColumnLike, sentinels: Sequence[str] = ("FALSE",)) -> Column:
    c = _c(col).cast("string")
    return F.when(~F.upper(c).isin(*[s.upper() for s in sentinels]), c.try_cast("double"))


def map_key_list(col: ColumnLike, from_text: bool = True) -> Column:
    """Keys of ``{'name': weight}``, given as text or as a map column."""
    m = F.from_json(_c(col), "map<string,bigint>") if from_text else _c(col)
    return F.coalesce(F.map_keys(m), _empty())


# -- type coercion ------------------------------------------------------------------


def to_double(col: ColumnLike) -> Column:
    x = _c(col).try_cast("double")
    return F.when(~F.isnan(x), x)


def to_long(col: ColumnLike) -> Column:
    """Fractions are truncated towards zero. Whole-number text keeps all its digits."""
    c = _c(col)
    return F.coalesce(c.try_cast("string").try_cast("bigint"), to_double(c).try_cast("bigint"))


def to_bool(col: ColumnLike) -> Column:
    text = F.lower(_c(col).cast("string"))
    return F.when(text == "true", True).when(text == "false", False)


def to_text(col: ColumnLike) -> Column:
    return _c(col).cast("string")


def parse_date(
    col: ColumnLike,
    formats: Sequence[str] = DATE_FORMATS,
    sentinels: Sequence[str] = DATE_SENTINELS,
    on_error: str = "raise",
) -> Column:
    """First format that fits; sentinels -> null; other text raises or (``on_error="null"``) -> null."""
    text = _c(col).cast("string")
    blank = text.isNull() | F.lower(text).isin(*sentinels)
    parsed = F.coalesce(*[F.try_to_date(text, f) for f in formats])
    if on_error == "raise":
        failed = F.raise_error(F.concat(F.lit("invalid date: "), text)).cast("date")
        parsed = F.when(parsed.isNotNull(), parsed).otherwise(failed)
    return F.when(~blank, parsed)


def to_date(col: ColumnLike) -> Column:
    return _c(col).try_cast("date")


# -- lists of strings ---------------------------------------------------------------


# --- fixed value: a quoted string inside a list literal ---
_QUOTED = r"""\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"""  # possessive: no state per character


def _list_literal(col: ColumnLike) -> Column:
    """A list written as text, double- or single-quoted, with ``\\xNN`` escapes."""
    c = _c(col)
    text = F.when(F.contains(c, F.lit(r"\x")), F.regexp_replace(c, r"\\x([0-9A-Fa-f]{2})", r"\\u00$1")).otherwise(c)
    return F.from_json(text, "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})


def parse_list_or_empty(col: ColumnLike) -> Column:
    return F.coalesce(_list_literal(col), _empty())


def is_no_list(col: ColumnLike) -> Column:
    """Text that is neither blank nor a list literal."""
    return (F.trim(_c(col)) != "") & _list_literal(col).isNull()


def parse_list_or_single(col: ColumnLike) -> Column:
    """A list literal as a list; other text as a list of that one text; null and blank text as an empty list."""
    return F.when(F.coalesce(is_no_list(col), F.lit(False)), F.array(_c(col))).otherwise(parse_list_or_empty(col))


def read_list(col: ColumnLike, is_text: bool = True) -> Column:
    """List literal -> list; null or "" -> empty; anything else, unquoted elements included, raises."""
    c = _c(col)
    if not is_text:
        return F.coalesce(c, _empty())
    parsed = _list_literal(c)
    only_strings = F.regexp_replace(c, _QUOTED, "").rlike(r"^\s*\[[\s,]*\]\s*$")
    bad = F.raise_error(F.concat(F.lit("invalid list: "), c)).cast("array<string>")
    return F.when(c.isNull() | (c == ""), _empty()).when(parsed.isNotNull() & only_strings, parsed).otherwise(bad)


def normalize_list(
    col: ColumnLike, is_text: bool = True, lower: bool = True, distinct: bool = True, sort: bool = True
) -> Column:
    values = read_list(col, is_text)
    if lower:
        values = F.transform(values, F.lower)
    if distinct:
        values = F.array_distinct(values)
    return F.array_sort(values) if sort else values


def normalize_vocab(col: ColumnLike, vocab: Sequence[str] = LANGUAGES, is_text: bool = False) -> Column:
    """Keep allowed terms; map other elements to the first (alphabetical) allowed term they contain."""
    allowed = sorted(set(vocab))
    terms = F.array(*[F.lit(v) for v in allowed])

    def clean(low: Column) -> Column:
        found = F.get(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0))
        return F.when(low.isin(allowed), low).otherwise(found)

    # lower-cased before: in one function with the search it would be done again for every term
    cleaned = F.transform(F.transform(read_list(col, is_text), F.lower), clean)
    return F.array_sort(F.array_distinct(F.filter(cleaned, lambda x: x.isNotNull())))


def replace_in_list(col: ColumnLike, pairs: Mapping[str, str]) -> Column:
    """Replace substrings inside every element, pair after pair; null -> empty list."""

    def fix(element: Column) -> Column:
        for before, after in pairs.items():
            element = F.replace(element, F.lit(before), F.lit(after))
        return element

    return F.transform(F.coalesce(_c(col), _empty()), fix)


def first_of_list(col: ColumnLike, default: str = "none") -> Column:
    return F.when(F.size(_c(col)) > 0, F.get(_c(col), F.lit(0))).otherwise(F.lit(default))


# -- numbers and categories ---------------------------------------------------------


def row_mean(*cols: ColumnLike) -> Column:
    """Mean over columns, skipping nulls; null when all are null."""
    values = [to_double(c) for c in cols]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values[1:]), F.coalesce(values[0], F.lit(0.0)))
    present = sum((v.isNotNull().cast("int") for v in values[1:]), values[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def scale(col: ColumnLike, divisor: float) -> Column:
    return _c(col).cast("double") / F.lit(float(divisor))


def recode(col: ColumnLike, mapping: Mapping, default=None, lower: bool = False) -> Column:
    """Constant-map lookup; values outside the map, null included, become ``default``."""
    key = F.lower(_c(col)) if lower else _c(col)
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def row_max(*cols: ColumnLike) -> Column:
    return F.greatest(*[to_double(c) for c in cols])


def first_non_null(*cols: ColumnLike) -> Column:
    return F.coalesce(*[_c(c) for c in cols])


def cross_fill(a: str, b: str) -> list[Column]:
    return [F.coalesce(F.col(a), F.col(b)).alias(a), F.coalesce(F.col(b), F.col(a)).alias(b)]


def bucketize(col: ColumnLike, edges: Sequence[float], closed: str = "right", last_closed: bool = False) -> Column:
    """Bin number 0..len(edges)-2 for interior and outer ``edges``; null outside."""
    x = _c(col)
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        lo, hi = float(edges[i]), float(edges[i + 1])
        if closed == "right":
            inside = (x > F.lit(lo)) & (x <= F.lit(hi))
        elif last_closed and i == len(edges) - 2:
            inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        else:
            inside = (x >= F.lit(lo)) & (x < F.lit(hi))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def step_round(col: ColumnLike, steps: Sequence[tuple[float, float]]) -> Column:
    """Round to a step that grows with the magnitude; ``steps`` = (below, step), last one open-ended."""
    x = _c(col)
    rounded = [(limit, F.bround(x / F.lit(float(step))) * F.lit(float(step))) for limit, step in steps]
    out = rounded[-1][1]
    for limit, value in reversed(rounded[:-1]):
        out = F.when(x < F.lit(float(limit)), value).otherwise(out)
    return out.cast("bigint")
