"""Extra columns whose names clash with helper columns or, but for case, with outputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from marquetry.llm import decontaminate, line_dedup, quality, simhash, substring_dedup, url_filters

CLASHES = ("_gone", "_doc", "_fp", "N_LINES", "N_Dropped", "N_WORDS", "N_REMOVED", "N_TOKENS", "SCORE", "Items", "_best")


@pytest.fixture(scope="module")
def clashing(edge):
    return edge.select("doc_id", "text", *[F.lit(c).alias(c) for c in CLASHES])


def passes(out, replaced=()):
    """The other columns come through with their values, and no two names differ in case only."""
    lower = [c.lower() for c in out.columns]
    assert len(set(lower)) == len(lower)
    kept = [c for c in CLASHES if c.lower() not in replaced]
    rows = out.select(*[f"`{c}`" for c in out.columns]).collect()
    assert rows and all(r[c] == c for r in rows for c in kept)
    return rows


def test_documents(spark, clashing):
    benchmark = spark.createDataFrame([("i", "common1 common2 common3")], "item_id string, text string")
    assert len(passes(line_dedup.dedup_lines(clashing), {"n_lines", "n_dropped"})) == clashing.count()
    assert len(passes(substring_dedup.dedup_substrings(clashing), {"n_words", "n_removed"})) == clashing.count()
    assert all(isinstance(r["score"], float) for r in passes(quality.classify(clashing), {"score"}))
    passes(simhash.drop_near_duplicates(clashing))
    passes(decontaminate.find_overlap(clashing, benchmark, spans=False), {"n_words", "n_hit", "items"})


def test_captures(spark):
    day = datetime.date(2024, 5, 1)
    rows = [("http://a.com/x", day, "u", "d", "b", "A", "R"), (None, None, "u", "d", "b", "A", "R"), ("http://c.com/", day, "u", "d", "b", "A", "R")]
    captures = spark.createDataFrame(rows, "url string, fetched date, _url string, _day string, _best string, ACTION string, Rule string")
    entries = spark.createDataFrame([("domain", "a.com", "block", day)], "kind string, name string, action string, since date")
    out = url_filters.judge(captures, entries)
    assert out.columns == ["url", "fetched", "_url", "_day", "_best", "action", "rule_kind", "rule"]
    got = {r["url"]: (r["action"], r["rule"], r["_url"], r["_best"]) for r in out.collect()}
    assert got == {"http://a.com/x": ("block", "a.com", "u", "b"), None: ("allow", None, "u", "b"), "http://c.com/": ("allow", None, "u", "b")}
    clean = captures.drop("ACTION", "Rule")
    assert sorted(str(r["url"]) for r in url_filters.drop_blocked(clean, entries).collect()) == ["None", "http://c.com/"]
