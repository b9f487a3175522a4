"""Registered queries of this package against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from marquetry.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert verdict.startswith(("ok", "rows only")) and "TYPES" not in verdict, verdict


def test_pipeline_stages_keep_columns(spark, edge, none):
    own = edge.select("doc_id", "text", "lang", "source", "n_words").withColumnRenamed("n_words", "n_chars")
    for docs in (own, own.limit(0), edge):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns[0] == "doc_id"


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200
