"""The corpus pipeline: quality classifier, line dedup, near-dedup, decontamination, BPE encoding.

Each stage is a function of (spark, docs, sf_dir). ``run`` applies them to ``documents``; every stage is written as Parquet to the
shared folder and read again, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm import bpe_automaton, decontaminate, line_dedup, quality, simhash
from marquetry.llm.common import fresh
from marquetry.llm.queries import table, word_spec
from marquetry.sources.writers import checkpoint


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by documents stay in the first one; ``n_chars`` follows the text. Documents stay, also empty ones."""
    lines, dropped = fresh(docs, "_n_lines"), fresh(docs, "_n_dropped")
    out = line_dedup.dedup_lines(docs, n_lines=lines, n_dropped=dropped)
    changed = F.col(dropped) > 0
    own = docs.columns
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in own])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit one word in twenty or more go."""
    mark = "_found_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    found = decontaminate.find_overlap(docs, table(spark, sf_dir, "benchmark"), spans=False, prefix=mark)
    clean = found.where(~decontaminate.contaminated(f"{mark}n_hit", f"{mark}n_words"))
    return clean.select(*[f"`{c}`" for c in docs.columns])


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents with their number of tokens and the digests of ids and decoded text."""
    digests = bpe_automaton.encode_digests(docs.select("doc_id", "text"), word_spec())
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_shared_lines),
    ("simhash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("bpe encoding", encoded),
]
ORACLE_SQL = None  # a trained classifier, SimHash and BPE are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
