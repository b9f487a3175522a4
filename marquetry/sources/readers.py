"""CSV, JSON and Parquet scans, and the named layers of a catalog directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.sources import documents

# layer name -> (directory, must be free of nulls)
LAYERS = {
    "merged": ("merged", False),
    "preprocessed": ("preprocessed", False),
    "preprocessed_dense": ("preprocessed_dense", False),
    "features_with_na": ("processed_allow_na", False),
    "features_no_na": ("processed_no_na", True),
    "inference": ("inference_dataset", True),
    "baseline": ("baseline_element", True),
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multiline: bool = False) -> DataFrame:
    """CSV with header; files split into tasks. Quoted line breaks need ``multiline``, which makes a file one task."""
    return spark.read.csv(path, header=True, schema=schema, multiLine=multiline, quote='"', escape='"')


def read_json_list(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, split: bool = False
) -> DataFrame:
    """JSON whose root is a list of objects; ``path`` may name many files.

    A file is one task, which suits many small ones. With ``split`` a file is read by as many tasks as it has splits
    (see ``sources.documents``); an element that is no object is then an error.
    """
    if not split:
        return spark.read.json(path, schema=schema, multiLine=True)
    texts = documents.records(spark, path)
    stray = F.raise_error(F.concat(F.lit("no object, or cut short: "), F.substring("text", 1, 200))).cast("boolean")
    texts = texts.where(F.when(F.col("closed"), F.lit(True)).when(F.rlike("text", F.lit(r"^[\s\[\],]*$")), F.lit(False)).otherwise(stray))
    texts = texts.select(F.regexp_replace("text", r"^\s*[,\[]\s*", "").alias("text"))
    if schema is None:
        schema = spark.read.json(texts.rdd.map(lambda r: r[0])).schema
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    return texts.select(F.from_json("text", schema).alias("_o")).select("_o.*")


def read_json_dict(
    spark: SparkSession, path: str, value_schema: T.StructType, key_col: str = "appid", split: bool = False
) -> DataFrame:
    """JSON whose root is ``{id: object}``; ``path`` may name many files.

    A file is one cell of one task unless ``split`` is set (see ``sources.documents``). Write the result to Parquet once
    (``writers.checkpoint``) before analysing it.
    """
    if split:
        texts = documents.records(spark, path)
        # members that are no objects follow the last one up to the brace of the root
        texts = texts.withColumn("text", F.when(F.col("closed"), F.col("text")).otherwise(F.regexp_replace("text", r"\}\s*$", "")))
        members = F.regexp_replace("text", r"^\s*[,{]\s*", "")
        text = texts.select(F.concat(F.lit("{"), members, F.lit("}")).alias("value"))
    else:
        text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return text.select(F.explode(parsed).alias(key_col, "_o")).select(key_col, "_o.*")


def load(spark: SparkSession, root: str, name: str, check: bool = True) -> DataFrame:
    """Named layer below ``root``. Layers documented as null-free are verified on load."""
    if name not in LAYERS:
        raise KeyError(f"unknown layer {name!r}; known: {sorted(LAYERS)}")
    directory, no_nulls = LAYERS[name]
    df = spark.read.parquet(f"{root}/{directory}")
    return assert_no_nulls(df) if check and no_nulls else df


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of nulls per column, from a single scan."""
    return df.select([F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def assert_no_nulls(df: DataFrame) -> DataFrame:
    """Raise when any column holds a null, else hand ``df`` back."""
    counts = null_counts(df).first().asDict()
    bad = {c: n for c, n in counts.items() if n}
    if bad:
        raise ValueError(f"nulls found: {bad}")
    return df
