"""Sinks and materialised intermediate layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _csv_ready(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        [
            F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


PACKED_ROWS = 250_000  # rows of a compressed file, which one task reads whole


def write(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] | None = None, packed: bool = False
) -> None:
    """Write Parquet, or CSV with nested values as JSON text; ``packed`` CSV is compressed, in files of at most ``PACKED_ROWS`` rows."""
    writer = (_csv_ready(df) if fmt == "csv" else df).write.mode(mode)
    if packed and fmt == "csv":
        writer = writer.option("compression", "gzip").option("maxRecordsPerFile", PACKED_ROWS)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(path, header=True, quote='"', escape='"')
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported format {fmt!r}")


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate layers: what the session names in ``spark.checkpoint.dir``.

    A cluster must name one that driver and executors share; only a local session without the setting takes a folder beside
    its warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_layers"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def checkpoint(df: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Materialise ``df`` as Parquet and continue from there.

    Cuts the lineage, survives the loss of executors, and later scans prune columns and push filters
    down. Without a path the snapshot goes to a fresh name in ``folder``, or in the shared folder, and is deleted when the
    application ends; a snapshot at a given path stays.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{(folder or shared_folder(spark)).rstrip('/')}/layer-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path)
