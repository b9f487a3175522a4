"""A build of layers that resumes: a step runs again only if its code or something it reads has changed.

Each layer is stored below ``root/name/<fingerprint>``. The fingerprint covers the step's code and version, the files of
its sources (path, size, time of change) and the fingerprints of the layers before it. A manifest is written after the
data and makes the layer valid; so a build that broke off leaves nothing that looks finished, and readers of the old layer
are undisturbed until the new one stands. Then the old one is deleted.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquetry.sources.writers import path_exists, write

MANIFEST = "_manifest.json"


@dataclass
class Step:
    """``make(spark, inputs)`` returns the layer; ``inputs`` holds the frames of the layers named in ``after``.

    ``sources`` are the paths that it reads itself. ``version`` is for changes that its own source text does not show.
    """

    name: str
    make: Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]
    sources: Sequence[str] = ()
    after: Sequence[str] = ()
    version: str = ""


@dataclass
class Built:
    """``layers`` by name, which of them were ``made`` anew, and their manifests."""

    layers: dict[str, DataFrame] = field(default_factory=dict)
    made: list[str] = field(default_factory=list)
    manifests: dict[str, dict] = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> list[list]:
    """Path, size and time of change of every data file below ``path``, in order. No Spark job."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    found, listed = [], fs.listFiles(at, True)
    while listed.hasNext():
        status = listed.next()
        if not status.getPath().getName().startswith(("_", ".")):
            found.append([status.getPath().toString(), status.getLen(), status.getModificationTime()])
    return sorted(found)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and renamed into it."""
    fs, at = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(aside, at):
        raise OSError(f"cannot write {path}")


def fingerprint(spark: SparkSession, step: Step, before: Mapping[str, dict]) -> tuple[str, dict]:
    says = {
        "name": step.name,
        "code": inspect.getsource(step.make),
        "version": step.version,
        "files": {path: files_of(spark, path) for path in step.sources},
        "after": {name: before[name]["fingerprint"] for name in step.after},
    }
    return hashlib.sha256(json.dumps(says, sort_keys=True).encode()).hexdigest()[:32], says


def build(spark: SparkSession, root: str, steps: Sequence[Step]) -> Built:
    """Every step's layer, stored; steps come after those they name. A step that is up to date runs no Spark job.

    The manifest of a layer holds its fingerprint and what went into it, its row count and its schema.
    """
    out = Built()
    for step in steps:
        if missing := [name for name in step.after if name not in out.layers]:
            raise ValueError(f"{step.name} comes before {missing}")
        mark, says = fingerprint(spark, step, out.manifests)
        home = f"{root.rstrip('/')}/{step.name}/{mark}"
        if path_exists(spark, f"{home}/{MANIFEST}"):
            manifest = json.loads(_read_text(spark, f"{home}/{MANIFEST}"))
        else:
            seen = Observation()
            made = step.make(spark, {name: out.layers[name] for name in step.after})
            write(made.observe(seen, F.count(F.lit(1)).alias("rows")), home)
            manifest = says | {"fingerprint": mark, "rows": seen.get["rows"], "schema": json.loads(made.schema.json())}
            _put_text(spark, f"{home}/{MANIFEST}", json.dumps(manifest))
            out.made.append(step.name)
        out.manifests[step.name] = manifest
        out.layers[step.name] = spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(home)
    for name, manifest in out.manifests.items():
        fs, at = _fs(spark, f"{root.rstrip('/')}/{name}")
        for status in fs.listStatus(at):
            if status.getPath().getName() != manifest["fingerprint"]:
                fs.delete(status.getPath(), True)
    return out
