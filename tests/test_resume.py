"""Resumable builds: what runs again, and what a broken build leaves."""

import os

import pytest
from pyspark.sql import functions as F

from marquetry.sources import resume


def jobs_of(spark, name, fn):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def chain(a, b, version=""):
    def left(s, _):
        return s.read.parquet(a).select("id", (F.col("id") * 2).alias("x"))

    def right(s, _):
        return s.read.parquet(b).select("id", F.lit("b").alias("y"))

    def both(s, layers):
        return layers["left"].join(layers["right"], "id")

    return [resume.Step("left", left, [a]), resume.Step("right", right, [b]), resume.Step("both", both, after=["left", "right"], version=version)]


def test_only_what_changed_is_built_again(spark, tmp_path):
    a, b, root = (str(tmp_path / n) for n in "abr")
    spark.range(10).write.parquet(a)
    spark.range(5).write.parquet(b)
    first = resume.build(spark, root, chain(a, b))
    assert first.made == ["left", "right", "both"] and first.manifests["both"]["rows"] == 5
    again, jobs = jobs_of(spark, "unchanged", lambda: resume.build(spark, root, chain(a, b)))
    assert again.made == [] and jobs == 0
    assert sorted(map(tuple, again.layers["both"].collect())) == [(i, 2 * i, "b") for i in range(5)]
    spark.range(7).write.mode("overwrite").parquet(b)
    changed = resume.build(spark, root, chain(a, b))
    assert changed.made == ["right", "both"] and changed.layers["both"].count() == 7
    assert resume.build(spark, root, chain(a, b, "2")).made == ["both"]
    assert [len(os.listdir(f"{root}/{n}")) for n in ("left", "right", "both")] == [1, 1, 1]


def test_a_build_that_breaks_leaves_nothing_that_looks_finished(spark, tmp_path):
    root = str(tmp_path / "r")
    spark.range(3).write.parquet(str(tmp_path / "a"))
    state = {"fails": True}

    def make(s, _):
        df = s.read.parquet(str(tmp_path / "a"))
        return df.where(F.raise_error(F.lit("broken")).cast("boolean")) if state["fails"] else df

    steps = [resume.Step("only", make, [str(tmp_path / "a")])]
    with pytest.raises(Exception, match="broken"):
        resume.build(spark, root, steps)
    state["fails"] = False
    assert resume.build(spark, root, steps).made == ["only"]
    with pytest.raises(ValueError, match="comes before"):
        resume.build(spark, root, [resume.Step("late", make, after=["nowhere"])])
    with pytest.raises(FileNotFoundError):
        resume.build(spark, root, [resume.Step("lost", make, [str(tmp_path / "gone")])])
