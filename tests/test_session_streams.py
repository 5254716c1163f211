"""Shared scratch folders and streams."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from evenkeel import session
from evenkeel.plans.reports import conditional_density
from evenkeel.sources.samples import attach_features
from evenkeel.streaming import scores


def test_an_unset_folder_is_on_the_default_file_system(spark, monkeypatch):
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: default)
    monkeypatch.setattr(session, "_made", {})
    made = session.shared_dir(spark)
    assert made.startswith("file:/tmp/evenkeel-") and os.path.isdir(made.removeprefix("file:"))
    assert session.shared_dir(spark) == made
    monkeypatch.setattr(session, "_made", {})
    monkeypatch.setattr(spark.sparkContext, "master", "spark://far:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(spark)


def test_a_folder_is_watched_without_its_neighbours(spark, tmp_path):
    make = lambda n: spark.range(n).select("id", (F.col("id") % 2).alias("y"), F.lit(0.7).alias("p"))
    make(10).write.parquet(str(tmp_path / "ev"))
    make(100).write.parquet(str(tmp_path / "ev_old"))
    stream = scores.read_stream(spark, str(tmp_path / "ev"))
    assert scores.drain_rows(stream, "rows").count() == 10
    one = next(str(p) for p in (tmp_path / "ev").iterdir() if p.name.endswith(".parquet"))
    want = spark.read.parquet(one).count()
    assert scores.drain_rows(scores.read_stream(spark, one), "one").count() == want
    got = scores.drain_groups(scores.stream_scores(stream, "y", "p", [], ["accuracy"]), "groups")
    assert got.first()["accuracy"] == 0.5


def test_arrays_wider_than_asked_are_errors(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    assert rows(attach_features(df, vec, "id", "v", 3)) == [(1, 1.0, 2.0, None), (2, None, None, None)]
    with pytest.raises(Exception, match="wider than 1"):
        attach_features(df, vec, "id", "v", 1).collect()


def test_groups_without_spread_have_null_densities(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), (None, 3.0), (None, 4.0)], "g string, v double")
    got = {g: None for g in ()}
    for r in conditional_density(df, "v", ["g"], 4).collect():
        got.setdefault(r.g, []).append(r.density)
    assert set(got) == {"a", "b", None} and got["b"] == [None] * 4 and min(got["a"] + got[None]) > 0
