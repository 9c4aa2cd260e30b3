"""Joins with hot keys, staged tables, row keys."""

import random

from textsieve.llm import stage


def test_join_counted(spark, monkeypatch):
    monkeypatch.setattr(stage, "LEAST_HOT", 20)
    rnd = random.Random(1)
    big = [(rnd.choice([1, 1, 1, 2, 3, 4, None]), i) for i in range(400)]
    small = [(k, sum(b[0] == k for b in big), f"v{k}") for k in (1, 2, 5)]
    b, s = spark.createDataFrame(big, "k long, i long"), spark.createDataFrame(small, "k long, n long, v string")
    value = dict((k, v) for k, _, v in small)
    for how in ("inner", "left"):
        got = sorted((r.i, r.v) for r in stage.join_counted(b, s, ["k"], "n", how).collect())
        want = sorted((i, value.get(k)) for k, i in big if how == "left" or k in value)
        assert got == want
    assert stage.join_counted(b, s.where("false"), ["k"], "n", "left").count() == 400


def test_staged_tables_are_in_the_shared_folder(spark):
    df = stage.staged(spark.range(5), "t")
    assert stage.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert all(stage.shared_dir(spark) in f for f in df.inputFiles()) and df.count() == 5


def test_join_on_key_takes_nulls(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "a")], "doc_id long, text string")
    keyed = stage.with_row_key(df)
    from pyspark.sql import functions as F

    out = stage.join_on_key(keyed, keyed.select(*stage.KEY, F.lit(1).alias("hit")))
    assert out.where("hit = 1").count() == 3


def test_drop_staged(spark):
    from pathlib import Path

    stage.staged(spark.range(3), "gone")
    stage.drop_staged(spark)
    assert not Path(stage.staged_dir(spark)).exists()


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://m:7077", applicationId="a"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_dir(session)
    session.sparkContext.master = "local[2]"
    assert stage.staged_dir(session) == f"{stage.LOCAL_DEFAULT}/textsieve/a"
