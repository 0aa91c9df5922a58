import os

from colophon.session import stored


def test_stored_steps(spark):
    rows = spark.range(100).selectExpr("id", "id % 7 AS k", "id > 90 AS late")
    step = stored(rows, "id", "k", n="count(1)", late="max(late)", most="max(k)")
    assert step.observed == {"n": 100, "late": True, "most": 6} and step.frame.columns == ["id", "k"]
    assert sorted(map(tuple, step.frame.collect())) == [(i, i % 7) for i in range(100)]
    folder = step.path.removeprefix("file:")
    assert os.path.isdir(folder)
    step.discard()
    assert not os.path.exists(folder)


def test_stored_nothing(spark):
    step = stored(spark.range(9).where("id > 9").distinct(), n="count(1)", most="max(id)")
    assert step.observed == {"n": 0, "most": None} and step.frame.count() == 0
    assert stored(spark.range(3)).observed == {}
