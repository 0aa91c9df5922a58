from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colophon.operators.components import components
from colophon.operators.skew import hot_keys, rank_within, skew_join


def test_skew_join_equals_plain_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("h", "H"), ("a", "A"), ("z", "Z"), (None, "N")], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        got = sorted(map(str, skew_join(left, right, ["k"], how, hot_rows=10, salts=5).select(left.join(right, ["k"], how).columns).collect()))
        assert got == want, how


def test_hot_keys_are_bounded(spark):
    rows = spark.createDataFrame([(k,) for k in "aaabbbccc"] + [(None,)] * 9, "k string")
    assert [r.k for r in hot_keys(rows, ["k"], 3, max_hot=2).collect()] == ["a", "b"]


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_rank_within(spark, ascending, hot_rows):
    data = [("x", float(i % 7)) for i in range(40)] + [("y", 1.0), ("y", 2.0), ("y", None), (None, 3.0)]
    rows = spark.createDataFrame(data, "g string, s double")
    got = defaultdict(list)
    for r in rank_within(rows, ["g"], "s", "r", ascending, hot_rows=hot_rows, splits=4).collect():
        got[r.g].append((r.s, r.r))
    for g, pairs in got.items():
        scores = [s for s, _ in pairs if s is not None]
        for s, r in pairs:
            assert r == (None if s is None else 1 + sum((x < s) if ascending else (x > s) for x in scores)), (g, s)
    assert sum(map(len, got.values())) == len(data)


def test_components(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(100, 130)] + [("x", "y"), ("z", "z")], "a string, b string")
    roots = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert {roots[str(i)] for i in range(100, 131)} == {"100"}
    assert roots["x"] == roots["y"] == "x" and "z" not in roots
    assert components(edges.where(F.lit(False)), "a", "b").count() == 0
