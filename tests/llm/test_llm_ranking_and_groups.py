import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from colophon.llm import distinctiveness, match_groups, rank_fusion

SCORES = {"a": False, "b": True, "c": True}
HITS = "q long, item string, a double, b double, c double, rank int, rho string"


def _brute(rows):
    best = {}
    for q, item, *scores, _, _ in rows:
        if q is None or item is None:
            continue
        slot = best.setdefault((q, item), [None] * 3)
        for i, (s, up) in enumerate(zip(scores, SCORES.values())):
            if s is not None and not math.isnan(s):
                slot[i] = s if slot[i] is None else (max if up else min)(slot[i], s)
    per = defaultdict(dict)
    for (q, item), scores in best.items():
        per[q][item] = scores
    out = {}
    for q, items in per.items():
        for item, scores in items.items():
            shares = []
            for i, up in enumerate(SCORES.values()):
                if scores[i] is None:
                    shares.append(1.0)
                else:
                    better = sum(1 for o in items.values() if o[i] is not None and (o[i] > scores[i] if up else o[i] < scores[i]))
                    shares.append((better + 1) / len(items))
            x = sorted(shares)
            tail = lambda k, p: sum(math.comb(3, j) * p**j * (1 - p) ** (3 - j) for j in range(k, 4))
            out[q, item] = min(1.0, 3 * min(tail(k, x[k - 1]) for k in (1, 2, 3)))
    return out


@pytest.mark.parametrize("hot_rows", [4, 10**6])
def test_rank_aggregation_against_brute_force(spark, hot_rows):
    dice = random.Random(3)
    rows = [(i % 2, f"i{i % 17}", dice.choice([None, float("nan"), dice.uniform(-9, 0), -1.0]), dice.choice([None, dice.random() * 100]), dice.random() ** 9 * 1e6, 1, "x") for i in range(60)]
    rows += [(None, "x", 1.0, 1.0, 1.0, 1, ""), (1, None, 1.0, 1.0, 1.0, 1, ""), rows[0]]
    frame = spark.createDataFrame(rows, HITS)
    got = {(r.q, r.item): r.rho for r in rank_fusion.aggregate_ranks(frame, "q", "item", SCORES, hot_rows=hot_rows).collect()}
    assert got == pytest.approx(_brute(rows))


def test_one_wide_score_does_not_win(spark):
    rows = [(1, "wide", -0.1, 0.1, 1e9, 1, "")] + [(1, f"good{i}", -9.0 - i, 0.9 + i / 100, 1.0 + i, 1, "") for i in range(3)] + [(1, f"poor{i}", -1.0 - i / 10, 0.2 + i / 100, 0.1, 1, "") for i in range(12)]
    top = rank_fusion.leading_items(spark.createDataFrame(rows, HITS), "q", "item", SCORES)
    assert {r.item for r in top.collect()} == {"good0", "good1", "good2"}
    assert rank_fusion.leading_items(spark.createDataFrame([], HITS), "q", "item", SCORES).count() == 0
    ties = spark.createDataFrame([(1, x, 1.0, 1.0, 1.0, 1, "") for x in "dcba"], HITS)
    assert [r.item for r in rank_fusion.leading_items(ties, "q", "item", SCORES).orderBy("place").collect()] == ["a", "b", "c"]


TOPICS = "issue_id string, keyword string, score double, weight double, term string"


def test_distinctiveness(spark):
    rows = [(str(i), "common", 0.02, 9.0, "") for i in range(30)] + [("1", "Rare_-Term", 0.03, 9.0, ""), ("1", " rare  term ", 0.02, 9.0, ""), ("2", "rare term", 0.03, 0.0, ""), ("1", "once", 0.9, 0.0, "")]
    rows += [(None, "x", 0.1, 0.0, ""), ("1", None, 0.1, 0.0, ""), ("1", "", 0.1, 0.0, ""), ("1", "y", None, 0.0, ""), ("1", "z", 0.0, 0.0, ""), ("1", "w", float("nan"), 0.0, "")]
    weights = distinctiveness.term_weights(spark.createDataFrame(rows, TOPICS), "issue_id", "keyword", "score")
    wanted = spark.createDataFrame([("1",), ("2",), ("404",)], "record string")
    for hot_rows in (2, 10**6):
        scored = distinctiveness.pointwise_information(weights, wanted, hot_rows=hot_rows)
        best = {r.record: r.term for r in distinctiveness.most_characteristic(scored).collect()}
        assert best == {"1": "rare term", "2": "rare term"}
        assert all(r.ppmi >= 0 for r in scored.collect())
        assert {r.term for r in scored.where("record = '1'").collect()} == {"common", "rare term", "once"}
    empty = distinctiveness.term_weights(spark.createDataFrame([], TOPICS), "issue_id", "keyword", "score")
    assert distinctiveness.pointwise_information(empty).count() == 0


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


PAIRS = "a string, b string, blended double, u string, degree int"


@pytest.mark.parametrize("seed, hot_rows", [(0, 3), (1, 10**6), (2, 3)])
def test_groups_against_union_find(spark, seed, hot_rows):
    dice = random.Random(seed)
    names = [f"k{i:03d}" for i in range(120)]
    dice.shuffle(names)
    edges = [(dice.choice(names), dice.choice(names)) for _ in range(70)] + [(names[i], names[i + 1]) for i in range(20)] + [("hub", n) for n in names[60:80]]
    rows = [(a, b, 0.6 + dice.random() / 3, "u", 1) for a, b in edges]
    rows += [(b, a, s, "u", 1) for a, b, s, _, _ in rows[:10]] + rows[:10]
    rows += [("x", "y", 0.59, "", 1), ("x", "z", None, "", 1), ("y", "z", float("nan"), "", 1), (None, "x", 0.9, "", 1), ("x", None, 0.9, "", 1), ("x", "x", 0.9, "", 1)]
    got = {r.member: r.group_key for r in match_groups.linked_groups(spark.createDataFrame(rows, PAIRS), "a", "b", "blended", 0.6, hot_rows=hot_rows).collect()}
    want = _union_find([(a, b) for a, b in edges if a != b])
    assert got == want


def test_long_chains_stars_and_nothing(spark):
    chain = [(f"n{i:04d}", f"n{i + 1:04d}", 1.0, "", 1) for i in range(300)] + [("a", f"s{i}", 1.0, "", 1) for i in range(50)]
    got = match_groups.linked_groups(spark.createDataFrame(chain, PAIRS), "a", "b", "blended", 0.6, hot_rows=10)
    assert {r.group_key: r["count"] for r in got.groupBy("group_key").count().collect()} == {"n0000": 301, "a": 51}
    assert match_groups.linked_groups(spark.createDataFrame([], PAIRS), "a", "b", "blended", 0.6).count() == 0
    assert match_groups.linked_groups(spark.createDataFrame([("B", "a", None, "", 1)], PAIRS), "a", "b").where(F.col("group_key") == "B").count() == 2
