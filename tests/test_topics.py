import random

import pytest
from pyspark.sql import functions as F

from colophon.operators import topics, yake
from colophon.plans import topics as plans


def _line(spark, rows):
    return {r.keyword: (r.burst_score, r.burst_quarter) for r in topics.bursts(spark.createDataFrame(rows, "keyword string, year int, month int, occurrences int")).collect()}


def test_bursts(spark):
    got = _line(spark, [("even", 2024, m, 1) for m in (1, 4, 7, 10)] + [("one", 2024, 2, 10)] + [("gap", 2023, 1, 1), ("gap", 2024, 1, 10)] + [("late", 2023, 1, 1), ("late", 2023, 4, 1), ("late", 2024, 3, 8)] + [("none", 2024, 1, 0), ("odd", 2024, 40, 2)])
    assert got["even"] == (1.0, "2024-Q1") and got["one"] == (1.0, "2024-Q1")
    assert got["gap"] == (pytest.approx(10 / (11 / 5)), "2024-Q1")
    assert got["late"][0] == pytest.approx(8 / (10 / 5))
    assert "none" not in got and got["odd"] == (1.0, "2024-Q4")


@pytest.mark.parametrize(
    "keyword, n, spread, ratio, reason",
    [
        ("blocked", 50, 9, 0.0, "blocklist"), ("ai", 1, 1, 0.9, None), ("editors note", 9, 9, 0.0, "boilerplate_phrase"), ("as treasury", 9, 9, 0.0, "malformed_phrase"),
        ("what you can", 9, 9, 0.0, "malformed_phrase"), ("img src", 9, 9, 0.0, "markup_artifact"), ("software", 99, 9, 0.0, "noise_word"), ("their trust", 9, 9, 0.0, "pronoun_lead"),
        ("trust without", 9, 9, 0.0, "weak_phrase"), ("trust", 9, 9, 0.25, "phrase_component"), ("oak", 19, 9, 0.0, "short_low_freq"), ("clarify", 9, 3, 0.0, "weak_suffix"),
        ("harbor", 3, 1, 0.0, "weak_singleton"), ("harbor", 4, 1, 0.0, None), ("quiet harbor", 1, 1, 0.9, None),
    ],
)
def test_suppression(spark, keyword, n, spread, ratio, reason):
    row = spark.range(1).select(topics.suppression_reason(F.lit(keyword), F.lit(None).cast("int"), F.lit(n), F.lit(spread), F.lit(keyword == "blocked"), F.lit(ratio)).alias("r"))
    assert row.first().r == reason


def test_confidence(spark):
    rows = spark.createDataFrame([(2, 5, 0), (2, 1, 0), (1, 3, 0), (1, 2, 0), (2, 5, 1), (1, 2, 4), (None, None, None)], "s int, f int, d int")
    got = [r.c for r in rows.select(topics.topic_confidence(F.col("s"), F.col("f"), F.col("d")).alias("c")).collect()]
    assert got == ["high", "medium", "medium", "low", "medium", "low", "low"]


def test_corpus_topics(spark):
    schema = "issue_id string, keyword string, keyword_display string, score double, ngram_size int, suppression_reason string, stem string, topic_type string"
    rows = [(str(i), "models" if i % 2 else "model", "M", 0.1 * (i + 1), 1, None, "model", t) for i, t in enumerate(("theme", "theme", "unknown", None))]
    rows += [("0", "hidden", "H", 0.1, 2, "noise_word", None, None), ("1", "rare", "R", 0.1, 2, None, "", None)]
    issues = spark.createDataFrame([(str(i), f"2024-0{i + 1}-01" if i else None) for i in range(4)], "id string, published_at string")
    got = topics.corpus_topics(spark.createDataFrame(rows, schema), issues, 10).collect()
    assert [(r.keyword, r.doc_frequency, r.first_seen, r.last_seen, r.topic_type) for r in got] == [("model", 4, "2024-02-01", "2024-04-01", "theme")]
    assert got[0].avg_score == pytest.approx(0.25) and got[0].aggregate_score == pytest.approx(4 / 0.25 * 0.6)


def test_nested_fragments(spark):
    carried = [("language models", str(i)) for i in range(2)] + [("large language models", str(i)) for i in range(3)] + [("systems thinking", "9")]
    rows = spark.createDataFrame([(k, i, None) for k, i in carried], "keyword string, issue_id string, suppression_reason string")
    assert [r.keyword for r in topics.nested_fragments(rows.select("keyword").distinct(), rows).collect()] == ["language models"]


def test_nested_fragments_of_any_length(spark):
    longer = "one two three four five six seven eight"
    inside = ["two three four five six seven", "one two three four five six seven", "seven eight"]
    rows = spark.createDataFrame([(k, "1", None) for k in [longer, "two four", *inside]], "keyword string, issue_id string, suppression_reason string")
    assert {r.keyword for r in topics.nested_fragments(rows.select("keyword"), rows).collect()} == set(inside)


def test_similar_spellings_against_all_pairs(spark):
    words = ["loose coupling", "loosely coupling", "loose couplings", "tight coupling", "abc", "abcd", "ab", "b", "loose coupling"]
    got = {(r.a, r.b): r.dice for r in topics.similar_spellings(spark.createDataFrame([(w,) for w in words], "keyword string"), 0.8).collect()}
    pairs = lambda w: {w[i : i + 2] for i in range(len(w) - 1)}
    want = {}
    for a in set(words):
        for b in set(words):
            if a < b and pairs(a) and pairs(b) and (d := 2 * len(pairs(a) & pairs(b)) / (len(pairs(a)) + len(pairs(b)))) >= 0.8:
                want[a, b] = pytest.approx(d)
    assert got == want and want


def test_spellings_meet_on_several_pairs_at_once(spark):
    from random import Random

    import numpy as np

    random = Random(3)
    syllables = [c + v for c in "bdfghjklmnprstvz" for v in "aeio"]
    word = lambda n: "".join(random.choices(syllables, k=n))
    words = {f"{word(3)} {word(2)}s" for _ in range(4000)}
    for n in (1, 2, 3, 8, 13, 20, 45, 100):  # longer ones meet on fewer pairs
        for w in {word(n) for _ in range(12)}:
            i = random.randrange(len(w))
            words |= {w, w + "s", w[:i] + "u" + w[i:], w[:i] + w[i + 1 :], w[: len(w) * 3 // 4]}
    words = sorted(w for w in words if len(w) > 1)
    sets = [{w[i : i + 2] for i in range(len(w) - 1)} for w in words]
    places = {p: i for i, p in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(words), len(places)), dtype="float32")
    for row, s in zip(held, sets):
        row[[places[p] for p in s]] = 1
    sizes = held.sum(1)
    dice = 2.0 * (held @ held.T) / (sizes[:, None] + sizes[None, :])
    frame = spark.createDataFrame([(w,) for w in words], "keyword string")
    for least in (0.85, 0.6):
        want = {(words[a], words[b]) for a, b in zip(*np.nonzero(np.triu(dice >= least - 1e-6, 1)))}
        got = [(r.a, r.b) for r in topics.similar_spellings(frame, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    short = topics.spelling_signatures(frame.where("length(keyword) < 16"), 0.85).groupBy("met").count()
    assert short.selectExpr("sum(count * (count - 1) / 2)").first()[0] < 2 * len(words)  # few more than are alike


def test_clusters_sum_frequencies_or_count_issues_once(spark):
    corpus = spark.createDataFrame([("loose coupling", 3, 0.2), ("loose couplings", 2, 0.1), ("other", 1, 0.3)], "keyword string, doc_frequency long, avg_score double")
    got = {r.keyword: (r.doc_frequency, r.members) for r in topics.clustered(corpus).collect()}
    assert got == {"loose couplings": (5, 2), "other": (1, 1)}
    carried = spark.createDataFrame([("loose coupling", i) for i in "abc"] + [("loose couplings", i) for i in "bc"] + [("other", "a")], "keyword string, issue_id string")
    assert {r.keyword: r.doc_frequency for r in topics.clustered(corpus, distinct_issues=carried).collect()} == {"loose couplings": 3, "other": 1}


def test_merging_and_ratios(spark):
    entity = spark.createDataFrame([("d", "Trust", 5)], "doc_id string, keyword string, occurrences int")
    phrase = spark.createDataFrame([("d", "institutional trust", 4), ("d", "trust", 1)], "doc_id string, keyword string, occurrences int")
    merged = topics.merged_candidates({"known_entity": entity, "phrase_lexicon": phrase})
    rows = {r.keyword: r for r in merged.collect()}
    assert rows["trust"].provenance == ["known_entity", "phrase_lexicon"] and rows["trust"].score == 0.05 and rows["trust"].place == 1
    assert {r.keyword: r.ratio for r in topics.component_ratios(merged).collect()} == {"trust": 0.8}
    built = topics.constructed(merged, {"trust": "institutional trust"})
    assert [(r.keyword, r.canonical) for r in built.collect()] == [("trust", "institutional trust")]


def test_known_entities_count_whole_words(spark):
    docs = spark.createDataFrame([("a", "LLM and llms, not llmx. C++ (LLM)"), ("b", None)], "id string, text string")
    got = topics.known_entities(docs, "id", "text", {"models": ["llm", "llms"], "c++": ["c++"]})
    assert sorted((r.doc_id, r.keyword, r.occurrences) for r in got.collect()) == [("a", "c++", 1), ("a", "models", 3)]


def test_lexicon_of_nothing(spark):
    empty = spark.createDataFrame([(None,), ("",)], "text string")
    assert topics.phrase_lexicon(empty, "text").count() == 0


def test_yake():
    text = "Loose coupling helps teams. Loose coupling keeps systems small.\nGovernance of loose coupling is hard."
    found = yake.extract(text, top=5)
    assert "loose coupling" in [k for k, _, _ in found]
    assert [s for _, _, s in found] == sorted(s for _, _, s in found)
    assert yake.extract(None) == [] and yake.extract("") == [] and yake.extract("the of and") == []


def test_drift(spark):
    docs = spark.createDataFrame([("the market rose rose fast market rose", 2024, 1), ("the market fell fell market fell", 2024, 5), (None, 2024, 1), ("market", None, 2)], "text string, year int, month int")
    got = {(r.quarter, r.word): r.lift for r in topics.drift(docs, "text", "market").collect() if r.word in ("rose", "fell")}
    assert set(got) == {(1, "rose"), (2, "fell")} and all(v > 1 for v in got.values())


def test_all_candidates_reach_the_rules(spark, tmp_path):
    chance = random.Random(5)
    word = lambda: "".join(chance.choice("bcdfghklmnprstvw") + chance.choice("aeiou") for _ in range(3))
    words = [word() for _ in range(20)]
    text = " ".join(" ".join(chance.sample(words, 3)) + "." for _ in range(60))
    spark.createDataFrame([("i", "active", text)], "id string, status string, full_text_plain string").write.parquet(f"{tmp_path}/issues.parquet")
    spark.createDataFrame([(text,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [k for k, _, _ in yake.extract(text, 100)]
    phrases = [k for k in found if " " in k]  # single words of this source count once, which suppresses them
    assert len(found) == 100 and len(phrases) > 25 > len([k for k in found[:25] if " " in k])
    assert plans.merged_candidates(spark, str(tmp_path)).count() == 100
    got = plans.extracted_topics(spark, str(tmp_path)).collect()
    assert sorted(r.keyword for r in got) == sorted(phrases[:25]) and sorted(r["rank"] for r in got) == list(range(1, 26))


def test_spellings_apart_as_by_distance():
    chance = random.Random(6)
    words = ["".join(chance.choice("abc ") for _ in range(chance.randint(1, 24))) for _ in range(120)]
    words += [w[:i] + c + w[i + 1 :] for w in words for i, c in ((3, "a"), (7, "b"))]
    for a, b in zip(words * 3, words[1:] + words[120:] + words[:121] + words):
        want = abs(len(a) - len(b)) > (1 - 0.85) * max(len(a), len(b)) or yake._distance(a, b) < 0.85
        assert yake._apart(a, yake._bag(a), b, yake._bag(b), 0.85) == want


def test_similar_topics_are_all_pairs(spark):
    chance = random.Random(7)
    rows = [(f"k{i}", [chance.gauss(0, 1) for _ in range(4)], [chance.randint(0, 5)]) for i in range(30)] + [("none", None, [1]), ("zero", [0.0] * 4, [1]), ("short", [1.0], [1])]
    frame = spark.createDataFrame(rows, "keyword string, embedding array<double>, issues array<long>")
    got = [tuple(r) for r in topics.similar_topics(frame, blocks=3).collect()]
    assert sorted(got) == sorted(tuple(r) for r in topics.similar_to(frame, frame).collect())
    assert len({g[:2] for g in got}) == len(got) and {(b, a) for a, b, *_ in got} == {g[:2] for g in got} and len(got) > 100
