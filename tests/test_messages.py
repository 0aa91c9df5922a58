from collections import defaultdict
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from colophon.operators import messages

SCHEMA = "id string, semantic_key string, queued_at string, note string"
ROWS = [
    ("a", "K:1", "2024-01-02T00:00:00Z", "late"),
    ("b", " k:1\n", "2024-01-01T23:30:00-01:00", "later"),
    ("c", "k:1\t", "1704067200000", "first"),
    ("d", "k:2", "2024-01-01 10:00:00", "tie"),
    ("e", "K:2", "2024-01-01T10:00:00.000+00:00", "tie"),
    ("f", None, None, "no key"),
    ("g", None, "2024-01-01", "no key"),
    ("h", "k:3", None, "no time"),
    ("i", "k:3", "nonsense", "no time"),
    ("j", "k:3", "2024-05-05T00:00:00Z", "a time"),
    ("k", "k:4", "2024-05-05T00:00:00Z", "alone"),
]


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_one_copy_of_each_message(spark, hot_rows):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    kept = {r.id for r in messages.keep_one(rows, hot_rows=hot_rows, salts=3).collect()}
    gone = [r.id for r in messages.redundant_copies(rows, hot_rows=hot_rows, salts=3).collect()]
    assert kept == {"c", "d", "f", "g", "j", "k"}
    assert sorted(gone) == ["a", "b", "e", "h", "i"]


def test_stored_and_new_messages_with_other_columns(spark):
    stored = spark.createDataFrame([("a", "x", "2024-01-02T00:00:00Z", 1)], "id string, semantic_key string, queued_at string, rank int")
    new = spark.createDataFrame([("b", "X", "2024-01-01T00:00:00Z", 2.5)], "id string, semantic_key string, queued_at string, count double")
    kept = messages.keep_one(stored, new)
    assert set(kept.columns) == {"id", "semantic_key", "queued_at", "rank", "count"}
    assert [(r.id, r["rank"], r["count"]) for r in kept.collect()] == [("b", None, 2.5)]


def test_repeated_rows_and_empty_tables(spark):
    rows = spark.createDataFrame([ROWS[0]] * 5, SCHEMA)
    assert messages.keep_one(rows, hot_rows=2).count() == 1
    assert messages.redundant_copies(rows, hot_rows=2).count() == 4
    empty = spark.createDataFrame([], SCHEMA)
    assert messages.keep_one(empty).count() == 0
    assert messages.redundant_copies(empty).count() == 0


def test_very_long_and_empty_identifiers(spark):
    long = "x" * 100_000
    rows = spark.createDataFrame([("a", long, None, ""), ("b", long.upper(), None, ""), ("c", "", None, ""), ("d", "  ", None, "")], SCHEMA)
    assert sorted(r.id for r in messages.redundant_copies(rows).collect()) == ["b", "d"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2024-02-16T01:21:38.991Z", 1708046498.991),
        ("2023-01-01T14:34:51.003+01:00", 1672580091.003),
        ("2023-01-01T09:10:18-0500", 1672582218.0),
        ("2023-01-01 12:57:53", 1672577873.0),
        ("1672575850420", 1672575850.420),
        ("soon", None),
        ("", None),
        (None, None),
    ],
)
def test_instants(spark, text, expected):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        frame = spark.createDataFrame([(text,)], "t string").select(F.unix_millis(messages.instant(F.col("t"))).alias("ms"))
        assert frame.first().ms == (None if expected is None else round(expected * 1000))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_against_plain_python(spark, sf):
    jobs = spark.read.parquet(f"{sf}/pipeline_jobs.parquet")
    groups = defaultdict(list)
    rows = jobs.select("id", "semantic_key", F.unix_micros(messages.instant(F.col("queued_at"))).alias("at")).collect()
    for r in rows:
        groups[r.semantic_key.strip(" \t\r\n").lower()].append((r["at"] is None, r["at"] or 0, r.id))
    expected = sorted(x[2] for g in groups.values() for x in sorted(g)[1:])
    assert expected
    assert sorted(r.id for r in messages.redundant_copies(jobs, hot_rows=3, salts=4).collect()) == expected
    assert datetime.fromtimestamp(0, timezone.utc).year == 1970
