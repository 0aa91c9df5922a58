"""A stored inverted index: postings in hash buckets of their terms, so that a query reads the buckets of its words alone."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.functions import dictionaries as D
from colophon.functions import text as T
from colophon.functions.porter import porter, porter_all
from colophon.session import ensure_checkpoint_dir, stored

BUCKETS = 64
#: Files of a bucket, so that no task writes all postings of a frequent word.
SPLITS = 8


@dataclass(frozen=True)
class SearchIndex:
    """Segments of postings, each with the documents that later segments replaced; lengths and their sums are stored too."""

    segments: tuple[tuple[DataFrame, DataFrame | None], ...]
    lengths: DataFrame
    documents: int
    average: float
    fields: tuple[str, ...]
    buckets: int
    stemmed: bool

    def word(self, raw: str) -> str:
        """A query's word in the form of the index."""
        word = T.fold(raw.lower())
        return porter(word) if self.stemmed else word

    def postings(self, words: Sequence[str]) -> DataFrame:
        """(term, doc_id, field, positions) of ``words``, out of their buckets only."""
        wanted = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        parts = []
        for rows, gone in self.segments:
            hit = rows.where(F.col("bucket").isin(wanted) & F.col("term").isin(list(words)))
            parts.append((hit if gone is None else hit.join(gone, "doc_id", "left_anti")).select("term", "doc_id", "field", "positions"))
        return reduce(DataFrame.unionByName, parts)


def _tokens(documents: DataFrame, doc_id: str, fields: Sequence[str], stemmed: bool) -> DataFrame:
    each = [F.struct(F.lit(f).alias("field"), T.words(T.folded(F.col(f))).alias("tokens")) for f in fields]
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(*each)).alias("f")).select("doc_id", "f.field", "f.tokens")
    return rows.withColumn("tokens", porter_all("tokens")) if stemmed else rows


def _written(documents: DataFrame, doc_id: str, fields: Sequence[str], buckets: int, stemmed: bool) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of ``documents``, stored; postings lie in one folder per bucket."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    tokens = _tokens(documents, doc_id, fields, stemmed)
    lengths = stored(tokens.groupBy("doc_id").agg(F.sum(F.size("tokens")).cast("double").alias("length"))).frame
    terms = tokens.select("doc_id", "field", F.posexplode("tokens").alias("position", "term"))
    rows = terms.groupBy("doc_id", "field", "term").agg(F.sort_array(F.collect_list("position")).alias("positions"))
    rows = rows.withColumn("bucket", (F.crc32(F.col("term").cast("binary")) % buckets).cast("int"))
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    split = F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS))
    rows.repartition("bucket", split).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), lengths


def _index(segments, lengths: DataFrame, fields: Sequence[str], buckets: int, stemmed: bool) -> SearchIndex:
    sums = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    return SearchIndex(tuple(segments), lengths, sums["n"], float(sums["average"] or 1.0), tuple(fields), buckets, stemmed)


def build(documents: DataFrame, doc_id: str, fields: Sequence[str], buckets: int = BUCKETS, stemmed: bool = False) -> SearchIndex:
    """Index ``fields`` of ``documents``: words in lower case without diacritics, stemmed by Porter's rules if asked to.  Null
    fields are empty; ``doc_id`` is unique."""
    postings, lengths = _written(documents, doc_id, fields, buckets, stemmed)
    return _index([(postings, None)], lengths, fields, buckets, stemmed)


def updated(index: SearchIndex, changed: DataFrame, doc_id: str, deleted: DataFrame | None = None) -> SearchIndex:
    """``index`` with ``changed`` documents, new or anew, and without ``deleted`` (``doc_id``): a further segment is written, the
    others stay as they are and skip what it replaces."""
    gone = changed.select(F.col(doc_id).alias("doc_id"))
    gone = stored((gone if deleted is None else gone.unionByName(deleted.select(F.col(doc_id).alias("doc_id")))).distinct()).frame
    postings, lengths = _written(changed, doc_id, index.fields, index.buckets, index.stemmed)
    kept = stored(index.lengths.join(gone, "doc_id", "left_anti").unionByName(lengths)).frame
    older = [(rows, gone if g is None else stored(g.unionByName(gone).distinct()).frame) for rows, g in index.segments]
    return _index([*older, (postings, None)], kept, index.fields, index.buckets, index.stemmed)


def bm25(index: SearchIndex, groups: Sequence[Sequence[str]], weights: Mapping[str, float] = D.FIELD_WEIGHTS) -> DataFrame:
    """(doc_id, bm25) of the documents that hold every group of words in a row in one field; smaller is better.

    The formula is that of :func:`colophon.operators.lexical.bm25`; only postings of the groups' words are read.  No groups
    match nothing.
    """
    groups = [[index.word(w) for w in g] for g in groups]
    words = sorted({w for g in groups for w in g})
    if not words:
        return index.lengths.where(F.lit(False)).select("doc_id", F.lit(0.0).alias("bm25"))
    entries = F.map_from_entries(F.collect_list(F.struct("term", "positions")))
    rows = index.postings(words).groupBy("doc_id", "field").agg(entries.alias("at"))
    places = lambda w: F.coalesce(F.col("at")[w], F.array().cast("array<int>"))

    def runs(group: Sequence[str]):
        if len(group) == 1:
            return F.size(places(group[0]))
        rest = lambda p: T.all_of([F.array_contains(places(w), p + i) for i, w in enumerate(group[1:], 1)])
        return F.size(F.filter(places(group[0]), rest))

    weight = F.element_at(F.create_map(*[F.lit(x) for f in index.fields for x in (f, float(weights.get(f, 1.0)))]), F.col("field"))
    counted = rows.select("doc_id", weight.alias("w"), *[runs(g).alias(f"r{i}") for i, g in enumerate(groups)])
    per_document = counted.groupBy("doc_id").agg(*[F.sum(F.col("w") * F.col(f"r{i}")).alias(f"f{i}") for i in range(len(groups))])
    hit = [F.col(f"f{i}") > 0 for i in range(len(groups))]
    found = per_document.agg(*[F.sum(h.cast("long")).alias(f"h{i}") for i, h in enumerate(hit)]).first()
    parts = []
    for i in range(len(groups)):
        n, h = float(index.documents), float(found[f"h{i}"] or 0)
        idf = F.greatest(F.ln(F.lit((n - h + 0.5) / (h + 0.5))), F.lit(D.LEAST_IDF))
        norm = F.lit(D.BM25_K1) * (F.lit(1 - D.BM25_B) + F.lit(D.BM25_B) * F.col("length") / F.lit(index.average))
        parts.append(idf * F.col(f"f{i}") * F.lit(D.BM25_K1 + 1) / (F.col(f"f{i}") + norm))
    matching = per_document.where(T.all_of(hit)).join(index.lengths, "doc_id")
    return matching.select("doc_id", (-reduce(lambda a, b: a + b, parts)).alias("bm25"))
