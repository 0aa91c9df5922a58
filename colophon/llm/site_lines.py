"""Lines that recur in many documents of one site: fixed-depth template trees, merged across partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.web import host_of
from colophon.operators.skew import HOT_ROWS, MAX_HOT, SALTS, skew_join

WILD = "<*>"
DEPTH = 3
SIMILAR = 0.5
OPEN = 64
#: Templates a partition holds before it passes them on and starts a new tree.
HELD = 50_000


def compared_form(line: Column) -> Column:
    """The form in which lines are compared: trimmed, lower case, runs of spaces and tabs as one space, runs of 0-9 as 0."""
    spaced = F.regexp_replace(F.lower(line), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"^ | $", ""), r"[0-9]+", "0")


def leaf_of(tokens: list[str], depth: int = DEPTH) -> str:
    """Path to a leaf of the tree: the number of tokens, then the first ``depth`` tokens, those with a digit as a slot."""
    head = (WILD if "0" in t else t for t in tokens[:depth])
    return " ".join((str(len(tokens)), *head))


class TemplateTree:
    """Templates below the leaves of a fixed-depth tree; a leaf keeps ``open_templates`` of them open for merging."""

    def __init__(self, similar: float = SIMILAR, open_templates: int = OPEN):
        self.similar, self.open_templates = similar, open_templates
        self.leaves: dict[tuple[str, str], list[list]] = {}
        self.held = 0

    def empty(self) -> list[tuple[str, str, list]]:
        """All templates; the tree starts anew."""
        entries = [(*leaf, e) for leaf, open_here in self.leaves.items() for e in open_here]
        self.leaves, self.held = {}, 0
        return entries

    def add(self, host: str, leaf: str, tokens: list[str], documents: int, forms: list[str]) -> list | None:
        """Put a line into the most similar template of its leaf, or a new one; gives back a template that was closed."""
        open_here = self.leaves.setdefault((host, leaf), [])
        need, best, most = self.similar * len(tokens), None, -1
        for entry in open_here:
            same = sum(a == b for a, b in zip(entry[0], tokens))
            if same >= need and same > most:
                best, most = entry, same
        if best is not None:
            best[0] = [a if a == b else WILD for a, b in zip(best[0], tokens)]
            best[1] += documents
            best[2] += forms
            return None
        open_here.append([tokens, documents, forms])
        self.held += 1
        if len(open_here) <= self.open_templates:
            return None
        self.held -= 1
        least = min(range(len(open_here)), key=lambda i: open_here[i][1])
        return open_here.pop(least)


def _rows(entries: Iterable[tuple[str, str, list]]) -> pd.DataFrame:
    """Templates to pass on; one of a single document and without a form that may be a case covers nothing."""
    columns = ["host", "leaf", "template", "documents", "forms"]
    return pd.DataFrame([(h, leaf, " ".join(e[0]), e[1], e[2]) for h, leaf, e in entries if e[1] > 1 or e[2]], columns=columns)


def _templates(documents_least: int, similar: float, open_templates: int, merging: bool):
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = TemplateTree(similar, open_templates)
        for batch in batches:
            closed = []
            names = ["host", "leaf", "template", "documents", "forms"] if merging else ["host", "form", "documents"]
            for row in zip(*(batch[c] for c in names)):
                if merging:
                    host, leaf, text, documents, forms = row
                    tokens, forms = text.split(" "), list(forms)
                else:
                    host, text, documents = row
                    tokens = text.split(" ")
                    leaf, forms = leaf_of(tokens), [text] if documents >= documents_least else []
                if (entry := tree.add(host, leaf, tokens, int(documents), forms)) is not None:
                    closed.append((host, leaf, entry))
            if merging and tree.leaves:  # sorted by leaf: all but the last one are complete
                last = next(reversed(tree.leaves))
                done = [k for k in tree.leaves if k != last]
                closed += [(*k, e) for k in done for e in tree.leaves.pop(k)]
            elif tree.held > HELD:
                closed += tree.empty()
            if closed:
                yield _rows(closed)
        yield _rows(tree.empty())

    return parse


def document_lines(documents: DataFrame, doc_id: str, url: str, text: str) -> DataFrame:
    """(doc_id, host, lines) of the documents with a text; ``lines`` splits it at line feeds."""
    rows = documents.where(F.col(text).isNotNull())
    return rows.select(F.col(doc_id).alias("doc_id"), host_of(F.col(url)).alias("host"), F.split(text, "\n", -1).alias("lines"))


def recurring_forms(
    lines: DataFrame,
    least_documents: int = 5,
    least_share: float = 0.1,
    similar: float = SIMILAR,
    open_templates: int = OPEN,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(host, form, documents): compared forms in at least ``least_documents`` documents and ``least_share`` of the host's.

    Distinct forms are counted per host (a form counts once per document) and parsed into templates, each partition with a
    tree of its own; the partitions' templates are merged leaf by leaf, parts of a leaf first, so that a hot host's leaves are
    small when they meet.  A template covers at least the documents of each
    of its forms, so only forms of templates that cover enough documents are held against the exact limits.
    """
    hosts = lines.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    forms = F.array_distinct(F.transform("lines", compared_form))
    each = lines.where(F.col("host").isNotNull()).select("host", F.explode(forms).alias("form")).where("form <> ''")
    counted = each.groupBy("host", "form").agg(F.count(F.lit(1)).alias("documents"))
    schema = "host string, leaf string, template string, documents long, forms array<string>"
    partial = counted.mapInPandas(_templates(least_documents, similar, open_templates, False), schema)
    merge = _templates(least_documents, similar, open_templates, True)
    spread = partial.repartition("host", "leaf", F.pmod(F.xxhash64("template"), F.lit(SALTS))).sortWithinPartitions("host", "leaf", "template")
    placed = spread.mapInPandas(merge, schema).repartition("host", "leaf").sortWithinPartitions("host", "leaf", "template")
    merged = placed.mapInPandas(merge, schema)
    limit = F.greatest(F.lit(least_documents), F.col("host_documents") * F.lit(least_share))
    large = hosts.where(F.col("host_documents") >= hot_rows).orderBy(F.desc("host_documents"), "host").limit(MAX_HOT).select("host")
    covering = skew_join(merged.where((F.col("documents") >= least_documents) & (F.size("forms") > 0)), hosts, ["host"], "inner", ["leaf", "template"], large)
    candidates = covering.where(F.col("documents") >= limit).select("host", F.explode("forms").alias("form"), "host_documents")
    exact = candidates.join(counted.where(F.col("documents") >= least_documents), ["host", "form"])
    return exact.where(F.col("documents") >= limit).select("host", "form", "documents")


def recurring_lines(
    documents: DataFrame,
    doc_id: str,
    url: str,
    text: str,
    least_documents: int = 5,
    least_share: float = 0.1,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(doc_id, line_no from 1) of each line whose compared form recurs too often on its host (:func:`recurring_forms`).

    ``doc_id`` is unique.  Documents with null text count nowhere; documents without a host have no cases; blank lines are
    never cases.  The hottest forms are salted.  Empty tables give an empty result.
    """
    lines = document_lines(documents, doc_id, url, text)
    frequent = recurring_forms(lines, least_documents, least_share, hot_rows=hot_rows)
    each = lines.where(F.col("host").isNotNull()).select("doc_id", "host", F.posexplode("lines").alias("line_no", "line"))
    each = each.select("doc_id", "host", (F.col("line_no") + 1).cast("long").alias("line_no"), compared_form(F.col("line")).alias("form"))
    hot = frequent.where(F.col("documents") >= hot_rows).orderBy(F.desc("documents"), "host", "form").limit(MAX_HOT)
    return skew_join(each.where("form <> ''"), frequent.select("host", "form"), ["host", "form"], "left_semi", ["doc_id", "line_no"], hot.select("host", "form")).select("doc_id", "line_no")


def without_recurring_lines(documents: DataFrame, doc_id: str, url: str, text: str, **limits) -> DataFrame:
    """``documents`` with ``text`` free of its recurring lines; all rows and other columns stay, null texts stay null."""
    found = recurring_lines(documents, doc_id, url, text, **limits)
    gone = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", doc_id)
    marked = documents.join(gone, doc_id, "left")
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.array_contains(F.col("_gone"), (i + 1).cast("long")))
    return marked.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("_gone")
