"""Groups of records linked directly or through others: deterministic Boruvka hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.operators.skew import HOT_ROWS, skew_join
from colophon.session import Stored, stored

#: Earlier rounds that one plan of the last step looks up.
LOOKUPS = 4


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _looked_up(left: DataFrame, right: DataFrame, key: str, spread: str, rows: int, hot_rows: int, how: str = "inner") -> DataFrame:
    """Join with ``right``, which holds each key once.  Only where ``left`` has ``hot_rows`` rows or more can a key be hot:
    then hot keys are salted."""
    return skew_join(left, right, [key], how, [spread], hot_rows=hot_rows) if rows >= hot_rows else left.join(right, key, how)


def _upper(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))


def _hooks(edges: DataFrame) -> DataFrame:
    """(u, p): the other end of every component's smallest outgoing edge."""
    ends = F.struct(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    least = _both_ways(edges).groupBy("u").agg(F.min(ends).alias("e"))
    return least.select("u", F.when(F.col("e.a") == F.col("u"), F.col("e.b")).otherwise(F.col("e.a")).alias("p"))


def _collapse(edges: Stored, hot_rows: int) -> Stored:
    """(u, p): every component's root, by pointer doubling along the hooks; two components that chose each other get the
    smaller as root.

    A step stores its parents and tells whether any still moved.  While few rows are left a step doubles twice, which
    halves the number of jobs; with many it doubles once, so that no join is computed twice.
    """
    hooks, own = _hooks(edges.frame), None
    if 2 * edges.observed["rows"] >= hot_rows:
        own = stored(hooks)
        hooks = own.frame
    root = F.when(F.col("pp") == F.col("u"), F.least("u", "p")).otherwise(F.col("pp"))
    parents = stored(_looked_up(hooks, _upper(hooks), "p", "u", 2 * edges.observed["rows"], hot_rows).select("u", root.alias("p")), rows="count(1)")
    if own is not None:
        own.discard()
    moved = True
    while moved:
        rows, frame = parents.observed["rows"], parents.frame
        step = _looked_up(frame, _upper(frame), "p", "u", rows, hot_rows).select("u", "p", "pp")
        if rows < hot_rows:
            twice = step.select("u", F.col("pp").alias("p"))
            step = twice.join(_upper(twice), "p")
        step = step.select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
        later = stored(step, "u", "p", rows="count(1)", moved="max(moved)")
        parents.discard()
        parents, moved = later, later.observed["moved"]
    return parents


def linked_groups(
    pairs: DataFrame, left: str, right: str, score: str | None = None, least_score: float = 0.0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """(member, group_key) for every value that a match links to another one.

    A row is a match if both values are given and differ and ``score`` (if named) is neither null nor NaN and at least
    ``least_score``; repeated and reversed rows are one link.  ``group_key`` is the smallest member in byte order.

    Every component hooks itself along its smallest outgoing edge, ordered by both ends, so that hooks form trees but for
    pairs that chose each other.  Trees collapse by pointer doubling, edges are renamed to the roots, loops and repeats
    are dropped, until no edge is left: the components halve each round at least.  As the smallest component always
    becomes the root of its tree, the last root is the group's smallest member.  Each step is a table in the checkpoint
    folder, deleted once the next one stands; the roots of the rounds stay.  Members of many links are salted.  The driver
    gets numbers of rows and whether anything moved, out of the job that writes the step.
    """
    links = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    if score is not None:
        links = links.where(~F.isnan(F.col(score).cast("double")) & (F.col(score) >= least_score))
    edges = stored(links.select(F.least(left, right).alias("u"), F.greatest(left, right).alias("v")).distinct(), rows="count(1)")
    rounds: list[Stored] = []
    while edges.observed["rows"]:
        rows = edges.observed["rows"]
        rounds.append(_collapse(edges, hot_rows))
        roots = rounds[-1].frame
        renamed = _looked_up(edges.frame, roots, "u", "v", rows, hot_rows).select(F.col("p").alias("a"), "v")
        renamed = _looked_up(renamed, roots.withColumnRenamed("u", "v"), "v", "a", rows, hot_rows).select("a", F.col("p").alias("b")).where("a != b")
        later = stored(renamed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), rows="count(1)")
        edges.discard()
        edges = later
    if not rounds:
        return edges.frame.select(F.col("u").alias("member"), F.col("v").alias("group_key"))
    groups, pending = rounds.pop().frame, 0
    while rounds:
        earlier = rounds.pop()
        later = groups.select(F.col("u").alias("p"), F.col("p").alias("final"))
        named = _looked_up(earlier.frame, later, "p", "u", earlier.observed["rows"], hot_rows, "left")
        groups, pending = named.select("u", F.coalesce("final", "p").alias("p")), pending + 1
        if pending == LOOKUPS:
            groups, pending = stored(groups).frame, 0
    return groups.select(F.col("u").alias("member"), F.col("p").alias("group_key"))
