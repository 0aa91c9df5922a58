"""Filling containers of fixed capacity: best fit with a bounded number of open windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import tokens
from colophon.session import cut, stored

WINDOWS = 64
#: Partitions whose leftovers meet in one task of a merging round.
FAN_IN = 16


class Packer:
    """Open windows of one capacity.  ``place`` gives the window of an item; ``closed`` collects windows sent on."""

    def __init__(self, capacity: int, windows: int = WINDOWS):
        self.capacity, self.windows = capacity, windows
        self.open: list[tuple[int, int]] = []  # (room left, window), ascending
        self.made = 0
        self.closed: list[int] = []

    def place(self, size: int) -> int:
        """Best fit: the open window with the least room that holds ``size``; if none does, a new one, for which the fullest
        is sent on if all are taken."""
        i = bisect_left(self.open, (size, -1))
        if i < len(self.open):
            room, window = self.open.pop(i)
        else:
            if len(self.open) >= self.windows:
                self.closed.append(self.open.pop(0)[1])
            room, window = self.capacity, self.made
            self.made += 1
        if room > size:
            insort(self.open, (room - size, window))
        else:
            self.closed.append(window)
        return window


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the parts of an item: one, unless it exceeds the capacity; an item of no tokens has one."""
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)] or [(0, 0)]


def _pack(specs: Sequence[tuple[int, int]], ranks: str, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        packers = {spec: Packer(capacity, windows) for spec, capacity in specs}
        fill: dict[tuple[int, int], int] = {}
        for batch in batches:
            rows = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = tokens.count_tokens(value, ranks)
                for spec, capacity in specs:
                    for number, (first, n) in enumerate(pieces(size, capacity)):
                        window = packers[spec].place(n)
                        fill[spec, window] = fill.get((spec, window), 0) + n
                        rows.append((spec, part, window, doc_id, number, first, n, False))
            for spec, packer in packers.items():
                for window in packer.closed:
                    del fill[spec, window]
                packer.closed.clear()
            yield _batch(rows)
        yield _batch([(spec, part, window, None, 0, 0, n, True) for (spec, window), n in fill.items()])

    return run


_PLACED = "spec_id int, part int, window long, doc_id string, piece int, first_token long, n_tokens long, leftover boolean"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _PLACED.split(", ")]
    columns = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


_MOVES = "spec_id int, part int, window long, to_part int, to_window long, n_tokens long, passed_on boolean"


def merge_windows(rows: list[tuple[int, int, int, int]], capacities: dict[int, int], windows: int) -> list[tuple]:
    """Windows (spec_id, part, window, fill) of one group, put together whole by best fit, largest first: rows of ``_MOVES``.

    A window is named after the first that it takes, ``n_tokens`` is what it holds in the end.  The ``windows`` of a
    capacity with the most room are passed on, all others are done."""
    rows = sorted(rows, key=lambda r: (r[0], -r[3], r[1], r[2]))
    out = []
    for spec, mine in groupby(rows, key=lambda r: r[0]):
        mine = list(mine)
        packer, names, fill = Packer(capacities[spec], len(mine)), {}, {}
        for _, part, window, n in mine:
            taken = packer.place(n)
            names.setdefault(taken, (part, window))
            fill[taken] = fill.get(taken, 0) + n
            out.append((spec, part, window, taken))
        roomy = {w for _, w in sorted(packer.open, key=lambda x: (-x[0], names[x[1]]))[:windows]}
        out[-len(mine) :] = [(s, p, w, *names[t], fill[t], t in roomy) for s, p, w, t in out[-len(mine) :]]
    return out


def merging_round(left: DataFrame, capacities: dict[int, int], windows: int, fan_in: int = FAN_IN) -> DataFrame:
    """Moves (``_MOVES`` and the new grp) of the windows ``left`` (spec_id, part, window, n_tokens, grp); ``fan_in``
    neighbouring groups become one."""
    names = [*(f.split()[0] for f in _MOVES.split(", ")), "grp"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(*(frame[c].tolist() for c in ("spec_id", "part", "window", "n_tokens"))))
        group = frame["to_grp"].iloc[0]
        return pd.DataFrame([(*move, group) for move in merge_windows(rows, capacities, windows)], columns=names)

    placed = left.withColumn("to_grp", F.floor(F.col("grp") / fan_in).cast("int"))
    return placed.groupBy("to_grp").applyInPandas(run, _MOVES + ", grp int")


def passed_on(moves: DataFrame) -> DataFrame:
    """The windows that a round passes on to the next one: at most ``windows`` of each group and capacity."""
    kept = moves.where("passed_on AND part = to_part AND window = to_window")
    return kept.select("spec_id", "part", "window", "n_tokens", "grp")


def _merged_leftovers(leftovers: DataFrame, capacities: dict[int, int], windows: int) -> DataFrame:
    """(spec_id, part, window, to_part, to_window): where each leftover window's items go.

    In each round the windows of ``FAN_IN`` neighbouring groups meet in one task.  A group passes on at most ``windows`` of a
    capacity, those with the most room, so that no group ever holds more than ``FAN_IN * windows`` of a capacity.
    """
    left = leftovers.select("spec_id", "part", "window", "n_tokens", F.col("part").alias("grp"))
    route = left.select("spec_id", "part", "window", F.col("part").alias("to_part"), F.col("window").alias("to_window"))
    groups = (left.agg(F.max("grp")).first()[0] or 0) + 1
    while True:
        groups = -(-groups // FAN_IN)
        moves = stored(merging_round(left, capacities, windows)).frame
        step = moves.select("spec_id", F.col("part").alias("to_part"), F.col("window").alias("to_window"), F.col("to_part").alias("_p"), F.col("to_window").alias("_w"))
        route = route.join(step, ["spec_id", "to_part", "to_window"], "left").select(
            "spec_id", "part", "window", F.coalesce("_p", "to_part").alias("to_part"), F.coalesce("_w", "to_window").alias("to_window"))
        if groups <= 1:
            return route
        left = passed_on(moves)


def pack(documents: DataFrame, doc_id: str, text: str, specs: Sequence[tuple[int, int]], ranks: str = tokens.RANKS, windows: int = WINDOWS) -> DataFrame:
    """(spec_id, capacity_tokens, container_id, doc_id, piece, first_token, n_tokens): where each text goes for each of
    ``specs`` (spec_id, capacity).

    Every partition packs its texts as they come into at most ``windows`` open windows by best fit and sends the fullest on
    when none fits; the at most ``windows`` left at its end are merged with those of other partitions, whole.  Only a text larger than
    the capacity is split, into full containers and one rest.  A text without tokens takes no room but has its row.  Rows
    with null or repeated ``doc_id`` are packed each.  A table without rows gives none.  A text is tokenized once for all
    capacities.
    """
    capacities = {int(s): int(c) for s, c in specs}
    kind = documents.schema[doc_id].dataType
    rows = documents.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    placed = cut(rows.mapInArrow(_pack(list(capacities.items()), ranks, windows), _PLACED))
    route = _merged_leftovers(placed.where("leftover"), capacities, windows)
    items = placed.where("NOT leftover").drop("leftover").join(route, ["spec_id", "part", "window"], "left")
    name = F.format_string("%d-%06d-%09d", "spec_id", F.coalesce("to_part", "part"), F.coalesce("to_window", "window"))
    capacity = F.element_at(F.create_map(*[F.lit(x) for pair in capacities.items() for x in pair]), F.col("spec_id"))
    return items.select("spec_id", capacity.alias("capacity_tokens"), name.alias("container_id"), F.col("doc_id").cast(kind).alias("doc_id"), "piece", "first_token", "n_tokens")


def fill_report(packed: DataFrame) -> DataFrame:
    """(spec_id, capacity_tokens, containers, tokens, fill): how full the containers of each capacity are."""
    each = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    totals = each.groupBy("spec_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return totals.withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))


def violations(packed: DataFrame, documents: DataFrame, doc_id: str) -> DataFrame:
    """(spec_id, problem, name): what a packing must not hold, so none for a sound one.

    ``overfull``: a container above its capacity; ``split``: a document in several pieces that fits into one; ``gap``: pieces
    that don't follow each other; ``uneven``: a document of different size for different capacities; ``missing`` and
    ``invented``: documents without a row, and rows without a document, by capacity.
    """
    name = F.col("doc_id").cast("string")
    full = packed.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"))
    full = full.where("n > capacity_tokens").select("spec_id", F.lit("overfull").alias("problem"), F.col("container_id").alias("name"))
    each = packed.where("doc_id IS NOT NULL").groupBy("spec_id", "capacity_tokens", "doc_id").agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("last"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")
    )
    split = each.where("n <= capacity_tokens AND pieces > 1").select("spec_id", F.lit("split").alias("problem"), name.alias("name"))
    gap = each.where("pieces <> last + 1 OR end <> n").select("spec_id", F.lit("gap").alias("problem"), name.alias("name"))
    uneven = each.groupBy("doc_id").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a <> b").select(F.lit(None).cast("int").alias("spec_id"), F.lit("uneven").alias("problem"), name.alias("name"))
    known = documents.select(F.col(doc_id).alias("doc_id"), F.lit(True).alias("_given")).where("doc_id IS NOT NULL").distinct()
    wanted = known.join(F.broadcast(packed.select("spec_id").distinct()))
    paired = each.select("spec_id", "doc_id", F.lit(True).alias("_packed")).join(wanted, ["spec_id", "doc_id"], "full")
    problem = F.when(F.col("_packed").isNull(), "missing").when(F.col("_given").isNull(), "invented")
    odd = paired.select("spec_id", problem.alias("problem"), name.alias("name")).where("problem IS NOT NULL")
    return full.unionByName(split).unionByName(gap).unionByName(uneven).unionByName(odd)
