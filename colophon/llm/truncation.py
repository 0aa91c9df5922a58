"""Text cut off by field limits or in transfer: hashed logistic regression on how texts end."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from colophon.operators.skew import HOT_ROWS, MAX_HOT, skew_join
from colophon.session import cut

BITS = 14
#: Rows at most that the classifier is fitted on; a fixed hash of the identifier chooses them.
SAMPLE_ROWS = 20_000
# Marks of omission that fields and feeds put after a cut.
MARKS = ("…", "...", " [...]", "… [read more]", " … Continue reading →", "�")
_MARK = r"(?i)(\s*(?:…|\.\.\.)?\s*(?:\[read more\]|read more|continue reading)\s*→?|\s*\[(?:…|\.\.\.)\]|\s*…|\s*\.\.\.|�+)$"
#: What the regular expressions of this module take for white space.
_SPACES = " \t\n\x0b\f\r"
_FENCE = r"(?m)^\s*```"
#: Signs after which a text may end; artificial cuts that happen to end in one are no positives.
_ENDS = r"[.!?:\"”»)\]}`>]$"
#: Tasks that the sample is spread over.
SPREAD = 24
#: Artificial cuts of each text of the sample.
CUTS = 4
#: Widest last line that is looked at word for word.
_SHORT = 60


def length_limits(counts: DataFrame, group: str, length: str, n: str, least_rows: int = 5, factor: float = 4.0) -> DataFrame:
    """(group, length), of (group, length, n), at which more texts end than lengths nearby let expect: within 3 of it at least ``factor`` times as
    many per length as 13 to 60 away, and ``least_rows`` at least."""
    near = W.partitionBy(group).orderBy(length).rangeBetween(-3, 3)
    far = W.partitionBy(group).orderBy(length).rangeBetween(-60, 60)
    middle = W.partitionBy(group).orderBy(length).rangeBetween(-12, 12)
    around = counts.select(group, length, F.sum(n).over(near).alias("near"), (F.sum(n).over(far) - F.sum(n).over(middle)).alias("far"))
    return around.where((F.col("near") >= least_rows) & (F.col("near") / 7 >= F.lit(factor) * (F.col("far") + 1) / 96)).select(group, length)


def _shape(text: Column) -> Column:
    """Words as ``a`` or ``A``, digits as ``9``, all else as it stands."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{Lu}[\p{L}\p{M}’]*", "A"), r"[\p{Ll}\p{Lo}][\p{L}\p{M}’]*", "a"), r"\d+", "9")


def _bucket(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double") + 1)).cast("string")


#: Names of the features and of the parts they are made of.
FEATURES = (
    "mark", "mark closing", "mark phrase", "closing3", "closing limit", "closing brief", "closing brief mark", "shape",
    "shape limit", "head", "head closing", "fence", "fence shape", "open brief", "limit", "blank closing", "words closing",
    "lead", "lead limit",
)


def _may_be_marked(line: Column) -> Column:
    """Whether a text's last line ends in what ends a mark; all marks do, so only these texts are searched for one."""
    ends = [line.endswith(x) for x in ("…", "...", "]", "→", "�")]
    words = [F.lower(F.substring(line, -16, 16)).endswith(x) for x in ("read more", "continue reading")]
    return reduce(Column.__or__, [*ends, *words])


def with_endings(texts: DataFrame) -> DataFrame:
    """``texts`` with short columns that say how each ``text`` ends, in place of the text.

    Steps build on one another, so that each piece of a text is cut out once.
    """
    rows = texts.withColumn("_body", F.rtrim(F.col("text"), F.lit(_SPACES)))
    rows = rows.withColumns({"_line": F.substring_index("_body", "\n", -1), "_fenced": F.col("text").contains("```")})
    rows = rows.withColumn("_marked", _may_be_marked(F.col("_line")))
    rows = rows.withColumns(
        {
            "_mark": F.when(F.col("_marked"), F.regexp_replace(F.lower(F.trim(F.regexp_extract("_body", _MARK, 1))), r"\s+", " ")).otherwise(F.lit("")),
            "_last": F.when(F.col("_marked"), F.substring_index(F.regexp_replace("_body", _MARK, ""), "\n", -1)).otherwise(F.col("_line")),
            "_fence": F.when(F.col("_fenced"), F.regexp_count(F.col("text"), F.lit(_FENCE)) % 2 == 1).otherwise(F.lit(False)).cast("string"),
            "_blank": (F.length("text") != F.length("_body")).cast("string"),
            "_empty": F.length("_body") == 0,
        }
    ).drop("text", "_body", "_line", "_fenced", "_marked")
    count = lambda sign: F.length("_last") - F.length(F.replace(F.col("_last"), F.lit(sign), F.lit("")))
    brief = F.length("_last") <= _SHORT
    rows = rows.withColumns(
        {
            "_brief": brief.cast("string"),
            "_shape": F.when(brief, F.substring(_shape(F.col("_last")), 1, 40)).otherwise(F.lit("long")),
            "_tail": _shape(F.substring("_last", -12, 12)),
            "_head": F.when(brief, F.lower(F.regexp_extract("_last", r"^\s*(\S{1,16})", 1))).otherwise(F.lit("long")),
            "_open": F.concat((count("“") > count("”")).cast("string"), (count("(") > count(")")).cast("string")),
            "_words": F.when(brief, _bucket(F.size(F.split("_last", " ")))).otherwise(F.lit("long")),
            "_lead": F.when(F.col("_last").contains(":"), F.lower(F.regexp_extract("_last", r"^\s*(\w[^:.]{0,23}):\s", 1))).otherwise(F.lit("")),
            "_phrase": F.when(F.length("_last") <= 40, F.lower("_last")).otherwise(F.lit("long")),
        }
    )
    closing = {"_closing": F.substring("_tail", -1, 1), "_closing3": F.substring("_tail", -3, 3)}
    return rows.withColumns(closing).drop("_last", "_tail")


def with_slots(endings: DataFrame, bits: int = BITS) -> DataFrame:
    """``endings`` (:func:`with_endings`, and ``at_limit``) with ``slots``: the hashed features."""
    rows = endings.withColumn("_limit", F.coalesce("at_limit", F.lit(False)).cast("string"))
    values = [F.concat_ws("\u0001", F.lit(name), *[F.col(f"_{n}") for n in name.split()]) for name in FEATURES]
    return rows.withColumn("slots", hashed(values, bits))


def hashed(values: list[Column], bits: int = BITS) -> Column:
    return F.array(*[F.pmod(F.xxhash64(v), F.lit(1 << bits)).cast("int") for v in values])


@dataclass(frozen=True)
class EndingModel:
    """Weights of the hashed features and the intercept, moved to the share of cut texts."""

    weights: tuple[float, ...]
    intercept: float

    def probability(self, slots: Column) -> Column:
        """Probability of a cut, in Arrow batches of hashed slots; no text goes to Python."""
        weights, intercept = np.array(self.weights), self.intercept

        @F.pandas_udf(DoubleType())
        def score(batch: pd.Series) -> pd.Series:
            if batch.empty:
                return pd.Series([], dtype="float64")
            total = weights[np.vstack(batch.to_numpy())].sum(1) + intercept
            return pd.Series(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))

        return score(slots)


def fit_logistic(slots: np.ndarray, labels: np.ndarray, bits: int = BITS, penalty: float = 0.3, rounds: int = 300, least_rows: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on rows of active slots by accelerated gradient descent; deterministic.  Slots of
    fewer than ``least_rows`` rows keep weight 0.  Equal rows, of which endings have many, are computed once, with their number."""
    rows, counts = np.unique(np.column_stack([slots, labels.astype(np.int64)]), axis=0, return_counts=True)
    slots, labels = np.ascontiguousarray(rows[:, :-1]), rows[:, -1].astype(float)
    n, k, size = counts.sum(), slots.shape[1], 1 << bits
    flat, shares = slots.ravel(), counts / n
    seen = np.bincount(flat, np.repeat(counts, k), minlength=size)
    known = seen >= least_rows
    w, b = np.zeros(size), 0.0
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / (k + 1)
    scale = step / np.sqrt(np.maximum(seen / n, 1.0 / n))  # rare features move faster
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(v[slots].sum(1) + vb, -30, 30)))
        error = (p - labels) * shares
        gradient = np.bincount(flat, np.repeat(error, k), minlength=size) + penalty / n * v
        new, new_b = known * (v - scale * gradient), vb - step * error.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return w, b


def _prior_shift(scores: np.ndarray, trained: float) -> float:
    """What to add to the intercept so that the mean probability of the texts as they are equals the assumed share of cut
    ones (expectation maximisation)."""
    share = 0.1
    for _ in range(50):
        shift = np.log(share / (1 - share)) - np.log(trained / (1 - trained))
        p = 1.0 / (1.0 + np.exp(-np.clip(scores + shift, -30, 30)))
        share = float(np.clip(p.mean(), 1e-4, 0.9))
    return float(np.log(share / (1 - share)) - np.log(trained / (1 - trained)))


def _artificial_cuts(texts: DataFrame) -> DataFrame:
    """The texts cut short, ``CUTS`` times each: two of three at one of their source's limits if they are longer, else
    anywhere; one of three gets a mark of omission.  Cuts after the end of a sentence or block are left out."""
    texts = texts.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.lit(CUTS))))
    roll = lambda salt, n: F.pmod(F.xxhash64("doc_id", "_cut", F.lit(salt)), F.lit(n))
    usable = F.filter("limits", lambda x: x < F.col("length") - 1)
    at_limit = (F.size(usable) > 0) & (roll("kind", 3) > 0)
    anywhere = F.lit(30) + F.pmod(F.xxhash64("doc_id", "_cut", F.lit("place")), F.greatest(F.col("length") - 40, F.lit(1)))
    chosen = F.get(usable, F.pmod(F.xxhash64("doc_id", "_cut", F.lit("limit")), F.greatest(F.size(usable), F.lit(1))).cast("int"))
    place = F.when(at_limit, chosen).otherwise(anywhere)
    marks = F.array(*[F.lit(m) for m in MARKS])
    mark = F.when(roll("marked", 3) == 0, F.get(marks, roll("mark", len(MARKS)).cast("int"))).otherwise(F.lit(""))
    cut_at = F.when(at_limit, place - F.length(mark)).otherwise(place).cast("int")
    rows = texts.where(F.col("length") > 80).withColumns({"_mark": mark, "_at": cut_at, "at_limit": at_limit}).where("_at > 20")
    head, rest = F.expr("substring(text, 1, _at)"), F.expr("substring(text, _at + 1, 1)")
    rows = rows.withColumns({"_head": head, "_rest": rest})
    inside = ~F.substring(F.rtrim(F.col("_head"), F.lit(_SPACES)), -1, 1).rlike(_ENDS) & (F.col("_rest") != "\n")
    inside = inside | (F.col("_head").contains("```") & (F.regexp_count(F.col("_head"), F.lit(_FENCE)) % 2 == 1))
    return rows.where(inside).select("doc_id", F.concat("_head", "_mark").alias("text"), "at_limit")


def sampled(texts: DataFrame, total: int, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` of the ``total`` texts: those whose hash is small, spread over tasks again after the limit."""
    part = min(1.0, 0.97 * sample_rows / max(total, 1)) if total > sample_rows else 1.0
    chosen = texts.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) < int(part * (1 << 20)))
    return chosen.limit(sample_rows).repartition(SPREAD, "doc_id")


def fit(texts: DataFrame, bits: int = BITS) -> EndingModel:
    """Fit on ``texts`` (doc_id, text, length, at_limit, limits), a bounded sample, and their artificial cuts.

    The texts as they are count as intact at first; those that a fit takes for cut are left out of the next, twice.
    """
    def slots(rows: DataFrame) -> np.ndarray:
        column = with_slots(with_endings(rows.select("text", "at_limit")), bits).select("slots").toArrow().column(0).combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(FEATURES))

    intact, cuts = slots(texts), slots(_artificial_cuts(texts))
    if len(intact) == 0 or len(cuts) == 0:
        return EndingModel(tuple([0.0] * (1 << bits)), -30.0)
    w, b = fit_logistic(np.vstack([intact, cuts]), np.r_[np.zeros(len(intact)), np.ones(len(cuts))], bits)
    for _ in range(2):
        trusted = intact[w[intact].sum(1) + b < 0]
        if not len(trusted):
            break
        w, b = fit_logistic(np.vstack([trusted, cuts]), np.r_[np.zeros(len(trusted)), np.ones(len(cuts))], bits)
    b += _prior_shift(w[intact].sum(1) + b, len(cuts) / (len(cuts) + max(len(trusted), 1)))
    return EndingModel(tuple(np.round(w, 6).tolist()), float(b))


def truncated_texts(documents: DataFrame, doc_id: str, text: str, source: str, sample_rows: int = SAMPLE_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, source, probability, truncated) for every row of ``documents``.

    Lengths at which texts of a source pile up are found over all rows; the classifier is fitted on a bounded sample and
    scores every row.  Only how a text ends leaves the scan, never the text.  A text that opens a code block and doesn't close
    it is cut whatever its score.  Null, empty and blank texts are whole.  Repeated rows stay repeated.  An empty table gives
    an empty result.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source), F.lit("")).alias("_source"), F.col(source).alias("source"), F.col(text).alias("text"))
    rows = rows.withColumn("length", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    counts = cut(rows.where("length > 0").groupBy("_source", "length").agg(F.count(F.lit(1)).alias("n")))
    limits = length_limits(counts, "_source", "length", "n")
    per_source = cut(limits.groupBy("_source").agg(F.sort_array(F.collect_list("length")).alias("limits")))
    at_limit = F.array_contains(F.col("limits"), F.col("length"))
    known = lambda frame: frame.withColumn("limits", F.coalesce("limits", F.array().cast("array<bigint>"))).withColumn("at_limit", at_limit)
    total = counts.agg(F.sum("n")).first()[0] or 0
    sample = cut(sampled(rows.where("length > 0"), total, sample_rows))  # written once, read for the texts and for their cuts
    model = fit(known(sample.join(per_source, "_source", "left")))
    hot = counts.groupBy("_source").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_rows).orderBy(F.desc("n"), "_source").limit(MAX_HOT).select("_source")
    shaped = skew_join(with_endings(rows), per_source, ["_source"], "left", ["doc_id"], hot)
    scored = with_slots(known(shaped)).withColumn("_score", model.probability(F.col("slots")))
    probability = F.when(F.coalesce("_empty", F.lit(True)), F.lit(0.0)).when(F.col("_fence") == "true", F.lit(1.0)).otherwise(F.col("_score"))
    return scored.select("doc_id", "source", probability.alias("probability"), (probability >= 0.5).alias("truncated"))


def truncation_shares(scored: DataFrame) -> DataFrame:
    """(source, documents, truncated, share) of :func:`truncated_texts`."""
    counts = scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return counts.withColumn("share", F.col("truncated") / F.col("documents"))
