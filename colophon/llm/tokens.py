"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rank file of a byte-level BPE, the same on every machine.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of this file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def tokenizer(ranks: str = RANKS, pattern: str = PATTERN):
    """The encoder of a rank file, loaded once per Python worker."""
    import tiktoken

    lines = Path(ranks).read_bytes().splitlines()
    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    return tiktoken.Encoding(Path(ranks).stem, pat_str=pattern, mergeable_ranks=merges, special_tokens={})


#: Longer texts are counted piece by piece; pieces end before a space, where this pattern lets no token span.
PIECE = 200_000


def count_tokens(text: str | None, ranks: str = RANKS) -> int:
    """Tokens of a whole text; null and empty texts have none."""
    if not text:
        return 0
    encoder = tokenizer(ranks)
    if len(text) <= PIECE:
        return len(encoder.encode_ordinary(text))
    total, start = 0, 0
    while start < len(text):
        end = min(len(text), start + PIECE)
        while end < len(text) and not (text[end] == " " and text[end - 1 : end].isalnum()):
            end += 1
            if end - start > 2 * PIECE:
                break
        total += len(encoder.encode_ordinary(text[start:end]))
        start = end
    return total


def with_token_counts(rows: DataFrame, text: str, ranks: str = RANKS, name: str = "n_tokens") -> DataFrame:
    """``rows`` with ``name`` in place of ``text``, in Arrow batches; the other columns pass as they are."""
    kept = [f.name for f in rows.schema.fields if f.name != text]
    schema = StructType([*(f for f in rows.schema.fields if f.name != text), StructField(name, LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.array([count_tokens(t, ranks) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sizes], names=[*kept, name])

    return rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(count, schema)
