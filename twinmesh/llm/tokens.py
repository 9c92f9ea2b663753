"""Token counts by a public tokenizer, whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from twinmesh.session import ship

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The file of one of the installed public vocabularies; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The byte-pair encoding of a file of ranks; loaded once per worker process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, schema: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """df, whose last column is the text, with n_tokens (int) in its place, of whole texts. A null text has
    no tokens. ``schema`` is that of the columns before the text."""
    ship(df.sparkSession)
    names = df.columns[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer_path(tokenizer)).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int32())], names=[*names, "n_tokens"])

    return df.mapInArrow(count, f"{schema}, n_tokens int")
