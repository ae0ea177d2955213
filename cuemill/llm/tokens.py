"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Fixed value: the splitting pattern that belongs to the public rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str, out: str = "tokens", tokenizer: str = TOKENIZER) -> DataFrame:
    """Replaces the text column by its size; null and empty texts have size 0.

    Repeated texts within a batch are encoded once.
    """
    others = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(out, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for batch in batches:
            texts = batch.column(len(others)).dictionary_encode()
            sizes = pa.array([len(encode(t)) for t in texts.dictionary.to_pylist()], pa.int64())
            size = pc.fill_null(sizes.take(texts.indices), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], size], names=[*others, out])

    return df.select(*others, F.col(text)).mapInArrow(count, schema)
