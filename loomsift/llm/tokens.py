"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public tokenizers' files are; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies split text before merging. Fixed value of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The encoder of a ranks file, once for each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text))


def _scan(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            at = b.schema.get_field_index("text")
            sizes = pa.array([len(encode(x)) for x in b.column(at).to_pylist()], pa.int64())
            keep = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), sizes], [*(b.schema.field(i).name for i in keep), "tokens"])

    return run


def sized(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """The rows with a text, its column ``text`` replaced by ``tokens``."""
    some = texts.where("text is not null")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields if f.name != "text")
    return some.mapInArrow(_scan(path), f"{fields}, tokens bigint")
