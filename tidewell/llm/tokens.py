"""Token counts with a public tokenizer, read from a vocabulary file on each executor."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def default_path() -> str:
    """The vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a ``.tiktoken`` file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of whole texts; NULL and empty texts have 0 tokens."""
    path = tokenizer or default_path()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return documents.select("doc_id", "source", "text").mapInArrow(go, "doc_id bigint, source string, n_tokens bigint")
