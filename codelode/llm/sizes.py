"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

#: A rank file (base64 token and rank a line) that every executor can read.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_sizes(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, source, tokens, weight)`` of each text, once per ``doc_id``.

    ``weight`` is a plain measure of quality in (0, 1]: the share of distinct tokens, which
    repetitive text lowers; 0 for a text without tokens. Null texts count as empty, null ids are left out. The whole text is encoded, where it is read.
    """
    rows = documents.where("doc_id is not null").select("doc_id", "source", "text")
    sized = rows.mapInArrow(_size_rows(ranks), "doc_id long, source string, tokens long, weight double")
    return sized.dropDuplicates(["doc_id"])


def _size_rows(ranks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks).encode_ordinary
        for b in batches:
            sizes, weights = [], []
            for text in b.column(2).to_pylist():
                found = encode(text) if text else []
                sizes.append(len(found))
                weights.append(len(set(found)) / len(found) if found else 0.0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())],
                names=["doc_id", "source", "tokens", "weight"],
            )

    return run
