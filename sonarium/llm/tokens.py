"""Token ids of whole corpora under a public byte-level tokenizer, and the way back."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rank file of the tokenizer; the same path must exist on every executor.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts longer than this many characters are encoded in parts.
LONG = 8192
#: A place where a part may begin: one blank between two characters that are not white space. No pre-token crosses it, and
#: neither side looks past it, so the parts' ids joined are the whole text's ids.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(ranks: str = RANKS):
    """The tokenizer of a rank file, built once per Python worker."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, long: int = LONG) -> list[str]:
    """``text`` cut at safe places into parts of about ``long`` characters; a stretch without a safe place stays whole."""
    found, begin = [], 0
    while len(text) - begin > long:
        cut = _SAFE.search(text, begin + long)
        if not cut:
            break
        found.append(text[begin : cut.start()])
        begin = cut.start()
    found.append(text[begin:])
    return found


def encode(text: str | None, ranks: str = RANKS) -> np.ndarray:
    """Ids of one text, without special tokens; null and empty texts have none."""
    if not text:
        return np.empty(0, np.uint32)
    encoder = encoding(ranks)
    if len(text) <= LONG:
        return encoder.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([encoder.encode_to_numpy(p, disallowed_special=()) for p in parts(text)])


def decode(ids, ranks: str = RANKS) -> str | None:
    """The text of ids: the tokens' raw bytes joined, then read as UTF-8, so that a character split over tokens comes back whole."""
    return None if ids is None else encoding(ranks).decode_bytes(list(ids)).decode("utf-8", "replace")


def encode_column(df: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """``(key, ids array<int>)`` of every row: the ids of the whole text; an empty list for null and empty texts.

    One narrow pass over Arrow batches, no shuffle. Repeated rows are encoded again; only the two columns are read.
    """

    def run(batches):
        for batch in batches:
            ids = [encode(t.as_py(), ranks) for t in batch.column(1)]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) for i in ids], out=ends[1:])
            values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str, text: str, ranks: str = RANKS) -> DataFrame:
    """``(key, n_tokens int)`` of every row, 0 for null and empty texts; only the counts leave the Python workers."""

    def run(batches):
        for batch in batches:
            counts = np.fromiter((len(encode(t.as_py(), ranks)) for t in batch.column(1)), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens int")


def decode_column(df: DataFrame, key: str, ids: str, ranks: str = RANKS) -> DataFrame:
    """``(key, text)``: the inverse of encode_column; an empty list gives an empty text, null gives null."""

    def run(batches):
        for batch in batches:
            texts = [decode(i, ranks) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = dict(df.dtypes)[key]
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
