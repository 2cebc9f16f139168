"""Token ids of whole texts by a public byte-level BPE, with forced boundaries.

A pair of bytes that occurs inside no vocabulary token can never be joined by a merge, so there is always a token
boundary between the two. What lies on either side can be encoded on its own if the pre-tokeniser treats it alike without
the other side: where the first byte is a visible ASCII character and the second white space, it cuts there in any
context; where both are ASCII letters or digits, it has them in one run or cuts between them, and either half of a run is a
run. Every text is cut at all such places, so one without spaces is cut as well, each distinct fragment of a batch is
encoded once, and the ids are put together again.

Defined results: null and empty texts have an empty list of ids; strings that look like special tokens are ordinary
text; texts may be of any length, as only fragments are encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ROWS = 200_000


@lru_cache(maxsize=4)
def _load(path: str):
    """The encoder and the table of byte pairs that certainly cut."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    inside = np.zeros((256, 256), bool)
    for token in ranks:
        b = np.frombuffer(token, np.uint8)
        inside[b[:-1], b[1:]] = True
    certain = np.zeros((256, 256), bool)
    certain[0x21:0x7F, [0x09, 0x0A, 0x0D, 0x20]] = True
    word = np.zeros(256, bool)
    word[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]] = True
    certain |= word[:, None] & word[None, :]
    certain &= ~inside
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), certain


def cut_places(data: bytes, certain: np.ndarray) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.flatnonzero(certain[b[:-1], b[1:]]) + 1 if len(b) > 1 else np.empty(0, np.int64)


def encode_texts(texts: pd.Series, path: str, cache: dict[bytes, list[int]]) -> Iterator[np.ndarray]:
    encoder, certain = _load(path)
    for text in texts:
        if text is None or text == "":
            yield np.empty(0, np.int32)
            continue
        data = text.encode("utf-8", "surrogatepass")
        ids: list[int] = []
        at = 0
        for end in [*cut_places(data, certain).tolist(), len(data)]:
            piece = data[at:end]
            known = cache.get(piece)
            if known is None:
                known = encoder.encode_ordinary(piece.decode("utf-8", "replace"))
                if len(piece) < 64:  # long fragments hardly come again
                    if len(cache) >= CACHE_ROWS:
                        cache.clear()
                    cache[piece] = known
            ids += known
            at = end
        yield np.asarray(ids, np.int32)


def token_ids(text: Column | str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """array<int> of a text column; never null."""
    path = f"{tokenizer_dir}/{vocabulary}"

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[bytes, list[int]] = {}
        for texts in batches:
            yield pd.Series(list(encode_texts(texts, path, cache)), dtype=object)

    return encode(text)


def token_count(text: Column | str, tokenizer_dir: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids of a text column; only the numbers go back to the JVM."""
    path = f"{tokenizer_dir}/{vocabulary}"

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache: dict[bytes, list[int]] = {}
        for texts in batches:
            yield pd.Series([len(x) for x in encode_texts(texts, path, cache)], dtype="int64")

    return count(text)
