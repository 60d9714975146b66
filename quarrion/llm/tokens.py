"""Token counts and offsets by a public byte-level tokenizer.

The vocabulary file is a parameter; nothing of it is kept in this repository. A worker process loads it once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE in ranks form; see README.md beside it.
VOCABULARY = os.path.join(os.environ.get("QUARRION_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: The pattern that the vocabulary's own tokenizer divides texts by (fixed value of the published tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer:
    """Encodes whole texts; special tokens' strings are ordinary text."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            os.path.basename(vocabulary), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int32)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except UnicodeEncodeError:  # lone surrogates
            return self.encoding.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def boundaries(self, text: str) -> np.ndarray:
        """Code-point offset at which each token begins, and the text's length at the end.

        A token that begins inside a character is given -1: a text can't be cut there.
        """
        ids = np.asarray(self.encode(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = np.concatenate(([0], ends)).astype(np.int64)
        if text.isascii():
            return starts
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        lead = (raw & 0xC0) != 0x80
        chars = np.concatenate((np.cumsum(lead) - 1, [len(text)]))
        cut = np.concatenate((lead, [True]))
        starts = np.minimum(starts, len(raw))
        return np.where(cut[starts], chars[starts], -1)


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str = VOCABULARY) -> Tokenizer:
    """The tokenizer of one vocabulary file, loaded once in a process."""
    return Tokenizer(vocabulary)


def with_token_counts(df: DataFrame, text_col: str, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` without its text but with the text's token count; a null text counts 0. The text never leaves its task."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tokenizer(vocabulary)
        for texts in batches:
            yield pd.Series([coder.count(x) if isinstance(x, str) else 0 for x in texts], dtype="int32")

    return df.withColumn(name, count(F.col(text_col))).drop(text_col)
