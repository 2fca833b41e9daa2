"""A public byte-level BPE tokenizer for Spark workers.

The vocabulary file is read once on the driver and sent as a Spark broadcast (under 1 MB, whatever the data); each
Python worker builds the encoder once. The files' folder is a parameter and nothing of them is kept in the repository.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import SparkSession

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("PUBSCOPE_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRE_TOKEN = regex.compile(PATTERN)

#: Most pre-tokens that a worker remembers; a pure memo, results don't depend on it.
MEMO = 200_000

_ENCODERS: dict[int, "Encoder"] = {}


class Encoder:
    """Token ids and counts of texts and pre-tokens, without special tokens."""

    def __init__(self, vocabulary: bytes) -> None:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.piece = lru_cache(MEMO)(self._piece)

    def ids(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def _piece(self, pre_token: str) -> tuple[int, ...]:
        return tuple(self.bpe.encode_ordinary(pre_token))


def vocabulary(spark: SparkSession, folder: str | None = None, name: str = BYTE_BPE) -> Broadcast:
    """The broadcast bytes of a vocabulary file."""
    with open(os.path.join(folder or TOKENIZERS, name), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(vocab: Broadcast | bytes) -> Encoder:
    """The worker's encoder of a vocabulary."""
    data = vocab if isinstance(vocab, bytes) else vocab.value
    key = zlib.crc32(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(data)
    return _ENCODERS[key]
