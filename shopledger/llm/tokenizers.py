"""Two kinds of public tokenizers inside Spark tasks: token ids and the bytes that each token stands for.

The files are read on the driver and broadcast; their size is fixed. Nothing is trained.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np
from pyspark.sql import SparkSession

from .bpe import _byte_letters


class ByteTokens:
    """Byte-level BPE of a ``tokenizers`` file; the strings of special tokens are plain text.

    The merges of such a file are listed in the order of the ids they make, so the ids are the ranks of the
    merges; a file of another kind is refused.
    """

    def __init__(self, file: bytes, pattern: str):
        import tiktoken

        model, letters = json.loads(file)["model"], _byte_letters()
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        special = {t["content"] for t in json.loads(file)["added_tokens"]}
        spelled = {bytes(letters[c] for c in name): i for name, i in model["vocab"].items() if name not in special}
        ranks = [model["vocab"][m] for m in merges]
        if model["type"] != "BPE" or ranks != sorted(ranks) or len(spelled) != len(merges) + 256:
            raise ValueError("not a byte-level BPE file whose ids follow its merges")
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=spelled, special_tokens={})
        self.spelled = [b""] * (max(spelled.values()) + 1)
        for piece, i in spelled.items():
            self.spelled[i] = piece

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(t) for t in texts]


class PieceTokens:
    """A ``sentencepiece`` model; it puts a space before every text."""

    def __init__(self, file: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.spelled = [self._bytes(i) for i in range(self._model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self._model.id_to_piece(i)
        if self._model.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


_made = functools.lru_cache(4)(lambda kind, *given: kind(*given))


class Tokenizer:
    """A tokenizer file on its way to the executors; ``model()`` builds it once in each worker."""

    def __init__(self, spark: SparkSession, kind: type, path: str, *given: str):
        with open(path, "rb") as file:
            self._file = spark.sparkContext.broadcast(base64.b64encode(file.read()))
        self._kind, self._given = kind, given

    def model(self):
        return _made(self._kind, base64.b64decode(self._file.value), *self._given)

    def __getstate__(self):
        return self.__dict__


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    out = np.empty(int(sizes.sum()), np.int32)
    at = 0
    for own in ids:
        out[at : at + len(own)] = own
        at += len(own)
    return out, sizes
