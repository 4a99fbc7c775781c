"""Tokens of public vocabularies for whole texts, by their own libraries; models are loaded once in a worker."""

from __future__ import annotations

import hashlib

import numpy as np
import sentencepiece
import tiktoken

from .common import only_tool
from .prefix_bpe import read_ranks


def file_digest(path: str, *options: str) -> str:
    """Of a tokenizer's version: its file, its library and the options."""
    with open(path, "rb") as data:
        return hashlib.sha256(data.read() + "\0".join(options).encode()).hexdigest()


class PieceCounter:
    """Numbers of tokens of a sentencepiece model."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


class TwoVocabularies:
    """Ids by a sentencepiece model and numbers of tokens by byte-level BPE ranks."""

    def __init__(self, model_path: str, ranks_path: str, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    def measure(self, text: str) -> tuple[np.ndarray, int]:
        """Counts by id of the first vocabulary's tokens; the number of the second's."""
        return np.bincount(np.array(self.model.encode(text), np.int64), minlength=len(self.fallback)), len(self.ranks.encode_ordinary(text))


def piece_counter(path: str) -> PieceCounter:
    """One for each Python worker."""
    return only_tool(("count", path), lambda: PieceCounter(path))


def two_vocabularies(model_path: str, ranks_path: str, pattern: str) -> TwoVocabularies:
    return only_tool(("two", model_path, ranks_path, pattern), lambda: TwoVocabularies(model_path, ranks_path, pattern))
