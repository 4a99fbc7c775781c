"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end the encoding of
that prefix.  Storing that token per prefix gives an encoder whose state can be
extended byte by byte (exact appends), resumed after an edit, and shared
between all strings that begin alike.  A token may follow another exactly when
merging their bytes together never joins a symbol of the one with a symbol of
the other; the order of merges along the facing edges of both tokens decides it.

Rows: null text counts as empty; an empty text has no tokens, an empty id list
and decodes to empty bytes.  Very long texts are encoded whole, chunk by chunk of the
pattern; repeated rows give repeated results; other columns, whatever their names,
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_tool

#: Entries that a Python worker keeps of each memo (prefixes, chunks); beyond it work is done again, results are the same.
MEMO_ENTRIES = 300_000

_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class PrefixEncoder:
    """BPE over ranks; ``last`` of a prefix is the rank of the token that ends it."""

    def __init__(self, ranks: dict[bytes, int], memo_entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.ends = {b[i:] for b in ranks for i in range(len(b))}
        self.limit = memo_entries
        self._split: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[tuple[int, int], list[int]] = {}
        self._follows: dict[int, bool] = {}
        self._prefix: dict[bytes, int] = {}

    # -- merges -----------------------------------------------------------
    def merged(self, data: bytes) -> list[tuple[int, tuple[int, int] | None]]:
        """Plain BPE: join the lowest-ranked neighbours, leftmost first, until none can be joined; each result with its two parts."""
        parts: list[tuple[int, tuple[int, int] | None]] = [(self.ranks[data[i : i + 1]], None) for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(self.bytes_of[a[0]] + self.bytes_of[b[0]], _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == _NEVER:
                break
            parts[at : at + 2] = [(best, (parts[at][0], parts[at + 1][0]))]
        return parts

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that BPE joins last to make this one; itself twice if BPE never makes it; None for a byte."""
        if token not in self._split:
            parts = self.merged(self.bytes_of[token])
            self._split[token] = parts[0][1] if len(parts) == 1 else (token, token)
        return self._split[token]

    def reachable(self, token: int) -> bool:
        return self.split(token) != (token, token)

    def edge(self, token: int, side: int) -> list[int]:
        """Symbols at the left (0) or right (1) edge of a token in the order in which merging makes them, the token last."""
        if (token, side) not in self._edges:
            out = [token]
            while (pair := self.split(out[-1])) is not None:
                out.append(pair[side])
            self._edges[token, side] = out[::-1]
        return self._edges[token, side]

    def follows(self, first: int, second: int) -> bool:
        """Whether the encoding of the bytes of both tokens is just these two."""
        key = first << 32 | second
        if (known := self._follows.get(key)) is not None:
            return known
        out = self.reachable(second) and self._stay_apart(self.edge(first, 1), self.edge(second, 0))
        if len(self._follows) < 2 * self.limit:
            self._follows[key] = out
        return out

    def _stay_apart(self, left: list[int], right: list[int]) -> bool:
        if any(a >= b for x in (left[1:], right[1:]) for a, b in zip(x, x[1:])):  # merges not in order of rank: do it in full
            parts = self.merged(self.bytes_of[left[-1]] + self.bytes_of[right[-1]])
            return [p[0] for p in parts] == [left[-1], right[-1]]
        i = j = 0
        while True:
            next_left = left[i + 1] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1] if j + 1 < len(right) else _NEVER
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], _NEVER)
            if across < next_left and across <= next_right and across != _NEVER:
                return False
            if next_left == next_right == _NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    # -- prefixes ---------------------------------------------------------
    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding of data[:end]; last has those of the shorter prefixes."""
        found = []
        for start in range(end - 1, -1, -1):
            piece = data[start:end]
            if piece not in self.ends:
                break
            if (token := self.ranks.get(piece)) is not None:
                found.append((start, token))
        for start, token in reversed(found):
            if self.reachable(token) if start == 0 else self.follows(last[start], token):
                return token
        raise ValueError(f"no token ends {data[:end]!r}")

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """last[i] for every i up to len(data) (last[0] is unused), going on from a given start of the list."""
        last = [-1] if last is None else last
        memo = self._prefix
        for end in range(len(last), len(data) + 1):
            token = memo.get(data[:end]) if end <= 64 else None
            last.append(self.last_token(data, end, last) if token is None else token)
        return last

    def ending(self, data: bytes) -> int:
        """last_token of all of data; of the shorter prefixes only those are worked out that a token at the end can follow."""
        memo, ranks, ends, follows = self._prefix, self.ranks, self.ends, self._follows
        start, found = len(data) - 1, []
        piece = data[start:]
        while piece in ends:
            if piece in ranks:
                found.append(start)
            if start == 0:
                break
            start -= 1
            piece = data[start:]
        for start in reversed(found):
            token = ranks[data[start:]]
            if start == 0:
                good = self.reachable(token)
            else:
                head = data[:start]
                if (before := memo.get(head)) is None:
                    before = self.ending(head)
                if (good := follows.get(before << 32 | token)) is None:
                    good = self.follows(before, token)
            if good:
                if len(memo) < self.limit:
                    memo[data] = token
                return token
        raise ValueError(f"no token ends {data!r}")

    def tokens(self, last: list[int]) -> list[int]:
        out, end = [], len(last) - 1
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        if len(data) > 64:  # every prefix in turn: no deep recursion
            return self.tokens(self.prefixes(data))
        out, memo = [], self._prefix
        while data:
            if (token := memo.get(data)) is None:
                token = self.ending(data)
            out.append(token)
            data = data[: -len(self.bytes_of[token])]
        return out[::-1]

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact: the state of data + more from the state of data, at the cost of more."""
        return data + more, self.prefixes(data + more, last[:])

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The state after data[start:stop] becomes new.  Prefixes before the edit stay; behind it, once as many
        consecutive last tokens as the longest token has bytes equal the old ones and begin behind the edit, so do all later ones."""
        out, kept = data[:start] + new + data[stop:], last[: start + 1]
        shift, same, longest = len(new) - (stop - start), 0, max(map(len, self.ranks))
        for end in range(start + 1, len(out) + 1):
            token = self.last_token(out, end, kept)
            kept.append(token)
            begins_behind = end - len(self.bytes_of[token]) >= start + len(new)
            same = same + 1 if begins_behind and token == last[end - shift] else 0
            if same >= longest:
                return out, kept + last[end - shift + 1 :]
        return out, kept

    def decode(self, tokens: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of[t] for t in tokens)


class TextEncoder:
    """Splits texts by the pattern and encodes each match by itself.

    A space that stands alone before other text begins a match of its own, so
    texts are cut there and the chunks' ids are kept; texts with longer runs of
    white space around a space are matched whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_entries: int = MEMO_ENTRIES):
        self.bpe = PrefixEncoder(ranks, memo_entries)
        self.pattern = regex.compile(pattern)
        self.runs = regex.compile(r"\s \s")
        self.limit = memo_entries
        self._chunks: dict[str, str] = {}
        self._tails: dict[str, str] = {}
        self._by_name = {str(r): b for r, b in self.bpe.bytes_of.items()}

    def ids(self, text: str) -> str:
        """Decimal ids joined by one space, the form in which they are kept and hashed."""
        return " ".join(str(t) for m in self.pattern.findall(text) for t in self.bpe.encode(m.encode()))

    def _letters(self, word: str) -> str:
        return " ".join(map(str, self.bpe.encode(b" " + word.encode())))

    def _keep(self, chunk: str, ids: str) -> str:
        if len(self._chunks) < self.limit:
            self._chunks[chunk] = ids
        return ids

    def encode(self, text: str) -> str:
        if self.runs.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        memo, out = self._chunks, [self.ids(first)] if first else []
        for chunk in rest:
            if (ids := memo.get(chunk)) is None:
                word = chunk.rstrip(".,!?:;")
                if word != chunk and word.isascii() and word.isalpha():  # then the marks behind it match by themselves
                    if (ids := memo.get(word)) is None:
                        ids = self._keep(word, self._letters(word))
                    out.append(ids)
                    tail = chunk[len(word) :]
                    ids = self._tails.get(tail) or self._tails.setdefault(tail, self.ids(tail)) if len(tail) < 3 else self.ids(tail)
                else:
                    ids = self._keep(chunk, self._letters(chunk) if chunk.isascii() and chunk.isalpha() else self.ids(" " + chunk))
            out.append(ids)
        return " ".join(out)

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self._by_name.__getitem__, ids.split()))


def encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return only_tool(("encoder", path, pattern), lambda: TextEncoder(read_ranks(path), pattern))


def digest_column(text: Column, path: str, pattern: str) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256, exact): the ids are made, decoded again and digested in one pass."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                ids = enc.encode(t)
                back = enc.decode(ids)
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), back == t.encode()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    return digest(text)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", verify: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens and both digests; with verify a text that does not come back from its ids is an error."""
    out = docs.select(F.col(id_col), digest_column(F.col(text_col), path, pattern).alias("d"))
    decoded = F.when(F.col("d.exact"), F.col("d.decoded_sha256")).otherwise(F.raise_error(F.lit("a text does not come back from its ids"))) if verify else F.col("d.decoded_sha256")
    return out.select(id_col, "d.n_tokens", "d.ids_sha256", decoded.alias("decoded_sha256"))
