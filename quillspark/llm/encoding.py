"""Problem 7: token ids of the whole corpus with a public tokenizer.

A bounded-lookahead streaming transducer.  A text is read in slices, cut where the
pre-tokenizer must cut whatever follows (before the first white space after a mark),
so everything to the left is stable; the pre-tokens of a slice go one by one through the
merge list.  A pre-token beyond the window is streamed: the merge list's own lookahead
tells how many bytes to the right can still change a token, and tokens further left than
that are emitted at once.  Memory is constant: one slice, one window, and
a bounded table of the pre-tokens met before, which are the same every time.

``documents`` rows keep their count: NULL and empty texts both have the empty list.
Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = os.environ.get("QUILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"
SLICE = 1 << 16
WINDOW = 1 << 12  # bytes of a pre-token that are merged at a time; well over the lookahead
KNOWN = 1 << 18  # pre-tokens kept, of at most KNOWN_LENGTH characters each
KNOWN_LENGTH = 48

#: Fixed value: the pre-tokenizer of the byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPLIT = regex.compile(PATTERN)
# White space after a mark: the pre-tokenizer always cuts in front of it.
_SAFE = re.compile(r"(?<=\S)(?=\s)")


def merge_lookahead(ranks: dict[bytes, int]) -> int:
    """Bytes to the right of a token that can still change it.

    A merge of ``a b`` hangs on an earlier merge that takes the right edge of ``b``
    away with ``c``; that one hangs on what may take the right edge of ``c``, and so
    on, always with earlier merges. Going through the merges by rank, the longest such
    chain is one look-up per part of the right edge.
    """
    parts: dict[bytes, tuple[bytes, bytes]] = {}
    edges: dict[bytes, tuple[bytes, ...]] = {}
    best: dict[bytes, int] = {}
    longest = 0

    def edge(token: bytes) -> tuple[bytes, ...]:
        if token not in edges:
            edges[token] = (token, *edge(parts[token][1])) if token in parts else (token,)
        return edges[token]

    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        pair = _last_merge(token, ranks, rank)
        if pair is None:
            continue
        parts[token] = pair
        left, right = pair
        reach = max((best.get(t, 0) for t in edge(right)), default=0)
        for t in edge(left):
            if t == left:
                best[t] = max(best.get(t, 0), len(right) + reach)
        longest = max(longest, len(right) + reach)
    return longest


def _last_merge(token: bytes, ranks: dict[bytes, int], below: int) -> tuple[bytes, bytes] | None:
    parts = merge(token, ranks, below)
    return (parts[0], parts[1]) if len(parts) == 2 else None


def merge(word: bytes, ranks: dict[bytes, int], below: int = 1 << 30) -> list[bytes]:
    """Byte pair merging by a heap: always the merge of lowest rank, then the leftmost; only ranks under ``below``."""
    n = len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n))  # part i is word[i:after[i]]; a merged one has after -1
    heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := ranks.get(word[i : i + 2], below)) < below]
    heapify(heap)
    while heap:
        _, i, end = heappop(heap)
        j = after[i]
        if not i < j < n or after[j] != end:  # one of the two parts is merged by now
            continue
        after[i], after[j], before[end] = end, -1, i
        if end < n and (rank := ranks.get(word[i : after[end]], below)) < below:
            heappush(heap, (rank, i, after[end]))
        if i and (rank := ranks.get(word[before[i] : end], below)) < below:
            heappush(heap, (rank, before[i], end))
    out, i = [], 0
    while i < n:
        out.append(word[i : after[i]])
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one byte-level vocabulary."""

    def __init__(self, path: str, window: int = WINDOW) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.window = window
        self.known: dict[str, tuple[int, ...]] = {}
        self._lookahead: int | None = None

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = merge_lookahead(self.ranks)
        return self._lookahead

    def encode_word(self, word: bytes) -> Iterator[int]:
        """Ids of one pre-token, emitted as soon as they are stable."""
        ranks, at = self.ranks, 0
        while len(word) - at > self.window:
            window = max(self.window, 2 * self.lookahead)
            piece = word[at : at + window]
            if at + len(piece) == len(word):
                break
            done, stable = 0, len(piece) - self.lookahead
            for part in merge(piece, ranks):
                if done + len(part) > stable:
                    break
                yield ranks[part]
                done += len(part)
            at += done
        for part in merge(word[at:], ranks):
            yield ranks[part]

    def slices(self, text: str) -> Iterator[str]:
        """Slices that the pre-tokenizer never joins."""
        at = 0
        while len(text) - at > SLICE:
            m = _SAFE.search(text, at + SLICE // 2)
            if not m:
                break
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def words(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of each pre-token, in order."""
        known = self.known
        for piece in self.slices(text):
            for word in _SPLIT.findall(piece):
                ids = known.get(word)
                if ids is None:
                    ids = tuple(self.encode_word(word.encode()))
                    if len(word) <= KNOWN_LENGTH:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[word] = ids
                yield ids

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.words(text))) if text else []

    def count(self, text: str | None) -> int:
        """Number of tokens, without keeping them."""
        return sum(map(len, self.words(text))) if text else 0

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as far as it is complete; a character cut by a token waits for its rest."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if text := state.decode(self.bytes_of[i]):
                yield text
        if text := state.decode(b"", final=True):
            yield text

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per Python worker."""
    return Codec(path)


def tokenizer_path(name: str = BYTE_BPE, folder: str | None = None) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def encode_corpus(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids ARRAY<INT>``: one row per row of ``df``, in constant memory a row.

    NULL and empty texts give the empty list. Other columns are ignored.
    """
    path = path or tokenizer_path()
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            ids = [np.asarray(c.encode(t), np.int32) for t in pdf["t"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "ids": ids})

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInPandas(run, f"doc_id {kind}, ids array<int>")


def token_counts(df: DataFrame, text: str, out: str = "tokens", path: str | None = None) -> DataFrame:
    """``df`` with the number of tokens of ``text`` (0 for NULL and empty)."""
    path = path or tokenizer_path()

    @F.pandas_udf("bigint")
    def count(values: pd.Series) -> pd.Series:
        c = codec(path)
        return values.map(c.count)

    return df.withColumn(out, count(F.coalesce(F.col(text), F.lit(""))))


def decode_corpus(df: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, text`` from ids; a NULL list gives the empty text."""
    path = path or tokenizer_path()
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        for pdf in batches:
            texts = ["" if v is None else c.decode(v.tolist()) for v in pdf["i"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": texts})

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("i"))
    return rows.mapInPandas(run, f"doc_id {kind}, text string")
