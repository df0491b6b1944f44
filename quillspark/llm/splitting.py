"""Problem 5: splitting oversized items at natural boundaries.

A text over the limit goes down a hierarchy of separators (section, paragraph, line,
sentence, word, character) only as far as it must; the parts are packed greedily
up to the limit, and each piece begins with trailing parts of the one before it, up to the
overlap.  Every piece is an exact slice of the text.

Only texts longer than the limit in characters go to Python: a token has at least
one character, so the filter loses nothing.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import _ATOM, count_tokens, py_atom_cost
from .sentences import split_batch

MAX_TOKENS = 800
OVERLAP_TOKENS = 100

_SECTION = re.compile(r"^(?=\s{0,3}#{1,6}\s+\S)", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\r\n|[\r\n\u2028\u2029]")
_WORD = re.compile(r"\s+")

SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = range(6)


@dataclass
class Piece:
    start: int
    end: int
    tokens: int
    overlap: int
    level: int  # the finest separator that was needed for it


class Counted:
    """Token counts of slices of one text, whose atoms are looked up once."""

    def __init__(self, text: str) -> None:
        self.text = text
        atoms = list(_ATOM.finditer(text))
        self.starts, self.ends = [m.start() for m in atoms], [m.end() for m in atoms]
        self.upto = [0, *accumulate(py_atom_cost(m.group()) for m in atoms)]

    def __call__(self, start: int, end: int) -> int:
        i, j = bisect_left(self.starts, start), bisect_left(self.starts, end)
        n = self.upto[j] - self.upto[i]
        if j > i and self.ends[j - 1] > end:  # the last atom is cut
            n += py_atom_cost(self.text[self.starts[j - 1] : end]) - (self.upto[j] - self.upto[j - 1])
        if i and self.ends[i - 1] > start:  # begins within an atom
            n += py_atom_cost(self.text[start : min(end, self.ends[i - 1])])
        return n


def _cuts(text: str, level: int, start: int, end: int, units: list[tuple[int, int]]) -> list[int]:
    if level == SENTENCE:
        return [a for a, _ in units if start < a < end]
    pattern = (_SECTION, _PARAGRAPH, _LINE, None, _WORD)[level]
    return [m.end() for m in pattern.finditer(text, start, end) if start < m.end() < end]


def _characters(text: str, start: int, end: int, tokens: int, count: Counted) -> list[tuple[int, int]]:
    """Runs of about ``tokens`` tokens that never separate a mark from its base."""
    out, at = [], start
    while at < end:
        stop = min(end, at + 4 * tokens)
        while count(at, stop) > tokens and stop - at > 1:
            stop = at + max(1, (stop - at) * 3 // 4)
        while stop < end and (unicodedata.combining(text[stop]) or unicodedata.category(text[stop])[0] == "M" or text[stop] in "\u200d\ufe0f"):
            stop += 1
        out.append((at, stop))
        at = stop
    return out


def parts(text: str, limit: int, overlap: int, units: list[tuple[int, int]], count: Counted) -> list[tuple[int, int, int, int]]:
    """``start, end, tokens, level`` of parts within the limit, in order, without gaps."""
    out: list[tuple[int, int, int, int]] = []

    def down(start: int, end: int, level: int) -> None:
        tokens = count(start, end)
        if tokens <= limit:
            out.append((start, end, tokens, max(level - 1, SECTION)))  # the separator that cut it
            return
        if level == CHARACTER:
            step = max(1, min(limit, (overlap or limit) // 4 or 1))
            for a, b in _characters(text, start, end, step, count):
                out.append((a, b, count(a, b), CHARACTER))
            return
        edges = [start, *_cuts(text, level, start, end, units), end]
        for a, b in zip(edges, edges[1:], strict=False):
            down(a, b, level + 1)

    down(0, len(text), SECTION)
    return out


def _fine(text: str, whole: list[tuple[int, int, int, int]], overlap: int, units, count: Counted) -> list[tuple[int, int, int, int]]:
    """Parts longer than the overlap are opened down to sentences, to have something to carry."""
    out = []
    for start, end, tokens, level in whole:
        if tokens <= overlap or level > SENTENCE:
            out.append((start, end, tokens, level))
            continue
        inner = [m.end() for m in _LINE.finditer(text, start, end)]
        edges = sorted({start, end, *(x for x in inner if start < x < end), *(a for a, _ in units if start < a < end)})
        out += [(a, b, count(a, b), level) for a, b in zip(edges, edges[1:], strict=False)]
    return out


def split_one(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, units=None) -> list[Piece]:
    """Pieces of one text; a text within the limit is one piece, a blank text none."""
    if not text.strip():
        return []
    units = split_batch([text])[0] if units is None else units
    count = Counted(text)
    coarse = parts(text, limit, overlap, units, count)
    pieces: list[Piece] = []
    # Pack whole parts; a cut so falls on the coarsest separator that fits.
    groups: list[list[tuple[int, int, int, int]]] = []
    total = 0
    for part in coarse:
        room = limit - (overlap if groups else 0)
        if not groups or total + part[2] > max(room, 1):
            if groups and part[2] <= limit and total + part[2] <= limit and len(groups) == 1:
                groups[-1].append(part)
                total += part[2]
                continue
            groups.append([])
            total = 0
        groups[-1].append(part)
        total += part[2]
    before: list[tuple[int, int, int, int]] = []
    for group in groups:
        own = sum(p[2] for p in group)
        carried: list[tuple[int, int, int, int]] = []
        room = min(overlap, limit - own)
        for part in reversed(before):
            if sum(p[2] for p in carried) + part[2] > room:
                break
            carried.insert(0, part)
        if len(carried) == len(before):  # never the whole piece before
            carried = carried[1:]
        start, end = (carried or group)[0][0], group[-1][1]
        body = text[start:end]
        start += len(body) - len(body.lstrip())
        end -= len(body) - len(body.rstrip())
        before = _fine(text, group, overlap, units, count)
        if start < end:
            pieces.append(
                Piece(start, end, count(start, end), count(start, group[0][0]) if carried else 0,
                      max(p[3] for p in group))
            )
    return pieces


PIECES = (
    "item_id string, piece_no int, section string, text string, start_char int, end_char int, "
    "token_count int, overlap_tokens int, cut_level int"
)


def split_oversized(
    df: DataFrame,
    item_id: str = "chunk_id",
    text: str = "text",
    section: str = "section",
    start_char: str = "start_char",
    limit: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Consecutive pieces of every item, each within ``limit`` tokens.

    Items within the limit are one piece and stay in the JVM. ``start_char`` and
    ``end_char`` count from the item's own start (NULL counts as 0). NULL and blank
    texts give no piece. Extra columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    base = df.select(
        F.col(item_id).cast("string").alias("item_id"),
        F.col(section).alias("section"),
        F.col(text).alias("text"),
        F.coalesce(F.col(start_char), F.lit(0)).cast("int").alias("start_char"),
    ).withColumn("n", F.when(F.length("text") > 0, count_tokens(F.col("text"))).otherwise(0))
    whole = base.where((F.col("n") > 0) & (F.col("n") <= limit)).select(
        "item_id", F.lit(0).alias("piece_no"), "section", "text", "start_char",
        (F.col("start_char") + F.length("text")).alias("end_char"),
        F.col("n").alias("token_count"), F.lit(0).alias("overlap_tokens"), F.lit(-1).alias("cut_level"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            units = split_batch(pdf["text"].tolist())
            rows = []
            for (i, s, t, at), u in zip(pdf.itertuples(index=False), units, strict=True):
                for k, p in enumerate(split_one(t, limit, overlap, u)):
                    rows.append((i, k, s, t[p.start : p.end], at + p.start, at + p.end, p.tokens, p.overlap, p.level))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    large = base.where((F.length("text") > limit) & (F.col("n") > limit))
    return whole.unionByName(large.select("item_id", "section", "text", "start_char").mapInPandas(run, PIECES))


def oversized_kind(df: DataFrame, item_id: str, text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """``item_id, cut_kind`` of every item over the limit, told by the pieces that the splitter makes of it.

    ``natural`` if it needed no separator finer than a sentence, else ``forced``. Token
    counts are always taken anew. NULL and blank texts are never over the limit; an
    item whose row is repeated comes out once.
    """
    rows = df.select(
        F.col(item_id).alias("chunk_id"), F.col(text).alias("text"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("start_char")
    )
    pieces = split_oversized(rows, limit=limit, overlap=overlap).where(F.col("cut_level") >= SECTION)
    kind = F.when(F.max("cut_level") >= WORD, "forced").otherwise("natural")
    return pieces.groupBy("item_id").agg(kind.alias("cut_kind"))
