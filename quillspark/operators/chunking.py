"""Structure-aware chunking within a token budget.

One document is one row, so the fold over its units runs inside an Arrow batch and
documents spread over tasks freely.  Offsets refer to the document text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sentences import py_sentences
from ..functions.text import py_count_tokens

_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


@dataclass(frozen=True)
class ChunkRules:
    target_tokens: int = 600
    max_tokens: int = 800
    overlap_tokens: int = 100
    min_tokens: int = 40
    section_break_ratio: float = 1.0

    def __post_init__(self) -> None:
        if self.overlap_tokens >= self.target_tokens:
            raise ValueError("the overlap must be below the target")
        if self.max_tokens < self.target_tokens:
            raise ValueError("the maximum must not be below the target")
        if not 0 <= self.section_break_ratio <= 1:
            raise ValueError("the section break ratio is between 0 and 1")


@dataclass(frozen=True)
class Unit:
    text: str
    start: int
    end: int
    path: tuple[str, ...]
    tokens: int


def _kinds(lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """Runs of lines of one kind: heading, fence, table, blank or prose."""
    i = 0
    while i < len(lines):
        start, line = i, lines[i]
        fence = _FENCE.match(line)
        i += 1
        if _HEADING.match(line.rstrip("\n")):
            kind = "heading"
        elif fence:
            kind = "fence"
            while i < len(lines) and not lines[i].strip().startswith(fence[1]):
                i += 1
            i = min(i + 1, len(lines))
        elif line.strip().startswith("|"):
            kind = "table"
            while i < len(lines) and lines[i].strip().startswith("|"):
                i += 1
        elif not line.strip():
            kind = "blank"
        else:
            kind = "prose"
            while i < len(lines):
                nxt = lines[i]
                if not nxt.strip() or nxt.strip()[0] == "|" or _FENCE.match(nxt) or _HEADING.match(nxt.rstrip("\n")):
                    break
                i += 1
        yield kind, start, i


def parse_units(text: str) -> list[Unit]:
    """Headings, fences, tables and sentences of a document with their heading path."""
    lines = text.splitlines(keepends=True)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    units: list[Unit] = []
    levels: dict[int, str] = {}

    def add(body: str, start: int, end: int) -> None:
        path = tuple(levels[k] for k in sorted(levels))
        units.append(Unit(body, start, end, path, py_count_tokens(body)))

    for kind, a, b in _kinds(lines):
        block = "".join(lines[a:b])
        body = block.strip()
        if kind == "heading":
            m = _HEADING.match(lines[a].rstrip("\n"))
            depth = len(m[1])
            for k in [k for k in levels if k >= depth]:
                del levels[k]
            levels[depth] = m[2]
            add(body, at[a], at[a] + len(body))
        elif kind in ("fence", "table") and body:
            add(body, at[a], at[b])
        elif kind == "prose":
            cursor = 0
            for sentence in py_sentences(block):
                place = block.find(sentence, cursor)
                place = cursor if place < 0 else place
                add(sentence, at[a] + place, at[a] + place + len(sentence))
                cursor = place + len(sentence)
    return units


def hard_split(unit: Unit, limit: int) -> list[Unit]:
    """Whole lines of an oversized unit, packed to the limit; a single line stays whole."""
    if unit.tokens <= limit:
        return [unit]
    groups: list[list[str]] = []
    total = 0
    for line in unit.text.splitlines(keepends=True):
        n = py_count_tokens(line)
        if not groups or total + n > limit:
            groups.append([])
            total = 0
        groups[-1].append(line)
        total += n
    out, at = [], unit.start
    for group in groups:
        raw = "".join(group)
        if raw.strip():
            body = raw.strip()
            out.append(replace(unit, text=body, start=at, end=at + len(raw), tokens=py_count_tokens(body)))
        at += len(raw)
    return out or [unit]


def carry(units: list[Unit], budget: int) -> list[Unit]:
    """Trailing units within the overlap budget, never all of them."""
    total, kept = 0, 0
    for unit in reversed(units):
        total += unit.tokens
        if budget <= 0 or total > budget:
            break
        kept += 1
    return units[len(units) - min(kept, len(units) - 1) :] if kept else []


def pack(units: list[Unit], rules: ChunkRules) -> list[list[Unit]]:
    """Greedy packing: flush before the maximum, at the target, or where a section changes."""
    breaks = int(rules.target_tokens * rules.section_break_ratio)
    done: list[list[Unit]] = []
    current: list[Unit] = []
    total = 0
    for unit in units:
        if current:
            moved = unit.path[:2] != current[0].path[:2] and total >= breaks
            if moved or total >= rules.target_tokens or total + unit.tokens > rules.max_tokens:
                done.append(current)
                current = [] if moved else carry(current, rules.overlap_tokens)
                total = sum(u.tokens for u in current)
        current = [*current, unit]
        total += unit.tokens
    return [*done, current] if current else done


def chunk_text(text: str | None, rules: ChunkRules = ChunkRules()) -> list[dict]:
    """Chunks of one document; NULL and blank texts have none."""
    units = [p for u in parse_units(text or "") for p in hard_split(u, rules.max_tokens) if p.text.strip()]
    chunks = []
    for k, group in enumerate(pack(units, rules)):
        body = "\n".join(u.text for u in group).strip()
        chunks.append({
            "ordinal": k, "section": " > ".join(group[0].path), "text": body, "token_count": py_count_tokens(body),
            "start_char": group[0].start, "end_char": group[-1].end,
        })
    if len(chunks) > 1:
        last, before = chunks[-1], chunks[-2]
        if last["token_count"] < rules.min_tokens and before["token_count"] + last["token_count"] <= rules.max_tokens:
            before["text"] = f"{before['text']}\n{last['text']}".strip()
            before["token_count"] = py_count_tokens(before["text"])
            before["end_char"] = last["end_char"]
            chunks.pop()
    return chunks


CHUNK = "doc_id string, ordinal int, section string, text string, token_count int, start_char int, end_char int"


def chunk_documents(docs: DataFrame, rules: ChunkRules = ChunkRules()) -> DataFrame:
    """Chunks of every document: ``chunk_id, doc_id, source, title, section, text, ordinal, ...``.

    Scalar metadata, the content type and the document title go along as a map.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for pdf in batches:
            rows = [{"doc_id": d} | c for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for c in chunk_text(t, rules)]
            yield pd.DataFrame(rows, columns=names)

    made = docs.select("doc_id", "text").mapInPandas(run, CHUNK)
    if "metadata" in docs.columns:
        own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
        base = F.create_map(
            F.lit("content_type"), F.coalesce("content_type", F.lit("")), F.lit("doc_title"), F.coalesce("title", F.lit(""))
        )
        metadata = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
    else:
        metadata = F.lit(None).cast("map<string,string>")
    known = docs.select("doc_id", "source", "title", metadata.alias("metadata"))
    return made.join(known, "doc_id").withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("ordinal")))


def chunk_id(doc_id: Column, ordinal: Column) -> Column:
    return F.format_string("%s::%04d", doc_id, ordinal)


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    head = F.concat_ws(" — ", F.when(title != "", title), F.when(section != "", section))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n\n"), text))


def locator(source: Column, section: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(source, F.lit("#"), section)).otherwise(source)


