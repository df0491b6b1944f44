"""Problem 4: occurrences and records of every term, with marks for rare and common ones.

Vertical layout: records are numbered, and each term has, for every 32,768 record
numbers, one compressed container: the set of its records, with a counter of
occurrences beside each.  A task builds the containers of its own records at once, so what is
shuffled afterwards are whole containers or their counts, never single occurrences.  Containers
of a term merge by union, and the document frequency is their cardinality.

A container is the shortest of a sorted list of positions, a list of runs, and a bitmap of 4 KiB;
counters are kept where they are above one.  So no term can grow a group without
bound: a term of all records costs one run in each block.

Record numbers are either of one run (partition and place) or, from ``record_numbers``,
a table that can be kept and extended: containers of separate days then unite even if they
share records, which count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import broadcast_small, cut_lineage

BITS = 15
BLOCK = 1 << BITS
RARE_BELOW = 3
COMMON_ABOVE = 0.1
HELD_TOKENS = 1 << 21  # a task writes its containers whenever it holds so many terms

LIST, RUNS, BITMAP = range(3)


def encode_all(positions: np.ndarray, counts: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Containers of many sets of sorted distinct positions below BLOCK, one after the other, with their occurrence counters."""
    if not len(positions):
        return [np.zeros(3, np.uint32).tobytes()] * len(starts)
    listed = positions.astype(np.uint16)
    opens = np.r_[True, np.diff(positions) != 1]
    opens[starts] = True
    run_at = np.nonzero(opens)[0]
    runs = np.column_stack([listed[run_at], np.diff(np.r_[run_at, len(positions)]) - 1]).astype(np.uint16).tobytes()
    listed_bytes = listed.tobytes()
    first_run = np.searchsorted(run_at, starts)
    run_bytes = 4 * (np.searchsorted(run_at, ends) - first_run)
    list_bytes = 2 * (ends - starts)
    kind = np.where(list_bytes <= np.minimum(run_bytes, BLOCK // 8), LIST, np.where(run_bytes <= BLOCK // 8, RUNS, BITMAP))
    size = np.choose(kind, [list_bytes, run_bytes, np.full(len(kind), BLOCK // 8)])
    many = np.nonzero(counts > 1)[0]
    owner = np.searchsorted(starts, many, "right") - 1
    ranks, extra = (many - starts[owner]).astype(np.uint16).tobytes(), counts[many].astype(np.uint32).tobytes()
    n_many = np.bincount(owner, minlength=len(starts))
    heads = np.column_stack([kind, size, n_many]).astype(np.uint32).tobytes()
    out = []
    m = 0
    for i, (k, a, n, r, c) in enumerate(zip(kind.tolist(), starts.tolist(), size.tolist(), first_run.tolist(), n_many.tolist(), strict=True)):
        if k == LIST:
            body = listed_bytes[2 * a : 2 * a + n]
        elif k == RUNS:
            body = runs[4 * r : 4 * r + n]
        else:
            bits = np.zeros(BLOCK, np.uint8)
            bits[positions[a : ends[i]]] = 1
            body = np.packbits(bits).tobytes()
        head = heads[12 * i : 12 * i + 12]
        out.append(head + body if not c else b"".join([head, body, ranks[2 * m : 2 * (m + c)], extra[4 * m : 4 * (m + c)]]))
        m += c
    return out


def encode(positions: np.ndarray, counts: np.ndarray) -> bytes:
    """One container."""
    return encode_all(positions, counts, np.array([0]), np.array([len(positions)]))[0]


def decode(container: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and counters of a container."""
    kind, size, many = np.frombuffer(container, np.uint32, 3).tolist()
    body = container[12 : 12 + size]
    if kind == LIST:
        positions = np.frombuffer(body, np.uint16).astype(np.int64)
    elif kind == RUNS:
        runs = np.frombuffer(body, np.uint16).reshape(-1, 2).astype(np.int64)
        lengths = runs[:, 1] + 1
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        positions = np.repeat(runs[:, 0], lengths) + np.arange(lengths.sum()) - first
    else:
        positions = np.nonzero(np.unpackbits(np.frombuffer(body, np.uint8)))[0]
    counts = np.ones(len(positions), np.int64)
    at = np.frombuffer(container, np.uint16, many, 12 + size)
    counts[at] = np.frombuffer(container, np.uint32, many, 12 + size + 2 * many)
    return positions, counts


def unite(containers: list[bytes]) -> bytes:
    """Union; a record that several containers have counts once, with its greatest counter."""
    if len(containers) == 1:
        return containers[0]
    held = np.zeros(BLOCK, np.int64)
    for c in containers:
        positions, counts = decode(c)
        held[positions] = np.maximum(held[positions], counts)
    positions = np.nonzero(held)[0]
    return encode(positions, held[positions])


CONTAINERS = "term string, block long, container binary, records long, occurrences long"
_SCHEMA = pa.schema(
    [("term", pa.string()), ("block", pa.int64()), ("container", pa.binary()), ("records", pa.int64()), ("occurrences", pa.int64())]
)


def _built(numbers: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    """Containers of the terms that stand in the records ``numbers`` (one entry for each occurrence, ascending)."""
    coded = pc.dictionary_encode(terms)
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blocks, block_of = np.unique(numbers >> BITS, return_inverse=True)
    group = block_of * len(coded.dictionary) + codes
    pairs, counts = np.unique(group << BITS | (numbers & (BLOCK - 1)), return_counts=True)
    groups = pairs >> BITS
    starts = np.nonzero(np.r_[True, groups[1:] != groups[:-1]])[0]
    ends = np.r_[starts[1:], len(pairs)]
    positions = pairs & (BLOCK - 1)
    packed = encode_all(positions, counts, starts, ends)
    block_at, term_at = np.divmod(groups[starts], len(coded.dictionary))
    columns = [
        coded.dictionary.take(pa.array(term_at)), pa.array(blocks[block_at]), pa.array(packed, pa.binary()),
        pa.array(ends - starts), pa.array(np.add.reduceat(counts, starts)),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: list[np.ndarray] = []
    terms: list[pa.Array] = []
    held = 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch["tokens"]), 0).to_numpy(zero_copy_only=False)
        if not lengths.sum():
            continue
        numbers.append(np.repeat(batch["record_no"].to_numpy(), lengths))
        terms.append(batch["tokens"].flatten())
        held += len(terms[-1])
        if held >= HELD_TOKENS:
            yield _built(np.concatenate(numbers), pa.concat_arrays(terms))
            numbers, terms, held = [], [], 0
    if held:
        yield _built(np.concatenate(numbers), pa.concat_arrays(terms))


def numbered(df: DataFrame, record_id: str) -> DataFrame:
    """Number distinct records for one run: partition and place, where they are.

    Rows are sorted in their partition, so one that is computed again after a loss gives the same numbers.
    """
    return df.sortWithinPartitions(record_id).withColumn("record_no", F.monotonically_increasing_id())


def record_numbers(records: DataFrame, record_id: str, known: DataFrame | None = None) -> DataFrame:
    """``record, record_no``: a lasting number for every distinct record; those in ``known`` keep theirs.

    Keep the result with the containers and give it back on the next day. NULL records have no number.
    """
    ids = records.select(F.col(record_id).cast("string").alias("record")).where(F.col("record").isNotNull()).distinct()
    start = 0
    if known is not None:
        start = (known.agg(F.max("record_no")).first()[0] or -1) + 1 if known.take(1) else 0
        ids = ids.join(known.select("record"), "record", "left_anti")
    parts = ids.sortWithinPartitions("record").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    parts = cut_lineage(parts.withColumn("_m", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))  # one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", (F.coalesce(F.sum("_c").over(before), F.lit(0)) + start).alias("_b"))
    new = parts.join(broadcast_small(offsets), "_p").select("record", (F.col("_m") + F.col("_b")).alias("record_no"))
    return new if known is None else known.select("record", "record_no").unionByName(new)


def term_containers(df: DataFrame, record_id: str, text: str, numbers: DataFrame | None = None) -> DataFrame:
    """``term, block, container, records, occurrences`` over distinct records; NULL texts have no terms.

    ``numbers`` are lasting ones from ``record_numbers``; without them the records are numbered for this run.
    A term and block may have several rows with different records.
    """
    rows = df.select(F.col(record_id).cast("string").alias("record"), F.col(text).alias("_t"))
    if numbers is None:
        rows = numbered(rows, "record")
    else:
        rows = rows.join(numbers, "record").repartition(F.shiftright("record_no", BITS)).sortWithinPartitions("record_no")
    return rows.select("record_no", tokenize(F.col("_t")).alias("tokens")).mapInArrow(_containers, CONTAINERS)


def unite_containers(*days: DataFrame) -> DataFrame:
    """Containers of several days (of one numbering) as one for every term and block; shared records count once."""
    both = days[0]
    for d in days[1:]:
        both = both.unionByName(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [unite(list(c)) for c in pdf["c"]]
            found = [decode(c) for c in made]
            yield pd.DataFrame({
                "term": pdf["term"], "block": pdf["block"], "container": made,
                "records": [len(p) for p, _ in found], "occurrences": [int(n.sum()) for _, n in found],
            })

    # A list holds one container a day and part, each of bounded size.
    return both.groupBy("term", "block").agg(F.collect_list("container").alias("c")).mapInPandas(run, CONTAINERS)


def merge_terms(containers: DataFrame) -> DataFrame:
    """``term, occurrences, records`` of containers that hold different records: cardinalities add up."""
    return containers.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, record_id: str, text: str) -> DataFrame:
    """Occurrences and records of every term.

    ``df`` must hold each record once. NULL and empty texts are records without terms;
    an empty table has no terms. Other columns are ignored.
    """
    return merge_terms(term_containers(df, record_id, text))


def mark_terms(
    frequencies: DataFrame, record_count: int, rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE
) -> DataFrame:
    """``term, mark``: ``rare`` below that many occurrences, ``common`` above that share of records.

    A term that is both (in a tiny collection) has a row for each mark.
    """
    marks = F.array_compact(
        F.array(
            F.when(F.col("occurrences") < rare_below, F.lit("rare")),
            F.when(F.col("records") > common_above * record_count, F.lit("common")),
        )
    )
    return frequencies.select("term", F.explode(marks).alias("mark"))
