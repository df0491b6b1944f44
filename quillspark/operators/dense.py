"""Dense vectors: hashing embedder, L2 norm, exact cosine search in blocks, approximate search by cells."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_normalize, words_in
from .sparse import top_k

DIMENSION = 512
#: So many queries at once are sent to all vectors where they lie, so many times; still more meet the vectors in pairs of blocks.
QUERY_BLOCK, QUERY_BLOCKS = 8192, 32
#: Vectors and queries of one pair of blocks.
PAIR_BLOCK = 16_384


class _Hashes(dict):
    """The hash of a feature as a signed 64-bit number; the first ones met, and so the frequent ones, are kept."""

    def __init__(self, name) -> None:
        super().__init__()
        self.name = name

    def __missing__(self, feature) -> int:
        h = int.from_bytes(hashlib.blake2b(self.name(feature).encode(), digest_size=8).digest(), "big", signed=True)
        if len(self) < 300_000:
            self[feature] = h
        return h


_WORDS, _PAIRS, _GRAMS = _Hashes("w:{}".format), _Hashes(lambda p: f"b:{p[0]}_{p[1]}"), _Hashes("c:{}".format)


def hash_matrix(texts: list[str | None], dimension: int = DIMENSION, most: int = 200_000) -> np.ndarray:
    """Signed feature hashing of words, bigrams and character 4-grams, a row a text; zeros without words.

    The features of many texts are added up at once, about ``most`` of them.
    """
    out = np.zeros((len(texts), dimension), np.float32)
    hashes, weights, rows, sizes = [], [], [], []

    def add() -> None:
        hashed = np.fromiter(hashes, np.int64, len(hashes))
        weight = np.fromiter(weights, np.float32, len(weights))
        cell = (hashed.view(np.uint64) % np.uint64(dimension)).astype(np.int64) + np.repeat(np.array(rows, np.int64) * dimension, sizes)
        np.add.at(out.reshape(-1), cell, np.where(hashed < 0, weight, -weight))
        for x in (hashes, weights, rows, sizes):
            x.clear()

    for row, text in enumerate(texts):
        flat = py_normalize(text) if text else ""
        words = words_in(flat)
        if not words:
            continue
        counts, before = Counter(words), len(hashes)
        hashes.extend(map(_WORDS.__getitem__, counts))
        weights.extend([(1 + math.log(n)) * (1 + 0.1 * min(len(w), 12)) for w, n in counts.items()])
        hashes.extend(map(_PAIRS.__getitem__, zip(words, words[1:], strict=False)))
        weights.extend([1.4] * (len(words) - 1))
        hashes.extend(map(_GRAMS.__getitem__, [flat[i : i + 4] for i in range(len(flat) - 3)]))
        weights.extend([0.35] * (len(flat) - 3))
        rows.append(row)
        sizes.append(len(hashes) - before)
        if len(hashes) >= most:
            add()
    if hashes:
        add()
    return out


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length, in the precision given; zero rows stay."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


class HashingEmbedder:
    """Deterministic embedder that needs no model."""

    def __init__(self, dimension: int = DIMENSION, normalise: bool = True) -> None:
        if dimension < 32:
            raise ValueError("the dimension must be at least 32")
        self.dimension, self.normalise = dimension, normalise

    @property
    def fingerprint(self) -> str:
        return f"hashing:hashing-{self.dimension}:{self.dimension}"

    def embed(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros((0, self.dimension), np.float32)
        matrix = hash_matrix(texts, self.dimension)
        return unit(matrix).astype(np.float32) if self.normalise else matrix


def embed_texts(df: DataFrame, key: str, text: Column, embedder=None) -> DataFrame:
    """``key, vec``. The embedder is any object with ``embed(list) -> matrix``; one copy a task."""
    embedder = embedder or HashingEmbedder()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                matrix = np.asarray(embedder.embed(some.column(1).to_pylist()), np.float32)
                ends = pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))], ["k", "vec"])

    rows = df.select(F.col(key).alias("k"), text.alias("t"))
    return rows.mapInArrow(run, f"k {kind}, vec array<float>").withColumnRenamed("k", key)


def l2_normalize(vec: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


class Best:
    """The best ``k`` of all vectors shown so far for each query; among equals those with the least key.

    Products in single precision, with a margin for their error, tell which vectors can be among the best; only those are scored in double precision.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.raw, self.k = queries.astype(np.float32, copy=False), k
        self.norm = np.concatenate([np.linalg.norm(x.astype(np.float64), axis=1) for x in np.array_split(self.raw, 1 + len(self.raw) // 4096)])
        self.norm[self.norm == 0] = 1
        self.unit = (self.raw / self.norm[:, None].astype(np.float32)).astype(np.float32, copy=False)
        self.scores = np.full((len(self.raw), k), -np.inf)
        self.keys = np.full((len(self.raw), k), None, object)
        self.margin = 1e-6 + (self.raw.shape[1] + 8) * 2.0**-23

    def show(self, keys: np.ndarray, vectors: np.ndarray, step: int = 4096, width: int = 1024) -> None:
        for at in range(0, len(keys), step):
            some, names = unit(vectors[at : at + step].astype(np.float64)), keys[at : at + step]
            single = some.astype(np.float32).T
            for low in range(0, len(self.unit), width):
                near = self.unit[low : low + width] @ single
                least = np.round(self.scores[low : low + width, -1], 6)
                if len(names) > self.k and np.isneginf(least).any():
                    least = np.maximum(least, np.partition(near, -self.k, axis=1)[:, -self.k] - self.margin)
                q, v = np.nonzero(near >= (least - self.margin).astype(np.float32)[:, None])
                if len(q):
                    self._keep(low + q, names[v], self._exact(low + q, some, v))

    def _exact(self, q: np.ndarray, vectors: np.ndarray, v: np.ndarray, most: int = 1024) -> np.ndarray:
        out = np.empty(len(q))
        for i in range(0, len(q), most):
            some = slice(i, i + most)
            out[some] = np.einsum("ij,ij->i", self.raw[q[some]].astype(np.float64) / self.norm[q[some], None], vectors[v[some]])
        return out

    def _keep(self, q: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        better = np.round(scores, 6) >= np.round(self.scores[q, -1], 6)
        q, names, scores = q[better], names[better], scores[better]
        if not len(q):
            return
        k, touched = self.k, np.unique(q)
        q = np.r_[np.repeat(touched, k), q]
        names, scores = np.concatenate([self.keys[touched].ravel(), names]), np.r_[self.scores[touched].ravel(), scores]
        rounded = np.round(scores, 6)
        order = np.lexsort((-rounded, q))
        first = np.searchsorted(q[order], touched)
        last = order[first + k - 1]
        after = np.minimum(first + k, len(order) - 1)
        tied = (first + k < len(order)) & (q[order[after]] == touched) & (rounded[order[after]] == rounded[last]) & (rounded[last] > -np.inf)
        ends = np.r_[first[1:], len(order)]
        for i in np.flatnonzero(tied).tolist():  # the last place goes by key
            mine = order[first[i] : ends[i]]
            same = rounded[mine] == rounded[last[i]]
            equal = mine[same]
            from_, to = first[i] + int(np.argmax(same)), first[i] + int(np.argmax(same)) + len(equal)
            order[from_:to] = equal[sorted(range(len(equal)), key=names[equal].__getitem__)]
        kept = order[first[:, None] + np.arange(k)]
        self.scores[touched], self.keys[touched] = scores[kept], names[kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the queries, keys and scores; zero queries find nothing."""
        live = (self.scores > -np.inf) & self.raw.any(axis=1)[:, None]
        return np.nonzero(live)[0], self.keys[live], self.scores[live]

    def rows(self, names: np.ndarray) -> pd.DataFrame:
        """``q, k, score``."""
        q, k, score = self.found()
        plain = lambda x: pd.Series(x, dtype=object)
        return pd.DataFrame({"q": plain(names[q]), "k": plain(k), "score": score})


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"q": pd.Series([], dtype=object), "k": pd.Series([], dtype=object), "score": pd.Series([], dtype=float)})


def _matrix(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _sent_to_all(vectors: DataFrame, asked: DataFrame, k: int, schema: str) -> DataFrame | None:
    """One block of queries (the caller has counted them): each task walks its own vectors once and keeps its best."""
    table = asked.toArrow().combine_chunks()
    if not table.num_rows:
        return None
    context = vectors.sparkSession.sparkContext
    shared = context.broadcast((table.column("q").chunk(0), _matrix(table.column("v").chunk(0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best = Best(q, k)
        held, n = [], 0

        def show() -> None:
            all_keys = [x.column(0).to_numpy(zero_copy_only=False).astype(object) for x in held]
            best.show(np.concatenate(all_keys), np.concatenate([_matrix(x.column(1)) for x in held]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 4096:
                show()
                held, n = [], 0
        if held:
            show()
        at, keys, scores = best.found()
        for i in range(0, len(at), 100_000):
            some = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[some])), pa.array(keys[some].tolist(), key_type), pa.array(scores[some])], ["q", "k", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(vectors.schema["k"].dataType)
    return vectors.coalesce(context.defaultParallelism).mapInArrow(run, schema)  # each task sends its best k


def _block_pairs(vectors: DataFrame, asked: DataFrame, n_vectors: int, n_asked: int, k: int, schema: str, block: int) -> DataFrame:
    """Many queries: every block of vectors meets every block of queries in a task of its own."""
    vb, qb = max(1, -(-n_vectors // block)), max(1, -(-n_asked // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.select("k", "v", F.pmod(F.xxhash64("k"), F.lit(vb)).cast("int").alias("vb"), every(qb).alias("qb"))
    right = asked.select("q", F.col("v").alias("qv"), F.pmod(F.xxhash64("q"), F.lit(qb)).cast("int").alias("qb"), every(vb).alias("vb"))

    def pair(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if vs.empty or qs.empty:
            return _nothing()
        best = Best(np.vstack(qs["qv"].to_numpy()), k)
        best.show(vs["k"].to_numpy(object), np.vstack(vs["v"].to_numpy()))
        return best.rows(qs["q"].to_numpy(object))

    return left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(pair, schema)


def cosine_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vec: str = "vec", qid: str = "qid", qvec: str = "vec",
    allowed: DataFrame | None = None, block: int = QUERY_BLOCK,
) -> DataFrame:
    """``qid, key, score, rank``: exact cosine top-k of each query.

    The queries are sent to the vectors, which stay where they are, in up to QUERY_BLOCKS blocks of about ``block``; more queries and the
    vectors are cut into blocks that meet pair by pair, so neither a task nor the driver ever holds more than a block. A task keeps only its
    best ``k`` for each query before anything is merged. Zero and NULL
    queries find nothing; NULL vectors are never found; ``allowed`` filters first.
    """
    if allowed is not None:
        vectors = vectors.join(allowed.select(key).distinct(), key, "left_semi")
    kind, qkind = (d.schema[c].dataType.simpleString() for d, c in ((vectors, key), (queries, qid)))
    asked = queries.select(F.col(qid).alias("q"), F.col(qvec).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    schema = f"q {qkind}, k {kind}, score double"
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], f"{qid} {qkind}, {key} {kind}, score double, rank int")
    asked = asked.persist()  # embedded once, not again for each block
    n = asked.count()
    if n <= block * QUERY_BLOCKS:
        blocks, out = max(1, -(-n // block)), None
        for i in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i) if blocks > 1 else asked
            if (part := _sent_to_all(rows, some, k, schema)) is not None:
                out = part if out is None else out.unionByName(part)
        if out is None:
            out = vectors.sparkSession.createDataFrame([], schema)
    else:
        out = _block_pairs(rows, asked, rows.count(), n, k, schema, min(block, PAIR_BLOCK))
    asked.unpersist()  # blocks are collected by now, pairs ask again
    return top_k(out.select(F.col("q").alias(qid), F.col("k").alias(key), "score"), k, qid, key)


# --- approximate search -----------------------------------------------------------

CELLS, PROBES, SAMPLE, CELL_ROWS = 256, 32, 20_000, 8_192


def _leading(key: Column) -> Column:
    return 64 - F.length(F.bin(F.xxhash64(key)))


def fit_cells(vectors: DataFrame, key: str = "chunk_id", vec: str = "vec", cells: int = CELLS, sample: int = SAMPLE, rounds: int = 8) -> np.ndarray:
    """Unit centroids (cells x dimension) by spherical k-means on at most ``sample`` vectors chosen by hash."""
    rows = vectors.where(F.col(vec).isNotNull()).withColumn("_l", _leading(F.col(key).cast("string")))
    total, least = 0, 65
    for r in sorted(rows.groupBy("_l").count().collect(), key=lambda r: -r["_l"]):
        total += r["count"]
        if total > sample:
            break
        least = r["_l"]
    got = rows.where(F.col("_l") >= least).orderBy(key).select(vec).collect()
    x = unit(np.array([r[0] for r in got], np.float64)) if got else np.zeros((0, 1))
    if not len(x):
        return x.astype(np.float32)
    rng = np.random.default_rng(0)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
    return centres.astype(np.float32)


def _cells_of(df: DataFrame, name: str, vec: str, centres: np.ndarray, n: int) -> DataFrame:
    """``name, vec, cell``: the ``n`` nearest cells of each vector, one row for each."""
    shared = df.sparkSession.sparkContext.broadcast(centres)  # at most CELLS vectors
    kind = df.schema[name].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(np.vstack(pdf["v"].to_numpy()) @ c.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"k": pdf["k"], "v": pdf["v"], "cells": list(near.astype(np.int32))})

    rows = df.select(F.col(name).alias("k"), F.col(vec).cast("array<float>").alias("v")).where(F.col("v").isNotNull())
    found = rows.mapInPandas(run, f"k {kind}, v array<float>, cells array<int>")
    return found.select(F.col("k").alias(name), F.col("v").alias(vec), F.explode("cells").alias("cell"))


def cell_index(vectors: DataFrame, centres: np.ndarray, key: str = "chunk_id", vec: str = "vec") -> DataFrame:
    """Every vector with its nearest cell; write it partitioned by ``cell`` to keep it."""
    return _cells_of(vectors, key, vec, centres, 1)


def approximate_top_k(
    index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, key: str = "chunk_id", vec: str = "vec", qid: str = "qid", qvec: str = "vec",
    probes: int = PROBES,
) -> DataFrame:
    """``qid, key, score, rank`` among the vectors of each query's ``probes`` nearest cells.

    A crowded cell is cut into parts of about CELL_ROWS vectors, each of which meets the cell's queries in a task of its own.
    """
    kind, qkind = (d.schema[c].dataType.simpleString() for d, c in ((index, key), (queries, qid)))
    parts = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"))  # at most CELLS rows
    parts = F.broadcast(parts)
    left = index.select(F.col(key).alias("k"), F.col(vec).alias("v"), "cell").join(parts, "cell")
    left = left.select("k", "v", "cell", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("part"))
    right = _cells_of(queries.select(F.col(qid).alias("q"), F.col(qvec).alias("qv")), "q", "qv", centres, probes).join(parts, "cell")
    right = right.select("q", "qv", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def pair(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(qs) if len(vs) else 0, QUERY_BLOCK):
            some = qs.iloc[at : at + QUERY_BLOCK]
            best = Best(np.vstack(some["qv"].to_numpy()), k)
            best.show(vs["k"].to_numpy(object), np.vstack(vs["v"].to_numpy()))
            out.append(best.rows(some["q"].to_numpy(object)))
        return pd.concat(out, ignore_index=True) if out else _nothing()

    found = left.groupBy("cell", "part").cogroup(right.groupBy("cell", "part")).applyInPandas(pair, f"q {qkind}, k {kind}, score double")
    return top_k(found.select(F.col("q").alias(qid), F.col("k").alias(key), "score"), k, qid, key)


def check_dimension(vectors: DataFrame, vec: str = "vec") -> int | None:
    """The common length of all vectors; an error if there are two."""
    low, high = vectors.agg(F.min(F.size(vec)), F.max(F.size(vec))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and {high} dimensions in one store")
    return low
