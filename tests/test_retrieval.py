"""Sparse, dense, fusion, reranking and the gates, on hand-made rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import answering as A
from quillspark.functions import sentences as S
from quillspark.functions import text as T
from quillspark.operators import dense, fusion, rerank, sparse
from quillspark.plans import pipeline
from quillspark.providers import EMBEDDERS, RERANKERS, PromptedGenerator, create
from quillspark.prompts import ANSWER


@pytest.fixture(scope="module")
def index(chunks):
    return sparse.build_index(chunks)


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "qid string, question string")


def best(df, score="score"):
    rows = df.orderBy("qid", "rank").collect()
    out = {}
    for r in rows:
        out.setdefault(r.qid, r.chunk_id)
    return out


def test_bm25_finds(spark, index):
    found = best(sparse.search(index, ask(spark, "429 Retry-After", "refunding disputes", "colours", "", None), 5))
    assert found == {"q0": "c3", "q1": "c1", "q2": "c4"}


def test_bm25_matches_formula(spark, index):
    postings = {(r.chunk_id, r.term): r.tf for r in index.postings.collect()}
    dl = {r.chunk_id: r.dl for r in index.lengths.collect()}
    idf = {r.term: r.idf for r in index.idf.collect()}
    assert index.ndocs == len(dl) == 5  # c5 has a title
    n = sum(1 for (_, t) in postings if t == "disput")
    assert idf["disput"] == pytest.approx(math.log(5 - n + 0.5) - math.log(n + 0.5))
    row = sparse.scores(index, sparse.query_terms(ask(spark, "dispute dispute fee"))).where("chunk_id = 'c1'").first()
    want = 0.0
    for t in ("disput", "disput", "fee"):
        tf = postings["c1", t]
        want += idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl["c1"] / index.avgdl))
    assert row.score == pytest.approx(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_bm25_tiny_corpora(spark, chunks, n):
    small = sparse.build_index(chunks.where(F.col("chunk_id").isin(*[f"c{i}" for i in range(1, n + 1)], "")))
    assert small.ndocs == n
    assert small.max_idf == (1.0 if n == 0 else pytest.approx(small.idf.agg(F.max("idf")).first()[0]))
    found = sparse.search(small, ask(spark, "dispute fee"), 5).count()
    assert found == (1 if n == 3 else 0)  # with two chunks the idf is 0, with one it is negative


def test_bm25_scope_and_k(spark, index):
    only = spark.createDataFrame([("c2",)], "chunk_id string")
    assert sparse.search(index, ask(spark, "dispute payouts"), 5, only).select("chunk_id").collect()[0][0] == "c2"
    assert sparse.search(index, ask(spark, "dispute"), 0).count() == 0


@pytest.mark.parametrize("heavy", [0, 3, 16])
def test_bm25_scores_chunk_blocks_without_pairs(monkeypatch, heavy):
    """Whole rows, single postings, repeated terms, ties and blocks give what adding up every pair gives."""
    monkeypatch.setattr(sparse, "HEAVY", heavy)
    rng = np.random.default_rng(3)
    w = np.where(rng.random((90, 12)) < np.linspace(0.02, 0.9, 12), rng.integers(-1, 4, (90, 12)) / 4, 0.0)
    bags = [{0: 1.0}, {1: 2.0, 11: 1.0}, {2: 1.0, 5: 1.0, 10: 3.0}, {11: 1.0}, {0: 1.0, 9: 1.0, 8: 1.0}]
    flat, counts = np.array([t for b in bags for t in b]), np.array([c for b in bags for c in b.values()])
    best = sparse.BestChunks(flat, counts, np.cumsum([len(b) for b in bags]), 12, 4)
    for at in range(0, 90, 30):
        chunk, term = np.nonzero(w[at : at + 30])
        names = sparse.pa.array([f"c{i:03}" for i in range(at, at + 30)])
        best.show(names, np.bincount(chunk, minlength=30), term, w[at + chunk, term])
    got = [(r["b"], r["chunk_id"], r["score"]) for x in best.batches(3) for r in x.to_pylist()]
    want = []
    for b, bag in enumerate(bags):
        scores = sum(w[:, t] * c for t, c in bag.items())
        want += [(b, f"c{i:03}", scores[i]) for i in sorted(range(90), key=lambda i: (-scores[i], i))[:4] if scores[i] > 0]
    assert got == want


@pytest.mark.parametrize("heavy", [0, 4, 16])
@pytest.mark.parametrize("k", [1, 3, 200])
def test_bm25_adds_shared_heavy_terms_once(monkeypatch, heavy, k):
    """Bags that differ in rare terms only share one sum; before, each bag added up its frequent terms anew."""
    monkeypatch.setattr(sparse, "HEAVY", heavy)
    rng = np.random.default_rng(8)
    w = np.where(rng.random((400, 20)) < np.r_[np.full(16, 0.03), 0.4, 0.6, 0.8, 0.9], rng.integers(-1, 5, (400, 20)) / 4, 0.0)
    w[::3] = w[0]  # ties
    bags = [{t: 1.0, u: 2.0, h: 1.0, 19: 1.0} for t in range(0, 16, 2) for u in (1, 5, 9) for h in (16, 17)] + [{18: 1.0}, {3: 1.0, 4: 1.0}]
    flat, counts = np.array([t for b in bags for t in b]), np.array([c for b in bags for c in b.values()])
    best = sparse.BestChunks(flat, counts, np.cumsum([len(b) for b in bags]), 20, k)
    for at in range(0, 400, 80):
        chunk, term = np.nonzero(w[at : at + 80])
        names = sparse.pa.array([f"c{i:03}" for i in range(at, at + 80)])
        best.show(names, np.bincount(chunk, minlength=80), term, w[at + chunk, term])
    got = [(r["b"], r["chunk_id"], r["score"]) for x in best.batches() for r in x.to_pylist()]
    want = []
    for b, bag in enumerate(bags):
        scores = sum(w[:, t] * c for t, c in bag.items())
        want += [(b, f"c{i:03}", scores[i]) for i in sorted(range(400), key=lambda i: (-scores[i], i))[:k] if scores[i] > 0]
    assert got == want
    assert len(best.groups) == (1 if heavy == 0 else 4) < len(bags)


def test_bm25_index_counts_terms_where_the_record_is(spark, chunks, index):
    plan = index.rows._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan  # before, every posting was shuffled, and stemmed, on its own
    terms = {r.chunk_id: dict(zip(r.terms, r.tfs, strict=True)) for r in index.rows.collect()}
    assert terms["c1"]["disput"] == 4 and terms["c1"]["fee"] == 2 and "the" not in terms["c1"]
    assert {k: sum(v.values()) for k, v in terms.items()} == {r.chunk_id: r.dl for r in index.lengths.collect()}


def test_questions_are_embedded_once(spark, index, chunks, tmp_path):
    """Before, every block of questions embedded all questions again, and equal questions each for itself."""

    class Logged(dense.HashingEmbedder):
        def embed(self, texts):
            with open(tmp_path / "log", "a") as f:
                f.write("".join(f"{t}\n" for t in texts))
            return super().embed(texts)

    q = ask(spark, "dispute fee", "429 Retry-After", "colours teal", "payouts friday", "dispute fee")
    got = dense.cosine_top_k(dense.embed_texts(chunks, "chunk_id", F.col("text")), dense.embed_texts(q, "qid", F.col("question"), Logged()), 2, block=2)
    assert got.count() == 10
    assert len((tmp_path / "log").read_text().split("\n")) - 1 == 5
    (tmp_path / "log").unlink()
    corpus = pipeline.Corpus(chunks, index, dense.embed_texts(chunks, "chunk_id", F.col("text")), Logged())
    found = pipeline.retrieve(corpus, q).collect()
    mine = lambda qid: sorted((r.chunk_id, r.fused_rank, r.dense_rank) for r in found if r.qid == qid)
    assert mine("q0") == mine("q4") != []
    assert len((tmp_path / "log").read_text().split("\n")) - 1 == 4


def test_hash_vectors_of_many_texts_add_up_in_order():
    """A text's vector is what its features give one by one, whatever texts are added up with it."""
    texts = ["The dispute fee is 15.00 per case, the fee.", None, "x", "Gr\u00fc\u00dfe \u65e5\u672c\u8a9e caf\u00e9 caf\u00e9 429", " ", "a-b a-b a-b"]
    whole = dense.hash_matrix(texts, 64)
    assert (whole == np.vstack([dense.hash_matrix([t], 64) for t in texts])).all() and (whole == dense.hash_matrix(texts, 64, most=1)).all()
    want = np.zeros(64, np.float32)
    flat, words = T.py_normalize(texts[0]), T.py_tokenize(texts[0])
    features = [(f"w:{w}", (1 + math.log(words.count(w))) * (1 + 0.1 * min(len(w), 12))) for w in dict.fromkeys(words)]
    features += [(f"b:{a}_{b}", 1.4) for a, b in zip(words, words[1:], strict=False)] + [(f"c:{flat[i : i + 4]}", 0.35) for i in range(len(flat) - 3)]
    for f, w in features:
        h = int.from_bytes(dense.hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
        want[h % 64] += np.float32(w if h >> 63 else -w)
    assert (whole[0] == want).all()


def test_bm25_same_terms_are_scored_once(spark, index):
    q = ask(spark, "dispute fee", "the fee, disputes", "payouts", None, "of")
    found = sparse.search(index, q, 3)
    rows = {(r.qid, r.chunk_id, r.rank): r.score for r in found.collect()}
    assert {(c, n): s for (i, c, n), s in rows.items() if i == "q0"} == {(c, n): s for (i, c, n), s in rows.items() if i == "q1"} != {}
    assert {i for i, _, _ in rows} == {"q0", "q1", "q2"} and found.columns == ["qid", "chunk_id", "score", "rank"]
    assert sparse.search(index, q.where("qid = 'q3'"), 3).collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan  # scored by task; before, every question-chunk pair was a row of an aggregate


def test_hash_vectors_are_unit_and_stable():
    e = dense.HashingEmbedder(64)
    m = e.embed(["dispute fee", "dispute fee", "", None])
    assert np.allclose(np.linalg.norm(m[0]), 1, atol=1e-6) and (m[0] == m[1]).all() and not m[2:].any()
    with pytest.raises(ValueError):
        dense.HashingEmbedder(16)
    assert create(EMBEDDERS, "hashing", dimension=64).fingerprint == "hashing:hashing-64:64"
    with pytest.raises(ValueError):
        create(EMBEDDERS, "nobody")


def test_cosine_blocks_agree(spark):
    rng = np.random.default_rng(5)
    vs = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(vs, "id int, v array<float>").repartition(5)
    q = df.where("id % 7 = 0 or id = 99").select(F.col("id").alias("q"), F.col("v").alias("qv")).unionByName(
        spark.createDataFrame([(-1, [0.0] * 8)], "q int, qv array<float>")
    )
    whole = dense.cosine_top_k(df, q, 4, "id", "v", "q", "qv").orderBy("q", "rank").collect()
    parts = dense.cosine_top_k(df, q, 4, "id", "v", "q", "qv", block=2).orderBy("q", "rank").collect()
    assert [(r.q, r.id, r.rank) for r in whole] == [(r.q, r.id, r.rank) for r in parts] and {r.q for r in whole} == {i for i in range(0, 60, 7)}
    m = np.array([v for _, v in vs[:60]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = np.argsort(-(m[7] @ m.T))[:4].tolist()
    assert [r.id for r in whole if r.q == 7] == want
    assert dense.cosine_top_k(df, q, 0, "id", "v", "q", "qv").count() == 0


@pytest.mark.parametrize("k", [1, 7, 200])
def test_dense_search_screens_exactly(k):
    """Near ties, exact ties, zeros and long vectors: as if every product were taken in double precision."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(150, 16)).astype(np.float32)
    v[100:130] = v[:30] * 3  # ties
    v[130:140] = v[30:40] + rng.normal(size=(10, 16)).astype(np.float32) * 1e-6
    v[140] = 0
    q = np.vstack([v[::4] * 1e12, np.zeros((1, 16), np.float32)]).astype(np.float32)
    keys = np.array([f"k{i:03}" for i in rng.permutation(150)], object)
    best = dense.Best(q, k)
    for at in range(0, 150, 40):
        best.show(keys[at : at + 40], v[at : at + 40], step=25, width=9)
    got = {(r.q, r.k) for r in best.rows(np.arange(len(q))).itertuples()}
    scores = np.round(dense.unit(q.astype(np.float64)) @ dense.unit(v.astype(np.float64)).T, 6)
    want = {(i, keys[j]) for i in range(len(q) - 1) if q[i].any() for j in sorted(range(150), key=lambda j: (-scores[i, j], keys[j]))[:k]}
    assert got == want and best.unit.dtype == np.float32  # before, all products were doubles, sorted in whole


def test_dense_search_memory_is_bounded():
    """Two tasks of an executor share 1.2 GB with the embedder's workers; before, a block took 128 MB beside its queries."""
    import tracemalloc

    rng = np.random.default_rng(9)
    best = dense.Best(rng.normal(size=(4096, 512)).astype(np.float32), 20)
    keys, vectors = np.array([f"k{i}" for i in range(4096)], object), rng.normal(size=(4096, 512)).astype(np.float32)
    tracemalloc.start()
    best.show(keys, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_cosine_pairs_of_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)], "id int, v array<float>").repartition(3)
    q = df.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    rows = lambda b: sorted((r.q, r.rank, r.id) for r in dense.cosine_top_k(df, q, 3, "id", "v", "q", "qv", block=b).collect())
    sent = rows(20)  # three blocks of queries
    monkeypatch.setattr(dense, "QUERY_BLOCKS", 1)
    assert rows(20) == sent and len(sent) == 150


def test_equal_vectors_go_by_key(spark):
    df = spark.createDataFrame([(f"k{i:03}", [1.0, float(i % 2)]) for i in range(300)], "id string, v array<float>").repartition(4)
    q = spark.createDataFrame([("q", [1.0, 1.0])], "q string, qv array<float>")
    for block in (10, 1):
        got = dense.cosine_top_k(df, q.unionByName(q.withColumn("q", F.lit("r"))), 5, "id", "v", "q", "qv", block=block).where("q = 'q'").orderBy("rank").collect()
        assert [r.id for r in got] == ["k001", "k003", "k005", "k007", "k009"]
    assert dense.cosine_top_k(df.limit(0), q, 5, "id", "v", "q", "qv").count() == 0 and dense.cosine_top_k(df, q.limit(0), 5, "id", "v", "q", "qv").count() == 0


def test_approximate_search_recall(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    m = centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(9999, None)], "id long, v array<float>")
    q = df.where("id % 20 = 0").select(F.col("id").alias("q"), F.col("v").alias("qv"))
    cells = dense.fit_cells(df, "id", "v", cells=32, sample=3000)
    index = dense.cell_index(df, cells, "id", "v")
    assert cells.shape == (32, 24) and index.count() == 4000
    exact = {(r.q, r.id) for r in dense.cosine_top_k(df, q, 10, "id", "v", "q", "qv").collect()}
    monkeypatch.setattr(dense, "CELL_ROWS", 100)  # crowded cells are cut
    near = {(r.q, r.id) for r in dense.approximate_top_k(index, cells, q, 10, "id", "v", "q", "qv", probes=8).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    whole = {(r.q, r.id) for r in dense.approximate_top_k(index, cells, q, 10, "id", "v", "q", "qv", probes=32).collect()}
    assert whole == exact


def test_bm25_blocks_of_questions_agree(spark, index):
    q = ask(spark, "dispute fee", "429 Retry-After", "colours teal", "payouts friday", "dispute payouts")
    rows = lambda n: sorted((r.qid, r.chunk_id, round(r.score, 9), r.rank) for r in sparse.search(index, q, 2, term_rows=n).collect())
    assert rows(3) == rows(1000) and len(rows(3)) >= 5


def test_dimension_change_raises(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "vec array<float>")
    with pytest.raises(ValueError):
        dense.check_dimension(df)


def legs(spark):
    d = spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], "qid string, chunk_id string, score double, rank int")
    x = spark.createDataFrame([("q", "b", 7.0, 1), ("q", "c", 6.0, 2)], "qid string, chunk_id string, score double, rank int")
    return d, x


def test_rrf(spark):
    got = {r.chunk_id: r for r in fusion.fuse(*legs(spark)).collect()}
    assert got["b"].fusion_score == pytest.approx(1 / 62 + 1 / 61) and got["b"].retriever == "hybrid"
    assert [c for c, _ in sorted(((c, r.fused_rank) for c, r in got.items()), key=lambda p: p[1])] == ["b", "a", "c"]
    assert got["c"].dense_rank is None and got["c"].retriever == "lexical"
    with pytest.raises(ValueError):
        fusion.fuse(*legs(spark), mode="other")
    assert fusion.fuse(*legs(spark), mode="dense_only").count() == 2


def test_rrf_symmetric(spark):
    d, x = legs(spark)
    a = {r.chunk_id: round(r.fusion_score, 9) for r in fusion.fuse(d, x).collect()}
    b = {r.chunk_id: round(r.fusion_score, 9) for r in fusion.fuse(x, d).collect()}
    assert a == b


def test_orphans_are_skipped_after_the_cut(spark, chunks):
    d = spark.createDataFrame([("q", "gone", 0.9, 1), ("q", "c1", 0.8, 2)], "qid string, chunk_id string, score double, rank int")
    fused = fusion.fuse(d, d.limit(0), limit=1)
    assert fusion.hydrate(fused, chunks).count() == 0


def test_lexical_rerank_range_and_order(spark, chunks, index):
    q = ask(spark, "dispute fee", "teal buttons", "the of")
    cand = q.select("qid").join(chunks.withColumn("fused_rank", F.lit(1))).where("chunk_id <> ''")
    got = rerank.lexical_rerank(cand, q, index)
    rows = got.collect()
    assert len(rows) == 15 and all(0 <= r.rerank_score <= 1 for r in rows)
    top = best(rerank.take_top(got, 1))
    assert top["q0"] == "c1" and top["q1"] == "c4"
    assert max(r.rerank_score for r in rows if r.qid == "q2") == 0
    assert rerank.no_rerank(got.withColumn("fusion_score", F.lit(0.5)), 1).count() >= 3


def ranked(spark, n=1, score=0.8, retriever="hybrid"):
    text = "The dispute fee is 15.00 per case. It is not refunded."
    rows = [("q0", f"c{i}", "a.md", "Disputes", "Fees", text, score, i, retriever) for i in range(1, n + 1)]
    return spark.createDataFrame(
        rows, "qid string, chunk_id string, source string, title string, section string, text string, score double, rank int, retriever string"
    )


@pytest.mark.parametrize(
    "text,score,reason",
    [
        ("The dispute fee is 15.00. [S1]", 0.8, None),
        ("The dispute fee is 15.00. [S1]", 0.05, "low_relevance"),
        ("", 0.8, "empty_response"),
        (None, 0.8, "empty_response"),
        ("INSUFFICIENT_EVIDENCE", 0.8, "model_refusal"),
        ("The dispute fee is 15.00.", 0.8, "no_citations"),
        ("The dispute fee is 15.00. [S7]", 0.8, "no_citations"),
        ("Bananas grow on tropical islands. [S1]", 0.8, "low_grounding"),
    ],
)
def test_gates(spark, index, text, score, reason):
    got = A.answer_questions(ask(spark, "What is the dispute fee?"), ranked(spark, score=score), index, generator=A.ScriptedGenerator(text)).collect()
    assert len(got) == 1 and got[0].reason == reason
    assert (got[0].text == A.Gates().refusal_message) == (reason is not None)


def test_gates_before_generation(spark, index):
    q = ask(spark, "What is the dispute fee?", "Which salesforce zebra quantum licence?")
    got = {r.qid: r.reason for r in A.answer_questions(q, ranked(spark), index).collect()}
    assert got["q1"] == "no_results" and got["q0"] is None
    r = ranked(spark).withColumn("qid", F.lit("q1"))
    assert {x.qid: x.reason for x in A.answer_questions(q, r, index).collect()}["q1"] == "question_not_covered"


def test_citations(spark, index):
    text = "The dispute fee is 15.00 [ s1 ]. [S1] It is free [S9]."
    row = A.answer_questions(ask(spark, "What is the dispute fee?"), ranked(spark, 2), index, generator=A.ScriptedGenerator(text)).first()
    assert "[S9]" not in row.text and [c.marker for c in row.citations] == ["S1"]
    assert row.citations[0].quote == "The dispute fee is 15.00 per case."
    assert row.confidence == pytest.approx(min(1, 0.5 * row.grounding + 0.125 + 0.25), abs=1e-4)


def wrote(spark, question, *bodies):
    asked = ask(spark, question)
    blocks = spark.createDataFrame([("q0", i + 1, b) for i, b in enumerate(bodies)], "qid string, marker_no int, body string")
    blocks = blocks.withColumn("terms", T.lexical_tokens(F.col("body")))
    return A.ExtractiveGenerator().write(asked, blocks, A.Gates()).first()


def test_digit_bonus_alone_selects(spark):
    assert wrote(spark, "How many zebras?", "Payment takes 5 working days overall.").made == "Payment takes 5 working days overall. [S1]"
    assert wrote(spark, "How many zebras?", "Takes 5 days.").made == "INSUFFICIENT_EVIDENCE"


def test_extracts_add_terms_and_keep_passage_order(spark):
    got = wrote(
        spark, "Which dispute fee and refund window apply?",
        "# Dispute fee\n\nThe refund window lasts thirty days:\n\n| dispute | fee |",
        "1. The dispute fee applies per case\n\nThe dispute fee applies again and again.",
    )
    assert got.made == "The refund window lasts thirty days. [S1] The dispute fee applies per case. [S2]"
    assert got.input_tokens > got.output_tokens > 0 and wrote(spark, "Which dispute fee?", None, "").made == "INSUFFICIENT_EVIDENCE"


def test_claims_belong_to_the_prose_before(spark):
    text = "Fees are due. [S1] [S2]\n\nRefunds take days [s1]. Nothing here. They close [ S3 ] early."
    df = spark.createDataFrame([(text,), (None,), ("",), ("No marker.",)], "t string")
    got = [r[0] for r in df.select(S.claims(F.col("t"))).collect()]
    assert got[0] == {"S1": "Fees are due. Refunds take days .", "S2": "Fees are due.", "S3": "They close  early."}
    assert got[1:] == [None, {}, {}]


def test_best_sentences(spark):
    rows = [(1, "dispute fee", "# Dispute fee\n\nNothing. The dispute fee is due. Fee."), (2, "", "One. Two."), (3, "fee", "| fee |"), (4, "fee", "  "), (5, None, "A b."), (6, "fee", None)]
    df = spark.createDataFrame(rows, "k int, q string, t string")
    got = {r.k: r.sentence for r in S.best_sentences(df, ["k"], F.col("q"), F.col("t")).collect()}
    assert got == {1: "The dispute fee is due.", 2: "One.", 3: "| fee |", 4: "  ", 5: "A b.", 6: None}


def test_unknown_markers_are_cut(spark, index):
    said = "The dispute fee is 15.00 [S1].  It is due [S01]. It is free [S9] for all."
    row = A.answer_questions(ask(spark, "What is the dispute fee?"), ranked(spark, 2), index, generator=A.ScriptedGenerator(said)).first()
    assert row.text == "The dispute fee is 15.00 [S1]. It is due . It is free for all." and [c.marker for c in row.citations] == ["S1"]
    assert [x.chunk_id for x in row.retrieved] == ["c1", "c2"]


def test_end_to_end(spark, chunks):
    corpus = pipeline.index_chunks(chunks)
    q = ask(spark, "How much is the dispute fee per case?", "What colours are primary buttons?", "   ")
    got = {r.qid: r for r in pipeline.answer(corpus, q).collect()}
    assert "15.00" in got["q0"].text and got["q0"].citations[0].chunk_id == "c1"
    assert "teal" in got["q1"].text and got["q2"].reason == "no_results"
    scoped = {r.qid: r for r in pipeline.answer(corpus, q, doc_ids=spark.createDataFrame([("d3",)], "doc_id string")).collect()}
    assert all(c.chunk_id in ("c4", "c5") for r in scoped.values() for c in r.citations)


def test_model_reranker(spark, chunks):
    q = ask(spark, "a", "bb")
    cand = q.select("qid").crossJoin(chunks.where("text is not null").withColumn("fused_rank", F.lit(1)))
    scorer = create(RERANKERS, "function", score_pairs=lambda pairs: [len(p) * len(x) for x, p in pairs], batch_size=3)
    got = rerank.model_rerank(cand, q, scorer).collect()
    assert len(got) == 8
    for r in got:
        assert r.rerank_score == len(f"{r.section}\n{r.text}") * (1 if r.qid == "q0" else 2)


def test_prompted_generator(spark, index):
    gen = PromptedGenerator(lambda system, user: ("The dispute fee is 15.00. [S1]", 7, 3), ANSWER)
    row = A.answer_questions(ask(spark, "What is the dispute fee?"), ranked(spark), index, generator=gen).first()
    assert row.reason is None and row.input_tokens == 7 and row.model == "hosted"
