"""Loaders, chunking, upkeep, evaluation, configuration and streaming ingest."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillspark import config
from quillspark.operators import chunking as C
from quillspark.operators import evaluation as E
from quillspark.operators import maintenance as M
from quillspark.operators.dense import HashingEmbedder
from quillspark.plans import pipeline
from quillspark.plans.library import DocumentNotFound, Library, projected
from quillspark.prompts import MissingVariable, Prompt, PromptLibrary
from quillspark.session import build_session, cut_lineage, is_small
from quillspark.sources import loaders as L
from quillspark.sources import sinks
from quillspark.streaming.ingest import arrivals, document_stream, ingest_stream

from conftest import HANDBOOK


def test_units():
    units = C.parse_units(HANDBOOK)
    assert [u.text for u in units if u.text.startswith("#")][:2] == ["# Widget Handbook", "## Refund window"]
    fence = next(u for u in units if u.text.startswith("```"))
    assert fence.text.endswith("```") and "# not a heading" in fence.text and fence.path == ("Widget Handbook", "Rate limits")
    assert sum(u.text.startswith("|") for u in units) == 1
    for u in units:
        if not u.text.startswith(("Intro",)):
            assert HANDBOOK[u.start : u.start + 3] == u.text[:3]


def test_heading_levels_reset():
    units = C.parse_units("# A\n### B\n## C\ntext\n~~~\nopen fence\n")
    assert units[-2].path == ("A", "C") and units[-1].text == "~~~\nopen fence"


def test_chunks(spark, docs):
    got = C.chunk_documents(docs).orderBy("doc_id", "ordinal").collect()
    assert [r.chunk_id for r in got] == ["glossary::0000", "handbook::0000"]
    assert got[1].metadata["owner"] == "ops" and got[1].metadata["content_type"] == "markdown"
    per_section = C.chunk_text(HANDBOOK, C.ChunkRules(target_tokens=50, overlap_tokens=0, min_tokens=0, section_break_ratio=0.0))
    assert [c["section"].split(" > ")[-1] for c in per_section] == ["Widget Handbook", "Refund window", "Rate limits"]
    assert C.chunk_text(None) == C.chunk_text(" \n") == []


def test_overlap_and_limits():
    text = " ".join(f"Sentence number {i} has several plain words in it." for i in range(80))
    rules = C.ChunkRules(target_tokens=100, max_tokens=140, overlap_tokens=30, min_tokens=10)
    chunks = C.chunk_text(text, rules)
    assert len(chunks) > 5 and all(c["token_count"] <= 140 + 30 for c in chunks)
    assert chunks[0]["text"].split("\n")[-1] == chunks[1]["text"].split("\n")[0 if chunks[1]["text"].startswith(chunks[0]["text"].split("\n")[-1]) else 1]
    big = "```\n" + "\n".join(f"line {i} = value" for i in range(200)) + "\n```"
    assert max(c["token_count"] for c in C.chunk_text(big, rules)) <= 170
    assert len(C.chunk_text("x" * 4000, rules)) == 1  # one line stays whole
    with pytest.raises(ValueError):
        C.ChunkRules(target_tokens=10, overlap_tokens=10)
    with pytest.raises(ValueError):
        C.ChunkRules(section_break_ratio=2)


def test_front_matter_and_titles(spark):
    rows = [
        ("a/x.md", "---\ntitle: My Doc\ndoc_id: fixed\nowner: ops\n---\n# Other\ntext"),
        ("a/y.md", "---\n: [bad\n---\nBody"),
        ("a/z.md", "\n# Heading\nbody"),
        ("a/w.md", "plain\n# Late"),
        ("a/v.md", ""),
    ]
    got = {r.source: r for r in L.markdown_documents(spark.createDataFrame(rows, "source string, text string")).collect()}
    assert (got["a/x.md"].doc_id, got["a/x.md"].title, got["a/x.md"].metadata) == ("fixed", "My Doc", {"owner": "ops"})
    assert got["a/y.md"].text.startswith("---") and got["a/y.md"].title == "y"
    assert got["a/z.md"].title == "Heading" and got["a/w.md"].title == "w" and got["a/v.md"].text == ""


def test_html_outline():
    page = (
        "<html><head><title> Page </title><style>p{}</style></head><body><nav>menu</nav><h1>Top</h1><p>One <b>bold</b></p>"
        "<ul><li>item <p>inner</p></li></ul><aside>no</aside><h5>lost</h5><table><tr><td>cell</td></tr></table><pre>code</pre><footer>f</footer></body></html>"
    )
    assert L.html_outline(page) == ("Page", "# Top\n\nOne bold\n\n- item inner\n\ninner\n\ncell\n\ncode")


def test_folder_load(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: A\n---\nText a")
    (tmp_path / "sub" / "b.html").write_text("<title>B</title><p>Text b</p>")
    (tmp_path / "c.txt").write_text(" Text c ")
    (tmp_path / "d.png").write_text("no")
    (tmp_path / ".hidden" / "e.md").write_text("no")
    got = L.load_documents(L.list_files(spark, str(tmp_path)), with_pdf=False).collect()
    assert sorted((r.title, r.text) for r in got) == [("A", "Text a"), ("B", "Text b"), ("c", "Text c")]
    only = L.list_files(spark, str(tmp_path), include=["*.md", "*.txt"], exclude=["c.*"]).collect()
    assert len(only) == 1
    with pytest.raises(Exception, match="(?i)path"):
        L.list_files(spark, str(tmp_path / "missing")).count()


def test_pages_and_fetch(spark):
    pages = spark.createDataFrame([("s", 2, "two"), ("s", 1, " one "), ("s", 3, " "), ("t", 1, None)], "source string, page int, content string")
    got = {r.source: r.text for r in L.stitch_pages(pages).collect()}
    assert got == {"s": "## Page 1\n\none\n\n## Page 2\n\ntwo", "t": ""}
    urls = spark.createDataFrame([("http://x.example/a",)], "url string")
    doc = L.fetch_pages(urls, lambda u: "<p>hello</p>").first()
    assert doc.title == "http://x.example/a" and doc.metadata == {"fetched_from": "http://x.example/a"}


def test_pdf_documents(spark):
    books = {b"1": (" The Fees ", ["one", "  ", "three"]), b"2": (None, ["x"]), b"3": ("", [])}
    files = spark.createDataFrame([("a/f.pdf", bytearray(b"1")), ("a/g.pdf", bytearray(b"2")), ("a/h.pdf", bytearray(b"3"))], "source string, content binary")
    got = {r.source: r for r in L.pdf_documents(files, lambda data: books[bytes(data)]).collect()}
    assert got["a/f.pdf"].title == "The Fees" and got["a/f.pdf"].text == "## Page 1\n\none\n\n## Page 3\n\nthree" and got["a/f.pdf"].metadata == {"pages": "3"}
    assert got["a/g.pdf"].title == "g" and got["a/h.pdf"].text == "" and got["a/h.pdf"].metadata == {"pages": "0"} and got["a/h.pdf"].content_type == "pdf"


def test_golden_reader(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text(json.dumps({"id": "1", "question": "q"}) + "\n\n" + json.dumps({"id": "2", "question": "r", "answerable": False}) + "\n")
    assert [r.answerable for r in L.read_golden(spark, str(good)).orderBy("id").collect()] == [True, False]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": "1"\n')
    with pytest.raises(Exception):
        L.read_golden(spark, str(bad)).collect()
    rows, broken = L.read_json_lines(spark, str(bad), "id string")
    assert rows.count() == 0 and broken.count() == 1


def test_ingest_twice(spark, docs, tmp_path):
    folder = str(tmp_path / "store")
    first = pipeline.ingest(docs, folder)
    assert first == {"documents": 4, "skipped": 0, "chunks": 2}
    assert pipeline.ingest(docs, folder) == {"documents": 0, "skipped": 4, "chunks": 0}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == "glossary", "# New\n\nOther words.").otherwise(F.col("text")))
    assert pipeline.ingest(changed, folder)["documents"] == 1
    store = sinks.LibraryStore(spark, folder)
    chunks, vectors = store.read("chunks"), store.read("vectors")
    assert chunks.count() == vectors.count() == 2 and chunks.where("text like '%Other words%'").count() == 1
    with pytest.raises(M.IndexMismatch):
        M.check_fingerprint("hashing:a:1", "hashing:b:2", 3)
    with pytest.raises(M.IndexMismatch):
        pipeline.ingest(docs, folder, embedder=HashingEmbedder(64))
    # Only the buckets of the changed document are rewritten.
    before = store.state()["tables"]
    pipeline.ingest(docs, folder)
    after = store.state()["tables"]
    moved = {b for t in before for b in after[t] if after[t][b] != before[t].get(b)}
    assert moved == {str(b) for b in store.touched(docs.where("doc_id = 'glossary'"))} and len(after["manifest"]) > 1
    assert store.vacuum() > 0 and store.read("chunks").where("text like '%sprocket turns%'").count() == 1


def test_a_crash_between_steps_changes_nothing(spark, docs, tmp_path, monkeypatch):
    folder = str(tmp_path / "store")
    pipeline.ingest(docs, folder)
    old = {t: sorted(map(str, sinks.LibraryStore(spark, folder).read(t).collect())) for t in sinks.LibraryStore.TABLES}
    changed = docs.withColumn("text", F.lit("# New\n\nOther words here."))
    real = sinks.write_text
    for where in ("parquet", "pointer"):
        with monkeypatch.context() as m:
            if where == "pointer":
                m.setattr(sinks, "write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            else:
                calls = []
                own = sinks.LibraryStore.bucket
                m.setattr(sinks.LibraryStore, "bucket", lambda self, *a: calls.append(1) or (own(self, *a) if len(calls) < 3 else 1 / 0))
            with pytest.raises((OSError, ZeroDivisionError)):
                pipeline.ingest(changed, folder)
        assert {t: sorted(map(str, sinks.LibraryStore(spark, folder).read(t).collect())) for t in old} == old
    assert sinks.write_text is real and pipeline.ingest(changed, folder)["documents"] == 4
    assert sinks.LibraryStore(spark, folder).read("chunks").where("text like '%Other words%'").count() == 4


def test_library(spark, tmp_path):
    (tmp_path / "docs" / "deep").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("# Fees\n\nThe dispute fee is 15.00 per case and refunds are free of charge.")
    (tmp_path / "docs" / "b.txt").write_text("Payouts are settled every Friday to the bank account on file.")
    (tmp_path / "docs" / "c.txt").write_text("   ")
    (tmp_path / "docs" / "deep" / "d.md").write_text("# Deep\n\nNot added.")
    lib = Library(spark, str(tmp_path / "store"))
    got = {r.name: r.reason for r in lib.add_directory(str(tmp_path / "docs")).collect()}
    assert got == {"a.md": None, "b.txt": None, "c.txt": "empty"}
    names = {r.filename: r.doc_id for r in lib.documents().collect()}
    assert sorted(names) == ["a.md", "b.txt"]
    question = spark.createDataFrame([("q", " What is the dispute fee per case? ")], "qid string, question string")
    row = projected(lib.ask(question, [names["a.md"]]), trace=True).first()
    assert "15.00" in row.text and not row.abstained and row.retrieved[0]["rank"] == 1 and row.citations[0]["chunk_id"] == row.retrieved[0]["chunk_id"]
    assert lib.passage(row.citations[0]["chunk_id"])["doc_id"] == names["a.md"] == lib.get(names["a.md"])["doc_id"]
    for call in (lambda: lib.passage("no"), lambda: lib.get("no"), lambda: lib.ask(question, ["no"]), lambda: lib.delete(["no"])):
        with pytest.raises(DocumentNotFound):
            call()
    with pytest.raises(ValueError):
        lib.ask(question.withColumn("question", F.lit("  ")))
    (tmp_path / "docs" / "a.md").write_text("# Fees\n\nThe dispute fee is 20.00 now, in every single case.")
    docs = L.load_documents(L.list_files(spark, str(tmp_path / "docs"), exclude=["b.txt"]), with_pdf=False)
    assert lib.sync(docs) == {"insert": 1, "update": 1, "delete": 1, "keep": 0}
    assert lib.delete([names["a.md"]]) == 1 and [r.filename for r in lib.documents().collect()] == ["d.md"]
    assert lib.store.read("vectors").count() == lib.store.read("chunks").count() == 1


def test_profiles_are_honoured(spark, docs):
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "source", "title", F.lit("").alias("section"), "text")
    full = config.load_config("full", env={})
    with pytest.raises(ValueError, match="sentence_transformers"):
        pipeline.index_chunks(chunks, config=full)
    corpus = pipeline.index_chunks(chunks)
    q = spark.createDataFrame([("q", "widget")], "qid string, question string")
    with pytest.raises(ValueError, match="rerank"):
        pipeline.rank(corpus, q, chunks, full)
    with pytest.raises(ValueError, match="generation"):
        pipeline.answer(corpus, q, full)


def test_stream_ingest(spark, docs, tmp_path):
    source = str(tmp_path / "in")
    docs.withColumn("ingested_at", F.lit("2025-01-01").cast("timestamp")).coalesce(1).write.parquet(source)
    stream = document_stream(spark, source)
    for _ in range(2):
        ingest_stream(stream, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    assert sinks.LibraryStore(spark, str(tmp_path / "store")).read("manifest").count() == 4
    q = arrivals(stream).writeStream.format("memory").queryName("arr").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(documents) from arr").first()[0] == 4


def test_upkeep(spark):
    old = spark.createDataFrame([("a", "h1"), ("b", "x"), ("gone", "y")], "doc_id string, content_hash string")
    now = spark.createDataFrame([("a", "t"), ("b", "u"), ("c", None)], "doc_id string, text string")
    old = old.withColumn("content_hash", F.when(F.col("doc_id") == "a", F.left(F.sha2(F.lit("t"), 256), F.lit(16))).otherwise(F.col("content_hash")))
    assert {r.doc_id: r.change for r in M.diff(now, old).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}
    assert {r.doc_id: r.action for r in M.sync_plan(now, old).collect()} == {"a": "keep", "b": "update", "c": "insert", "gone": "delete"}
    store = spark.createDataFrame([("k1", 1), ("k2", 2)], "k string, v int")
    once = M.upsert(store, spark.createDataFrame([("k2", 9), ("k3", 3)], "k string, v int"), "k")
    assert sorted(map(tuple, once.collect())) == [("k1", 1), ("k2", 9), ("k3", 3)]
    assert sorted(map(tuple, M.delete(once, store.where("k = 'k1'"), "k").collect())) == [("k2", 9), ("k3", 3)]
    files = spark.createDataFrame(
        [("d1", "a.md", "x", 1), ("d2", "b.png", "x", 1), ("d3", "c.md", "", 0), ("d4", "e.md", "x", 99), ("d5", "f.md", "x", 1)],
        "doc_id string, name string, text string, n_bytes int",
    )
    known = spark.createDataFrame([("d5", "other.md"), ("d1", "a.md")], "doc_id string, name string")
    got = {r.doc_id: r.reason for r in M.validate_uploads(files, known, 10).collect()}
    assert got == {"d1": None, "d2": "unsupported_type", "d3": "empty", "d4": "too_large", "d5": "duplicate_document"}


RESULT = (
    "id string, result_id long, answerable boolean, category string, difficulty string, abstained boolean, abstain_reason string, question string, "
    "citations array<string>, retrieved_sources array<string>, expected_sources array<string>, hit_at_1 boolean, recall_at_k boolean, reciprocal_rank double, "
    "faithfulness double, answer_f1 double, citation_precision double, correct_source_cited boolean, judge_score double, latency_ms double, input_tokens int, output_tokens int"
)


def results(spark, rows):
    base = ["1", 1, True, "c", "easy", False, "", "q", ["s1"], ["s0", "s0", "s2", "s1"], ["s1"], True, True, 1.0, 0.9, 0.5, 1.0, True, None, 10.0, 100, 20]
    names = [c.strip().split(" ")[0] for c in RESULT.split(", ")]
    made = [tuple((dict(zip(names, base, strict=True)) | r)[n] for n in names) for r in rows]
    return spark.createDataFrame(made, RESULT)


def test_item_scores(spark):
    rows = results(spark, [{}, {"id": "2", "answerable": False}, {"id": "3", "abstained": True}, {"id": "4", "citations": ["s1", "s9"]}, {"id": "5", "retrieved_sources": []}])
    got = {r.id: r for r in E.score_retrieval(rows).collect()}
    assert got["1"].reciprocal_rank == pytest.approx(1 / 3) and not got["1"].hit_at_1 and got["2"].hit_at_1 is None and got["5"].reciprocal_rank == 0
    cited = {r.id: r for r in E.score_citations(rows).collect()}
    assert cited["4"].citation_precision == 0.5 and cited["3"].citation_precision is None and cited["1"].correct_source_cited


def test_metrics_conventions(spark):
    empty = {r.metric: r.value for r in E.metrics_long(results(spark, [])).collect()}
    assert empty["abstention.abstention_recall"] == 1.0 and empty["retrieval.mrr"] == 0.0 and "operational.latency_p95_ms" not in empty
    rows = results(spark, [{"latency_ms": float(i)} for i in range(1, 8)] + [{"latency_ms": None, "abstained": True, "abstain_reason": "no_results"}])
    got = {r.metric: r.value for r in E.metrics_long(rows).collect()}
    assert got["operational.latency_p50_ms"] == 4.0 and got["abstention.false_abstention_rate"] == 0.125
    checks = {r.metric: r.passed for r in E.threshold_checks(E.metrics_long(results(spark, []))).collect()}
    assert not checks["operational.latency_p95_ms"]  # a missing metric fails
    assert E.exit_code(E.threshold_checks(E.metrics_long(rows))) == 1
    assert E.reason_histogram(rows).first().n == 1
    text = sinks.report_markdown(E.metrics_long(rows), E.breakdown(rows), E.notable_failures(rows))
    assert "Notable failures" in text and "false abstention (no_results)" in text
    with pytest.raises(ValueError):
        E.threshold_checks(E.metrics_long(rows), "nope")


def test_validator(spark):
    items = spark.createDataFrame(
        [
            ("1", "What is it?", "the widget fee costs fifteen euros", ["a.md"], True), ("1", "Other?", "", [], True), ("2", "what is it? ", "x", ["zz"], False),
            ("3", "Where do widgets ship?", "", [], False),
        ],
        "id string, question string, reference_answer string, expected_sources array<string>, answerable boolean",
    )
    corpus = spark.createDataFrame([("a.md", "Unrelated sprockets. Widgets ship in boxes.")], "source string, text string")
    got = {(r.id, r.issue) for r in E.validate_golden(items, corpus).collect()}
    assert ("1", "duplicate id") in got and ("2", "duplicate question text") in got and ("1", "answerable row has no expected_sources") in got
    assert ("1", "reference answer is not supported by its sources") in got and ("3", "every topical term is in the corpus") in got
    assert ("2", "unanswerable row must have an empty reference_answer") in got


def test_token_f1_and_overlap(spark):
    a, b = F.array(*map(F.lit, ["x", "x", "y"])), F.array(*map(F.lit, ["x", "z"]))
    none = F.array().cast("array<string>")
    row = spark.range(1).select(E.token_f1(a, b), E.token_f1(none, none), E.token_f1(a, none), E.overlap_ratio(a, b), E.overlap_ratio(none, b)).first()
    assert list(row) == pytest.approx([0.4, 1.0, 0.0, 2 / 3, 0.0])


def test_judge(spark):
    replies = ['say {"score": 0.5, "reason": "a {b}"} ok', "none", None, '{"faithfulness": 1}', "{broken", '{"score": "x"}', '```json\n{"score": 1}\n```']
    df = spark.createDataFrame([(x,) for x in replies], "r string")
    assert [r[0] for r in df.select(E.judge_score(F.col("r"))).collect()] == [0.5, None, None, 0.0, None, None, 1.0]
    rows = results(spark, [{}, {"id": "2", "result_id": 2, "abstained": True}]).withColumn("answer", F.lit("It is so. [S1]"))
    passages = spark.createDataFrame([("1", 2, "b"), ("1", 1, "a")], "id string, rank int, text string")
    prompt = Prompt("judge", "v1", "judge", "{question}|{context}|{answer}")
    got = E.judge(rows, passages, lambda system, user: '{"score": %s}' % (0.75 if user == "q|a\n\nb|It is so. [S1]" else 0.1), prompt).collect()
    assert {r.result_id: r.judge_score for r in got} == {1: 0.75, 2: None}
    outside = spark.createDataFrame([("1", 0.8)], "id string, faithfulness double")
    assert E.cross_check(rows, outside).first().asDict() == {"metric": "faithfulness", "n": 1, "own": 0.9, "outside": 0.8, "agree": True}


def test_config():
    c = config.load_config(env={"QUILL_RETRIEVAL__DENSE_K": "7", "QUILL_RERANK__ENABLED": "false"}, overrides={"chunking": {"min_tokens": 5}})
    assert c["retrieval"]["dense_k"] == 7 and c["rerank"]["enabled"] is False and c["chunking"]["min_tokens"] == 5
    assert config.load_config("full", env={})["citations"]["min_question_coverage"] == 0.45
    with pytest.raises(ValueError, match="offline"):
        config.load_config("nope", env={})
    assert config.missing_requirements(config.load_config("full", env={}), set())
    assert config.missing_requirements(config.load_config(env={}), set()) == []


def test_prompts():
    lib = PromptLibrary.from_mappings({
        "a.v1": {"system": "s {x}", "user": "{{raw}} {y}", "status": "superseded"}, "a.v2": {"system": "t {x}", "user": "u"}, "a.v3": {"system": "d", "user": "d", "status": "draft"},
    })
    assert lib.get("a").version == "v2" and lib.versions("a") == ["v1", "v2", "v3"]
    assert lib.get("a", "v1").render(x=1, y=2, z=3) == ("s 1", "{raw} 2")
    with pytest.raises(MissingVariable, match="x"):
        lib.get("a").render()
    with pytest.raises(KeyError):
        lib.get("a", "v9")
    with pytest.raises(ValueError):
        PromptLibrary([Prompt("b", "v1", "{q}", "", {"variables": ["other"]})])


def test_stores(spark, tmp_path):
    sinks.save_manifest(spark, str(tmp_path / "m.json"), {"a": 1})
    assert sinks.load_manifest(spark, str(tmp_path / "m.json"))["a"] == 1
    assert sinks.load_manifest(spark, str(tmp_path / "none.json")) == {}
    (tmp_path / "bad.json").write_text("{")
    assert sinks.load_manifest(spark, str(tmp_path / "bad.json")) == {}
    sinks.write_text(spark, str(tmp_path / "p"), "a")
    sinks.write_text(spark, str(tmp_path / "p"), "b")
    assert sinks.read_text(spark, str(tmp_path / "p")) == "b"
    assert sinks.LibraryStore(spark, str(tmp_path / "t")).read("chunks") is None


def test_session_helpers(spark):
    assert build_session is not None and is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)
    assert cut_lineage(spark.range(4)).count() == 4


def test_entry_without_llm(spark, monkeypatch):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert not [k for k in entry.queries() if k.startswith("p")and k[1].isdigit()]


def test_command_line(spark, tmp_path, capsys):
    from quillspark.__main__ import main

    assert main(["prompts"]) == 0
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.md").write_text("# Fees\n\nThe dispute fee is 15.00 per case and refunds are free.\n\n# Other\n\nTeal is the colour of buttons.")
    (tmp_path / "docs" / "b.md").write_text("# Payouts\n\nPayouts are settled every Friday to the bank account on file.")
    (tmp_path / "docs" / "c.txt").write_text("Sprockets turn slowly in winter months.")
    (tmp_path / "q.jsonl").write_text('{"qid": "1", "question": "What is the dispute fee per case?"}\n')
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    assert main(["answer", store, str(tmp_path / "q.jsonl"), out]) == 2
    assert main(["ingest", str(tmp_path / "docs"), store, "--no-pdf"]) == 0
    assert main(["stats", store]) == 0 and '"documents": 3' in capsys.readouterr().out
    assert main(["answer", store, str(tmp_path / "q.jsonl"), out]) == 0
    assert "15.00" in spark.read.parquet(out).first().text
    assert main(["answer", store, str(tmp_path / "q.jsonl"), out, "--doc-id", "nobody"]) == 2
