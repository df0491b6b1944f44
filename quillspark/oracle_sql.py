"""Oracles of :mod:`quillspark.queries`, key by key."""

from __future__ import annotations

from . import oracles as O
from .operators import evaluation
from .operators.maintenance import SUFFIXES
from .queries import EXPLANATIONS

ORACLES: dict[str, str] = {}
MARKER = r"\[\s*S(\d+)\s*\]"
SPACE = "array_to_string"


def _joined(x: str) -> str:
    return f"coalesce(array_to_string({x}, ' '), '')"


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


ORACLES["tokenize_docs"] = f"SELECT doc_id, CAST(len(t) AS INT) AS n, {_joined('t')} AS tokens FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)"
ORACLES["content_tokens"] = (
    f"SELECT chunk_id, CAST(len(t) AS INT) AS n, {_joined('t')} AS tokens FROM (SELECT chunk_id, {O.content(O.tokens('text'))} AS t FROM ({O.CHUNKS}))"
)
ORACLES["stem_vocab"] = f"""
WITH v AS (SELECT DISTINCT unnest({O.tokens('text')}) AS word FROM documents)
SELECT word, ({O.stems('[word]')})[1] AS stem FROM v"""
ORACLES["lexical_term_freq"] = f"""
WITH t AS (SELECT chunk_id, unnest({O.lexical('text')}) AS term FROM ({O.CHUNKS}))
SELECT term, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM t GROUP BY term"""
ORACLES["topical_terms"] = (
    f"SELECT id AS qid, {_joined(f'list_sort(list_distinct({O.topical("question")}))')} AS terms FROM ({O.ITEMS}) WHERE question IS NOT NULL"
)
ORACLES["token_count"] = f"SELECT chunk_id, {O.count_tokens('text')} AS tokens FROM ({O.CHUNKS})"
ORACLES["logical_lines"] = f"""
SELECT chunk_id, coalesce(array_to_string(list_filter(str_split({O.joined_lines('text')}, chr(1)), lambda x: x <> ''), chr(10)), '') AS lines
FROM ({O.CHUNKS}) WHERE text IS NOT NULL"""
ORACLES["sentence_split"] = f"""
WITH s AS (SELECT chunk_id, {O.sentences('text')} AS s FROM ({O.CHUNKS}) WHERE text IS NOT NULL)
SELECT chunk_id, CAST(i AS INT) AS pos, s[i + 1] AS sentence FROM (SELECT chunk_id, s, unnest(range(len(s))) AS i FROM s)"""

QUOTES = f"""
SELECT q.citation_id, q.qid, q.quote, c.text FROM (SELECT DISTINCT ON (citation_id) citation_id, qid, chunk_id, quote FROM citations) q
JOIN ({O.CHUNKS}) c USING (chunk_id)"""


def _overlap(c: str, r: str) -> str:
    hits = f"len(list_filter({c}, lambda t: list_contains({r}, t)))"
    return f"CASE WHEN len({c}) > 0 AND len({r}) > 0 THEN {hits} / len({c}) ELSE 0.0 END"


ORACLES["overlap_ratio_quotes"] = f"""
WITH q AS (SELECT citation_id, {O.lexical('quote')} AS c, {O.lexical('text')} AS r FROM ({QUOTES}))
SELECT citation_id, round({_overlap('c', 'r')}, 6) AS ratio FROM q"""
ORACLES["token_f1_answers"] = f"""
WITH i AS (SELECT a.id, a.answer, {O.lexical("regexp_replace(a.answer, '(?i)" + MARKER + "', '', 'g')")} AS p, {O.lexical('g.reference_answer')} AS r
  FROM (SELECT DISTINCT id, answer FROM ({O.RESULTS}) WHERE answer IS NOT NULL AND NOT abstained) a JOIN ({O.ITEMS}) g USING (id)),
p AS (SELECT id, answer, t, count(*) AS n FROM (SELECT id, answer, unnest(p) AS t FROM i) GROUP BY ALL),
r AS (SELECT id, answer, t, count(*) AS n FROM (SELECT id, answer, unnest(r) AS t FROM i) GROUP BY ALL),
c AS (SELECT id, answer, sum(least(p.n, r.n)) AS k FROM p JOIN r USING (id, answer, t) GROUP BY id, answer)
SELECT i.id, i.answer, round(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN coalesce(k, 0) = 0 THEN 0.0
  ELSE 2 * (k / len(p)) * (k / len(r)) / (k / len(p) + k / len(r)) END, 6) AS f1 FROM i LEFT JOIN c USING (id, answer)"""
ORACLES["claims_by_marker"] = f"""
WITH a AS (SELECT answer, {O.sentences('answer')} AS s FROM (SELECT DISTINCT answer FROM ({O.RESULTS}) WHERE answer IS NOT NULL)),
s AS (SELECT answer, i, s[i] AS x FROM (SELECT answer, s, unnest(range(1, len(s) + 1)) AS i FROM a)),
p AS (SELECT *, {O.strip("regexp_replace(x, '(?i)" + MARKER + "', '', 'g')")} AS prose FROM s),
l AS (SELECT *, coalesce(last_value(nullif(prose, '') IGNORE NULLS) OVER (PARTITION BY answer ORDER BY i ROWS UNBOUNDED PRECEDING), '') AS said FROM p),
m AS (SELECT answer, i, said, regexp_extract_all(x, '(?i){MARKER}', 1) AS ns FROM l),
u AS (SELECT answer, i, k, 'S' || ns[k] AS marker, said FROM (SELECT *, unnest(range(1, len(ns) + 1)) AS k FROM m))
SELECT answer, marker, string_agg(said, ' ' ORDER BY i, k) AS claim FROM u GROUP BY answer, marker"""
ORACLES["best_sentence"] = f"""
WITH q AS (SELECT x.citation_id, x.text, {O.sentences('x.text')} AS s, {O.lexical('i.question')} AS w
  FROM ({QUOTES}) x JOIN ({O.ITEMS}) i ON i.id = x.qid WHERE x.text IS NOT NULL AND i.question IS NOT NULL),
f AS (SELECT *, list_filter(s, lambda x: NOT regexp_matches(x, '^(#|\\||```|~~~)')) AS p FROM q),
g AS (SELECT citation_id, text, w, CASE WHEN len(p) > 0 THEN p ELSE s END AS s FROM f),
e AS (SELECT citation_id, w, s[i] AS x, i, {O.lexical('s[i]')} AS t FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM g)),
r AS (SELECT citation_id, x, row_number() OVER (PARTITION BY citation_id ORDER BY
  CASE WHEN len(w) = 0 OR len(t) = 0 THEN 0.0 ELSE round(len(list_filter(t, lambda y: list_contains(w, y))) / sqrt(len(t)), 12) END DESC, i) AS k FROM e)
SELECT g.citation_id, coalesce(r.x, left(g.text, 280)) AS sentence FROM g LEFT JOIN (SELECT * FROM r WHERE k = 1) r USING (citation_id)"""
ORACLES["truncate_text"] = f"SELECT chunk_id, {O.truncate('text', 320)} AS short FROM ({O.CHUNKS}) WHERE text IS NOT NULL"
ORACLES["content_hash"] = "SELECT doc_id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents"
ORACLES["numeric_questions"] = f"""
SELECT id AS qid, regexp_matches(question, '(?i)\\b(how (long|many|much|often)|what (is|are) the (fee|cost|price|limit|minimum|maximum|rate)|minimum|maximum|limit|deadline|window|threshold|percentage|percent|ratio|how big)\\b') AS numeric
FROM ({O.ITEMS}) WHERE question IS NOT NULL"""
ORACLES["marker_extract"] = f"""
SELECT result_id, coalesce(array_to_string(list_transform(regexp_extract_all(answer, '(?i)\\[\\s*S(\\d+)\\s*\\]', 1), lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ','), '') AS markers,
  regexp_replace(answer, '(?i)\\[\\s*S(\\d+)\\s*\\]', '', 'g') AS prose FROM ({O.RESULTS}) WHERE answer IS NOT NULL"""
_SPAN = "CASE WHEN starts_with(x, '**') THEN 'bold:' || substr(x, 3, length(x) - 4) WHEN starts_with(x, '`') THEN 'code:' || substr(x, 2, length(x) - 2) ELSE 'marker:' || substr(x, 2, length(x) - 2) END"
ORACLES["rich_text_tokens"] = f"""
SELECT result_id, coalesce(array_to_string(flatten(list_transform(regexp_extract_all(answer, '\\*\\*.+?\\*\\*|`[^`]+`|\\[S\\d+\\]'), lambda x:
  CASE WHEN starts_with(x, '**') THEN list_concat([{_SPAN}], list_transform(regexp_extract_all(x, '`[^`]+`|\\[S\\d+\\]'), lambda x: {_SPAN})) ELSE [{_SPAN}] END)), '|'), '') AS spans
FROM ({O.RESULTS}) WHERE answer IS NOT NULL"""
ORACLES["display_formats"] = f"""
WITH d AS (SELECT doc_id, source, CAST(length(coalesce(text, '')) AS BIGINT) * 977 AS b FROM ({O.DOCS}))
SELECT doc_id, regexp_extract(source, '[^/\\\\]*$') AS basename, b AS n_bytes,
  CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN CAST(floor(b / 1024 + 0.5) AS BIGINT) || ' KB'
    ELSE regexp_replace(printf('%.1f', floor(b / 104857.6 + 0.5) / 10), '\\.0$', '') || ' MB' END AS size,
  CASE WHEN b / 7 >= 1000 THEN printf('%.1f', floor(b / 7 / 100 + 0.5) / 10) || ' s' ELSE CAST(floor(b / 7 + 0.5) AS BIGINT) || ' ms' END AS duration FROM d"""
_REASONS = f"SELECT abstain_reason, count(*) AS n FROM ({O.RESULTS}) WHERE abstained AND abstain_reason <> '' GROUP BY 1"
ORACLES["abstain_explanations"] = (
    "SELECT abstain_reason, CASE abstain_reason " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in EXPLANATIONS.items())
    + f" END AS explanation, n FROM ({_REASONS})"
)
ORACLES["reason_histogram"] = _REASONS
ORACLES["quote_highlight"] = f"""
WITH q AS (SELECT citation_id, text, regexp_replace(quote, '…+$', '') AS quote FROM ({QUOTES}) WHERE coalesce(quote, '') <> '' AND text IS NOT NULL),
p AS (SELECT *, CAST(strpos(text, quote) AS INT) AS place FROM q WHERE quote <> '')
SELECT citation_id, place, CASE WHEN place > 0 THEN CAST(place - 1 AS INT) ELSE -1 END AS n_before,
  CASE WHEN place > 0 THEN CAST(length(text) - place - length(quote) + 1 AS INT) ELSE -1 END AS n_after FROM p"""

# --- sources ---
_STEM = "regexp_replace(regexp_extract(source, '[^/]*$'), '^(.+)\\.[^.]*$', '\\1')"
_ID = (
    f"coalesce(nullif(regexp_replace(regexp_replace(lower({_STEM}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'doc') || '-' || left(sha1(source), 8)"
)
ORACLES["doc_id_slug"] = f"SELECT doc_id, {_ID} AS derived FROM ({O.DOCS})"
ORACLES["safe_filename"] = f"""
WITH n AS (SELECT doc_id, title || ' ?*' || regexp_extract(source, '(\\.[a-z]+)$', 1) AS name FROM ({O.DOCS})),
b AS (SELECT *, {O.strip("regexp_extract(name, '[^/]*$')")} AS base FROM n),
s AS (SELECT *, lower(regexp_extract(base, '(\\.[^.]*)$', 1)) AS suffix,
  left(regexp_replace(regexp_replace(regexp_replace(base, '\\.[^.]*$', ''), '[^A-Za-z0-9._ -]+', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), 100) AS stem FROM b)
SELECT doc_id, name, CASE WHEN suffix IN ({O.text_list(SUFFIXES)}) THEN CASE WHEN stem = '' THEN 'document'
  WHEN regexp_full_match(lower(stem), 'con|prn|aux|nul|com[1-9]|lpt[1-9]') THEN '_' || stem ELSE stem END || suffix END AS safe FROM s"""
_FRONT = "regexp_matches(text, '^---\\s*\\n(?s:.*?)\\n---\\s*\\n')"
_BODY = f"CASE WHEN {_FRONT} THEN regexp_replace(text, '^---\\s*\\n(?s:.*?)\\n---\\s*\\n', '') ELSE text END"
_FIELD = lambda k: f"CASE WHEN {_FRONT} THEN nullif(trim(regexp_extract(regexp_extract(text, '^---\\s*\\n((?s:.*?))\\n---\\s*\\n', 1), '(?m)^{k}:\\s*([^\\r\\n]*)', 1)), '') END"
ORACLES["frontmatter_parse"] = f"""
SELECT doc_id, {_FIELD('title')} AS title, {_FIELD('owner')} AS owner, CAST(length({_BODY}) AS INT) AS body_chars FROM ({O.DOCS}) WHERE text IS NOT NULL"""
_MDTITLE = f"CASE WHEN regexp_matches(body, '^[{O.WS}]*# ') THEN {O.strip(f"regexp_extract(body, '^[{O.WS}]*# ([^{chr(92)}r{chr(92)}n]*)', 1)")} END"
ORACLES["markdown_title"] = f"SELECT doc_id, {_MDTITLE} AS title FROM (SELECT doc_id, {_BODY} AS body FROM ({O.DOCS}) WHERE text IS NOT NULL)"
ORACLES["markdown_load"] = f"""
WITH d AS (SELECT source, {_FIELD('title')} AS t, {_BODY} AS body FROM ({O.DOCS}) WHERE text IS NOT NULL AND regexp_matches(lower(source), '\\.(md|markdown|mdown)$'))
SELECT {_ID} AS doc_id, source, coalesce(t, {_MDTITLE}, {_STEM}) AS title, {O.strip('body')} AS text, 'markdown' AS content_type FROM d"""
ORACLES["text_load"] = f"""
SELECT {_ID} AS doc_id, source, {_STEM} AS title, {O.strip('text')} AS text, 'text' AS content_type FROM ({O.DOCS})
WHERE text IS NOT NULL AND regexp_matches(lower(source), '\\.(txt|text|rst)$')"""
ORACLES["loader_dispatch"] = f"""
SELECT CASE WHEN regexp_matches(lower(source), '\\.(md|markdown|mdown)$') THEN 'markdown' WHEN regexp_matches(lower(source), '\\.(txt|text|rst)$') THEN 'text'
  WHEN regexp_matches(lower(source), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(source), '\\.html?$') THEN 'html' ELSE 'unsupported' END AS kind, count(*) AS n
FROM ({O.DOCS}) GROUP BY 1"""
ORACLES["glob_match"] = f"""
SELECT doc_id, source FROM ({O.DOCS}) WHERE (regexp_matches(source, '(^|/)[^/]+/[^/]*\\.md$') OR regexp_matches(source, '(^|/)[^/]*\\.txt$'))
  AND NOT regexp_matches(source, '(^|/)[^/]+/re[^/]*-[^/]*\\.md$')"""
ORACLES["pdf_page_stitch"] = f"""
WITH p AS (SELECT doc_id AS source, ordinal + 1 AS page, {O.strip("coalesce(text, '')")} AS b FROM ({O.CHUNKS}))
SELECT source, coalesce(string_agg('## Page ' || page || chr(10) || chr(10) || b, chr(10) || chr(10) ORDER BY page, b) FILTER (b <> ''), '') AS text FROM p GROUP BY source"""
ORACLES["dedup_documents"] = "SELECT min(doc_id) AS doc_id, left(sha256(coalesce(text, '')), 16) AS hash FROM documents GROUP BY 2"

# --- sparse ---
_BODY_OF = "concat_ws(' ', coalesce(title, ''), coalesce(section, ''), coalesce(text, ''))"
BM25 = f"""
c AS ({O.CHUNKS}),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({O.lexical(_BODY_OF)}) AS term FROM c) GROUP BY ALL),
dl AS (SELECT chunk_id, sum(tf) AS dl FROM post GROUP BY 1),
st AS (SELECT count(*) AS ndocs, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, count(*) AS df, ln(ndocs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term, ndocs),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
_Q = f"q AS (SELECT id AS qid, question FROM ({O.ITEMS}) WHERE question IS NOT NULL)"
_SCORED = f"""{BM25}, {_Q},
qt AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest({O.lexical('question')}) AS term FROM q) GROUP BY ALL),
sc AS (SELECT qid, chunk_id, sum(n * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), st GROUP BY 1, 2)"""
_TOP = """SELECT qid, chunk_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, chunk_id) AS rank FROM {src} WHERE round(score, 6) > 0) WHERE rank <= {k}"""
ORACLES["bm25_idf"] = f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["idf_max"] = f"WITH {BM25} SELECT ndocs, round(avgdl, 6) AS avgdl, round((SELECT max(idf) FROM idf), 6) AS max_idf FROM st"
ORACLES["bm25_topk"] = f"WITH {_SCORED} {_TOP.format(src='sc', k=20)}"
ORACLES["bm25_scoped_topk"] = f"""WITH {_SCORED},
ok AS (SELECT chunk_id FROM c WHERE doc_id IN (SELECT doc_id FROM ({O.DOCS}) WHERE source IN (SELECT unnest(expected_sources) FROM ({O.ITEMS})))),
s2 AS (SELECT * FROM sc SEMI JOIN ok USING (chunk_id)) {_TOP.format(src='s2', k=5)}"""

# --- dense ---
ORACLES["vector_l2_normalize"] = """
WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings)
SELECT vec_id, CAST(i AS INT) AS pos, round(e[i + 1] / CASE WHEN n = 0 THEN 1 ELSE n END, 5) AS x FROM (SELECT *, unnest(range(len(e))) AS i FROM n)"""
_NEAR = """
WITH p AS (SELECT a.vec_id AS qid, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
  FROM (SELECT * FROM embeddings WHERE vec_id % 20 = 0) a, (SELECT * FROM embeddings WHERE {where}) b),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 6) DESC, vec_id) AS rank FROM p)
SELECT qid, vec_id, round(s, 4) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= {k}"""
ORACLES["cosine_topk"] = _NEAR.format(where="true", k=10)
ORACLES["cosine_scoped_topk"] = _NEAR.format(where="label < 5", k=5)

# --- fusion ---
_FUSE = """cand AS ({c}), f AS (SELECT qid, chunk_id, dense_rank, lexical_rank, CAST({score} AS DOUBLE) AS fusion_score,
  CASE WHEN {d} IS NOT NULL AND {x} IS NOT NULL THEN 'hybrid' WHEN {d} IS NOT NULL THEN 'dense' ELSE 'lexical' END AS retriever
  FROM cand WHERE {where}),
fused AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(fusion_score, 9) DESC NULLS LAST,
  {d} ASC NULLS LAST, {x} ASC NULLS LAST) AS INT) AS fused_rank FROM f) WHERE fused_rank <= 24)"""


def _fuse(mode: str) -> str:
    return {
        "rrf": _FUSE.format(c=O.CANDIDATES, score="coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0)",
                            d="dense_rank", x="lexical_rank", where="dense_rank IS NOT NULL OR lexical_rank IS NOT NULL"),
        "dense": _FUSE.format(c=O.CANDIDATES, score="dense_score", d="dense_rank", x="NULL::INT", where="dense_rank IS NOT NULL"),
        "lexical": _FUSE.format(c=O.CANDIDATES, score="lexical_score", d="NULL::INT", x="lexical_rank", where="lexical_rank IS NOT NULL"),
    }[mode]


_FUSED = " SELECT qid, chunk_id, round(fusion_score, 9) AS fusion_score, retriever, fused_rank FROM fused"
ORACLES["rrf_fusion"] = "WITH " + _fuse("rrf") + _FUSED
ORACLES["fusion_dense_only"] = "WITH " + _fuse("dense") + _FUSED
ORACLES["fusion_lexical_only"] = "WITH " + _fuse("lexical") + _FUSED
ORACLES["fusion_provenance"] = f"""
SELECT CASE WHEN dense_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'hybrid' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'lexical' END AS retriever,
  count(*) AS n FROM ({O.CANDIDATES}) GROUP BY 1"""
_HYD = _fuse("rrf") + ", hyd AS (SELECT f.*, c.doc_id, c.source, c.title, c.section, c.text FROM fused f JOIN c USING (chunk_id))"
ORACLES["fusion_hydrate"] = f"WITH c AS ({O.CHUNKS}), {_HYD} SELECT qid, chunk_id, doc_id, section, fused_rank FROM hyd"

# --- rerank ---
RERANK = f"""{BM25}, {_Q}, {_HYD},
qw AS (SELECT qid, term, greatest(coalesce(idf, (SELECT max(idf) FROM idf)), 0.01) AS w
  FROM (SELECT qid, unnest(list_distinct({O.lexical('question')})) AS term FROM q) LEFT JOIN idf USING (term)),
qs AS (SELECT qid, sum(w) AS total FROM qw GROUP BY 1),
qn AS (SELECT qid, {O.normalize('question')} AS qnorm FROM q),
ct AS (SELECT chunk_id, {O.lexical("coalesce(text, '')")} AS body, {O.lexical("coalesce(section, '')")} AS sec, {O.normalize("coalesce(text, '')")} AS bnorm
  FROM c WHERE chunk_id IN (SELECT chunk_id FROM hyd)),
bt AS (SELECT chunk_id, t AS term, count(*) AS n FROM (SELECT chunk_id, unnest(body) AS t FROM ct) GROUP BY ALL),
stm AS (SELECT DISTINCT chunk_id, unnest(sec) AS term FROM ct),
hb AS (SELECT h.qid, h.chunk_id, sum(w) AS cov, sum(w * n) AS m FROM hyd h JOIN qw USING (qid) JOIN bt ON bt.chunk_id = h.chunk_id AND bt.term = qw.term GROUP BY 1, 2),
hs AS (SELECT h.qid, h.chunk_id, sum(w) AS head FROM hyd h JOIN qw USING (qid) JOIN stm ON stm.chunk_id = h.chunk_id AND stm.term = qw.term GROUP BY 1, 2),
rr AS (SELECT h.*, CASE WHEN coalesce(total, 0) <= 0 OR len(body) = 0 THEN 0.0 ELSE least(1.0, 0.60 * coalesce(cov, 0) / total
  + 0.25 * least(1.0, coalesce(m, 0) / (total * sqrt(len(body)))) + 0.15 * coalesce(head, 0) / total
  + CASE WHEN contains(qnorm, ' ') AND contains(bnorm, qnorm) THEN 0.25 ELSE 0 END) END AS rerank_score
  FROM hyd h JOIN ct USING (chunk_id) LEFT JOIN qs USING (qid) LEFT JOIN qn USING (qid) LEFT JOIN hb USING (qid, chunk_id) LEFT JOIN hs USING (qid, chunk_id)),
top AS (SELECT * FROM (SELECT *, rerank_score AS score, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(rerank_score, 6) DESC, fused_rank) AS INT) AS rank FROM rr) WHERE rank <= 5)"""
ORACLES["lexical_rerank"] = f"WITH {RERANK} SELECT qid, chunk_id, round(rerank_score, 6) AS rerank_score FROM rr"
ORACLES["rerank_topn"] = f"WITH {RERANK} SELECT qid, chunk_id, round(score, 6) AS score, rank FROM top"
ORACLES["rerank_disabled"] = (
    f"WITH c AS ({O.CHUNKS}), {_HYD} SELECT qid, chunk_id, round(fusion_score, 9) AS score, fused_rank AS rank FROM hyd WHERE fused_rank <= 5"
)

# --- answering ---
ORACLES["relevance_gate"] = f"""WITH {RERANK},
n AS (SELECT qid, count(*) AS r, count(*) FILTER (round(score, 9) >= 0.35) AS e FROM top GROUP BY 1)
SELECT q.qid, coalesce(r, 0) AS retrieved_n, coalesce(e, 0) AS eligible_n,
  CASE WHEN coalesce(r, 0) = 0 THEN 'no_results' WHEN coalesce(e, 0) < 1 THEN 'low_relevance' END AS reason FROM q LEFT JOIN n USING (qid)"""
ORACLES["coverage_gate"] = f"""WITH {BM25}, {_Q},
t AS (SELECT qid, unnest(list_distinct({O.topical('question')})) AS term FROM q),
w AS (SELECT qid, idf, greatest(coalesce(idf, (SELECT max(idf) FROM idf)), 0.01) AS w FROM t LEFT JOIN idf USING (term)),
g AS (SELECT qid, round(coalesce(sum(w) FILTER (idf IS NOT NULL), 0) / sum(w), 4) AS coverage FROM w GROUP BY 1)
SELECT q.qid, round(coalesce(coverage, 1.0), 3) AS coverage, CASE WHEN coalesce(coverage, 1.0) < 0.6 THEN 'question_not_covered' END AS reason
FROM q LEFT JOIN g USING (qid)"""
_BLOCKS = """b AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY rank) AS INT) AS marker_no, {body} AS body FROM top WHERE round(score, 9) >= 0.1),
u AS (SELECT *, CAST(sum(length(body)) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM b),
k AS (SELECT * FROM u WHERE marker_no = 1 OR used <= {most})"""
ORACLES["context_budget"] = (
    f"WITH {RERANK}, {_BLOCKS.format(body=O.truncate("coalesce(text, '')", 300), most=900)} SELECT qid, marker_no, chunk_id, CAST(length(body) AS INT) AS n_chars, used FROM k"
)
ORACLES["render_context"] = f"""WITH {RERANK}, {_BLOCKS.format(body=O.truncate("coalesce(text, '')", 2000), most=12000)}
SELECT qid, string_agg('[S' || marker_no || '] source: ' || coalesce(source, '') ||
  CASE WHEN coalesce(section, '') <> '' THEN ' | section: ' || section ELSE '' END || chr(10) || body, chr(10) || chr(10) ORDER BY marker_no) AS context FROM k GROUP BY qid"""
ORACLES["grounding"] = f"""
WITH s AS (SELECT qid, string_agg(text, chr(10)) AS support FROM (SELECT DISTINCT qid, text FROM ({QUOTES})) GROUP BY 1),
a AS (SELECT DISTINCT id AS qid, answer FROM ({O.RESULTS}) WHERE answer IS NOT NULL AND NOT abstained),
t AS (SELECT qid, answer, {O.lexical("regexp_replace(answer, '(?i)\\[\\s*S(\\d+)\\s*\\]', '', 'g')")} AS c, {O.lexical('support')} AS r FROM a JOIN s USING (qid))
SELECT qid, answer, round({_overlap('c', 'r')}, 6) AS grounding FROM t"""

# --- chunk identity ---
ORACLES["chunk_identity"] = f"""
SELECT chunk_id, doc_id || '::' || lpad(CAST(ordinal AS VARCHAR), CAST(greatest(4, length(CAST(ordinal AS VARCHAR))) AS INT), '0') AS derived_id,
  CASE WHEN coalesce(section, '') <> '' THEN source || '#' || section ELSE source END AS locator,
  md5(CASE WHEN coalesce(title, '') = '' AND coalesce(section, '') = '' THEN coalesce(text, '') ELSE
    concat_ws(' — ', nullif(title, ''), nullif(section, '')) || chr(10) || chr(10) || coalesce(text, '') END) AS embedding_text_md5 FROM ({O.CHUNKS})"""

# --- maintenance ---
_HASH = "left(sha256(coalesce(text, '')), 16)"
_MANIFEST = f"SELECT doc_id, CASE WHEN coalesce(n_chars = length(text), false) THEN {_HASH} ELSE 'stale' END AS o FROM documents WHERE ingested_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'"
ORACLES["incremental_diff"] = f"""
SELECT d.doc_id, {_HASH} AS content_hash, CASE WHEN o IS NULL THEN 'new' WHEN o <> {_HASH} THEN 'changed' ELSE 'unchanged' END AS change
FROM documents d LEFT JOIN ({_MANIFEST}) m USING (doc_id)"""
ORACLES["sync_classify"] = f"""
WITH n AS (SELECT doc_id, {_HASH} AS h FROM documents WHERE trim(coalesce(text, ''), ' ') <> '')
SELECT CASE WHEN h IS NULL THEN 'delete' WHEN o IS NULL THEN 'insert' WHEN h <> o THEN 'update' ELSE 'keep' END AS action, count(*) AS n,
  CAST(sum(doc_id) AS BIGINT) AS id_sum FROM n FULL JOIN ({_MANIFEST}) m USING (doc_id) GROUP BY 1"""
ORACLES["upsert_chunks"] = f"""
WITH late AS (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, section, CAST(length(coalesce(text, '')) AS INT) AS n FROM chunks WHERE indexed_at >= TIMESTAMPTZ '2025-02-01 00:00:00+00')
SELECT chunk_id, doc_id, section, -1 AS n FROM ({O.CHUNKS}) ANTI JOIN late USING (chunk_id) UNION ALL SELECT * FROM late"""
ORACLES["delete_documents"] = f"""
SELECT doc_id, count(*) AS chunks FROM ({O.CHUNKS}) WHERE doc_id NOT IN (SELECT doc_id FROM ({O.DOCS}) WHERE trim(coalesce(text, ''), ' ') = '') GROUP BY 1"""
ORACLES["upload_validate"] = f"""
WITH l AS (SELECT DISTINCT ON (doc_id) doc_id, source, text, metadata FROM library_docs),
f AS (SELECT regexp_extract(source, '[^/]*$') AS name, text, octet_length(encode(coalesce(text, ''))) AS b, metadata['owner'] IS NOT NULL AS other FROM l)
SELECT CASE WHEN NOT regexp_matches(lower(name), '\\.(md|markdown|mdown|txt|text|rst|pdf|html|htm)$') THEN 'unsupported_type' WHEN b = 0 THEN 'empty' WHEN b > 1200 THEN 'too_large'
  WHEN trim(coalesce(text, ''), ' ') = '' THEN 'empty' WHEN other THEN 'duplicate_document' ELSE 'accepted' END AS reason, count(*) AS n FROM f GROUP BY 1"""
_LIST = f"SELECT d.doc_id, d.source, d.title, {_HASH} AS content_hash, coalesce(n, 0) AS chunks FROM ({O.DOCS}) d LEFT JOIN (SELECT doc_id, count(*) AS n FROM ({O.CHUNKS}) GROUP BY 1) USING (doc_id)"
ORACLES["library_listing"] = f"SELECT doc_id, regexp_extract(source, '[^/]*$') AS filename, title, content_hash, chunks FROM ({_LIST})"
ORACLES["manifest_stats"] = f"SELECT count(*) AS documents, CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks FROM ({_LIST})"
ORACLES["unknown_documents"] = f"""
SELECT DISTINCT doc_id FROM (SELECT unnest(expected_sources) AS doc_id FROM ({O.ITEMS})) WHERE doc_id NOT IN (SELECT source FROM ({O.DOCS}))"""

# --- evaluation ---
_DISTINCT = "list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_RANKS = f"list_filter(list_transform({_DISTINCT.format(c='retrieved_sources')}, lambda s, i: CASE WHEN list_contains(expected_sources, s) THEN i END), lambda r: r IS NOT NULL)"
ORACLES["hit_mrr"] = f"""
WITH r AS (SELECT result_id, answerable AND len(expected_sources) > 0 AS ok, ({_RANKS})[1] AS k FROM ({O.RESULTS}))
SELECT result_id, CASE WHEN ok THEN CAST(coalesce(k = 1, false) AS VARCHAR) END AS hit_at_1, CASE WHEN ok THEN CAST(k IS NOT NULL AS VARCHAR) END AS recall_at_k,
  CASE WHEN ok THEN round(coalesce(1.0::DOUBLE / k, 0), 6) END AS reciprocal_rank FROM r"""
ORACLES["citation_precision"] = f"""
WITH r AS (SELECT result_id, answerable AND NOT abstained AND len(expected_sources) > 0 AS ok, list_distinct(citations) AS c, expected_sources AS e FROM ({O.RESULTS})),
h AS (SELECT *, len(list_filter(c, lambda s: list_contains(e, s))) AS g FROM r)
SELECT result_id, CASE WHEN ok THEN CASE WHEN len(c) > 0 THEN round(round(g / len(c), 4), 3) ELSE 0.0 END END AS citation_precision,
  CASE WHEN ok THEN CAST(g > 0 AS VARCHAR) END AS correct_source_cited FROM h"""


def _m(cond: str, c: str) -> str:
    return f"coalesce(round(avg(CASE WHEN {cond} AND NOT isnan({c}::DOUBLE) THEN {c}::DOUBLE END), 4), 0.0)"


def _r(a: str, b: str) -> str:
    return f"CASE WHEN count(*) FILTER ({b}) = 0 THEN 1.0 ELSE round(count(*) FILTER ({a}) / (count(*) FILTER ({b})), 4) END"


_AN, _AD = "answerable", "answerable AND NOT abstained"
METRICS = {
    "counts.total": "count(*)", "counts.answerable": f"count(*) FILTER ({_AN})", "counts.unanswerable": "count(*) FILTER (NOT answerable)",
    "counts.answered": f"count(*) FILTER ({_AD})", "counts.abstained": "count(*) FILTER (abstained)",
    "retrieval.hit_at_1": _m(_AN, "hit_at_1::INT"), "retrieval.recall_at_k": _m(_AN, "recall_at_k::INT"), "retrieval.mrr": _m(_AN, "reciprocal_rank"),
    "answer_quality.faithfulness": _m(_AD, "faithfulness"), "answer_quality.answer_f1": _m(_AD, "answer_f1"),
    "answer_quality.citation_precision": _m(_AD, "citation_precision"), "answer_quality.correct_source_cited_rate": _m(_AD, "correct_source_cited::INT"),
    "answer_quality.answer_citation_rate": _m(_AD, "(len(citations) > 0)::INT"),
    "answer_quality.llm_judge_faithfulness": f"round(avg(CASE WHEN {_AD} THEN judge_score END), 4)",
    "abstention.abstention_recall": _r("NOT answerable AND abstained", "NOT answerable"),
    "abstention.abstention_precision": _r("NOT answerable AND abstained", "abstained"),
    "abstention.false_abstention_rate": _r("answerable AND abstained", "answerable"),
    "operational.mean_input_tokens": "trunc(coalesce(avg(input_tokens), 0))", "operational.mean_output_tokens": "trunc(coalesce(avg(output_tokens), 0))",
    "operational.latency_p50_ms": "round(quantile_disc(latency_ms, 0.5) FILTER (NOT isnan(latency_ms)), 2)",
    "operational.latency_p95_ms": "round(quantile_disc(latency_ms, 0.95) FILTER (NOT isnan(latency_ms)), 2)",
}
_NEAREST = """round(list_extract(list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL AND NOT isnan(latency_ms))),
  CAST(least(round_even({p} * (count(*) FILTER (latency_ms IS NOT NULL AND NOT isnan(latency_ms)) - 1), 0), count(*) FILTER (latency_ms IS NOT NULL AND NOT isnan(latency_ms)) - 1) AS BIGINT) + 1), 2)"""
METRICS["operational.latency_p50_ms"], METRICS["operational.latency_p95_ms"] = _NEAREST.format(p="0.5::DOUBLE"), _NEAREST.format(p="0.95::DOUBLE")


def _metrics(source: str) -> str:
    wide = ", ".join(f'CAST({v} AS DOUBLE) AS "{k}"' for k, v in METRICS.items())
    return f"SELECT * FROM (UNPIVOT (SELECT {wide} FROM ({source})) ON COLUMNS(*) INTO NAME metric VALUE value) WHERE value IS NOT NULL"


ORACLES["headline_metrics"] = f"SELECT metric, round(value, 3) AS value FROM ({_metrics(O.RESULTS)})"
ORACLES["abstention_metrics"] = "SELECT run_id, " + ", ".join(
    f"round({METRICS['abstention.' + m]}, 3) AS {m}" for m in ("abstention_recall", "abstention_precision", "false_abstention_rate")
) + f" FROM ({O.RESULTS}) GROUP BY run_id"
ORACLES["percentile_nearest_rank"] = f"""
WITH r AS (SELECT run_id, latency_ms FROM ({O.RESULTS}) WHERE latency_ms IS NOT NULL AND NOT isnan(latency_ms)),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM r)
SELECT run_id, pct, round(latency_ms, 2) AS value FROM k, (VALUES (50.0::DOUBLE), (95.0::DOUBLE)) p(pct)
WHERE i = least(round_even(pct / 100 * (n - 1), 0), n - 1)"""
_SIDE = """SELECT '{c}' AS dimension, coalesce(nullif({c}, ''), 'unknown') AS name, count(*) AS n, round({a}, 3) AS recall_at_k, round({f}, 3) AS faithfulness,
  round({t}, 3) AS answer_f1, count(*) FILTER (abstained) AS abstained FROM ({r}) GROUP BY 2"""
ORACLES["breakdown_by_dimension"] = " UNION ALL ".join(
    _SIDE.format(c=c, a=_m(_AN, "recall_at_k::INT"), f=_m(_AD, "faithfulness"), t=_m(_AD, "answer_f1"), r=O.RESULTS) for c in ("difficulty", "category")
)
_LIMITS = ", ".join(f"('{g}.{m}', '{b}', {v}::DOUBLE)" for g, m, b, v in evaluation.THRESHOLDS["offline"])
ORACLES["threshold_gate"] = f"""
SELECT l.metric, bound, limit_value, round(value, 3) AS value,
  coalesce(CASE bound WHEN 'min' THEN value >= limit_value ELSE value <= limit_value END, false) AS passed
FROM (VALUES {_LIMITS}) l(metric, bound, limit_value) LEFT JOIN ({_metrics(O.RESULTS)}) m USING (metric)"""
_ONE = f"SELECT * FROM ({O.RESULTS}) WHERE lower(trim(difficulty)) = "
ORACLES["baseline_deltas"] = f"""
SELECT b.metric, round(b.value, 2) AS baseline, round(c.value, 2) AS current, round(round(c.value - b.value, 4), 2) + 0.0 AS delta
FROM ({_metrics(_ONE + "'easy'")}) b JOIN ({_metrics(_ONE + "'hard'")}) c USING (metric)
WHERE str_split(b.metric, '.')[1] IN ('retrieval', 'answer_quality', 'abstention')"""
ORACLES["notable_failures"] = f"""
SELECT issue, count(*) AS n, CAST(sum(result_id) AS BIGINT) AS id_sum FROM (SELECT result_id,
  CASE WHEN NOT answerable AND NOT abstained THEN 'answered an unanswerable question' WHEN answerable AND abstained THEN 'false abstention (' || abstain_reason || ')'
    WHEN answerable AND NOT recall_at_k THEN 'correct document not retrieved' END AS issue FROM ({O.RESULTS})) WHERE issue IS NOT NULL GROUP BY 1"""
ORACLES["judge_json_parse"] = f"SELECT result_id, CASE WHEN NOT isnan(judge_score) THEN judge_score END AS score FROM ({O.RESULTS})"
_SUPPORTED = "(SELECT DISTINCT ON (source) source, text FROM (" + O.DOCS + ") WHERE source IS NOT NULL)"
ORACLES["golden_validator"] = f"""
WITH g AS (SELECT coalesce(id, '<missing id>') AS id, question, coalesce(answerable, true) AS ok, {O.strip("coalesce(reference_answer, '')")} AS ref,
  coalesce(expected_sources, []) AS src FROM ({O.ITEMS})),
d AS (SELECT source, {O.lexical("coalesce(text, '')")} AS t FROM {_SUPPORTED}),
v AS (SELECT DISTINCT source, unnest(t) AS term FROM d),
w AS (SELECT id, ref, unnest(src) AS source FROM g WHERE ok),
t AS (SELECT id, source, term, count(*) AS n FROM (SELECT id, source, unnest({O.lexical('ref')}) AS term FROM w) GROUP BY ALL),
h AS (SELECT t.id, t.term, max(n) AS n, max(CASE WHEN v.term IS NULL THEN 0 ELSE 1 END) AS hit FROM t LEFT JOIN v USING (source, term) GROUP BY t.id, t.term),
low AS (SELECT id FROM h GROUP BY id HAVING sum(n) >= 4 AND sum(n * hit) / sum(n) < 0.55),
q AS (SELECT DISTINCT id, unnest({O.topical("coalesce(question, '')")}) AS term FROM g WHERE NOT ok),
i AS (
  SELECT 'error' AS level, 'missing required field ''id''' AS issue FROM g WHERE id = '<missing id>'
  UNION ALL SELECT 'error', 'missing required field ''question''' FROM g WHERE coalesce(question, '') = ''
  UNION ALL SELECT 'error', 'answerable row has no reference_answer' FROM g WHERE ok AND ref = ''
  UNION ALL SELECT 'error', 'answerable row has no expected_sources' FROM g WHERE ok AND len(src) = 0
  UNION ALL SELECT 'error', 'unanswerable row must have an empty reference_answer' FROM g WHERE NOT ok AND ref <> ''
  UNION ALL SELECT 'error', 'unanswerable row must have no expected_sources' FROM g WHERE NOT ok AND len(src) > 0
  UNION ALL SELECT 'error', 'duplicate id' FROM g GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'warning', 'duplicate question text' FROM (SELECT lower({O.strip("coalesce(question, '')")}) AS k FROM g) GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'error', 'expected source does not exist: ' || source FROM w WHERE source NOT IN (SELECT source FROM d)
  UNION ALL SELECT 'error', 'reference answer is not supported by its sources' FROM low WHERE id IN (SELECT id FROM w JOIN d USING (source))
  UNION ALL SELECT 'warning', 'every topical term is in the corpus' FROM (SELECT id FROM q GROUP BY id HAVING bool_and(term IN (SELECT term FROM v))))
SELECT level, issue, count(*) AS n FROM i GROUP BY ALL"""
