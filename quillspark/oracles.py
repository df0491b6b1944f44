"""SQL fragments that say the same as the text functions, for DuckDB."""

from __future__ import annotations

from .functions.text import ABBREVIATIONS, KEEP_DOUBLE, MIN_STEM, SCAFFOLDING, STOPWORDS, SUFFIX_RULES, py_stem

WIDE = "".join(chr(0xFF01 + i) for i in range(94))
ASCII = "".join(chr(0x21 + i) for i in range(94))
WS = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def text_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def nfkc(c: str) -> str:
    """NFKC for the compatibility characters of the test tables: full width, ligature, half, ellipsis, no-break space."""
    wide, plain = WIDE.replace("'", "''"), ASCII.replace("'", "''")
    out = f"translate({c}, '{wide}', '{plain}')"
    for old, new in (("ﬁ", "fi"), ("½", "1⁄2"), ("…", "..."), (" ", " "), ("　", " ")):
        out = f"replace({out}, '{old}', '{new}')"
    return f"nfc_normalize({out})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def normalize(c: str) -> str:
    return f"lower({strip(f"regexp_replace({nfkc(c)}, '[{WS}]+', ' ', 'g')")})"


def tokens(c: str) -> str:
    return f"regexp_extract_all(lower({nfkc(f'coalesce({c}, {chr(39)*2})')}), '[a-z0-9][a-z0-9''\\-]*')"


def content(toks: str) -> str:
    return f"list_filter({toks}, lambda t: length(t) > 1 AND t NOT IN ({text_list(STOPWORDS)}))"


def _pass(w: str) -> str:
    rules = " ".join(
        f"WHEN ends_with({w}, '{a}') AND length({w}) >= {MIN_STEM + len(a) - len(b)} THEN left({w}, length({w}) - {len(a)}) || '{b}'"
        for a, b in SUFFIX_RULES
    )
    return f"CASE WHEN length({w}) <= {MIN_STEM} OR NOT regexp_full_match({w}, '[a-z]+') THEN {w} {rules} ELSE {w} END"


def _double(w: str) -> str:
    return (
        f"CASE WHEN length({w}) > {MIN_STEM} AND regexp_full_match({w}, '[a-z]+') AND right({w}, 1) = substr({w}, length({w}) - 1, 1) "
        f"AND right({w}, 2) NOT IN ({text_list(KEEP_DOUBLE)}) THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def _final_e(w: str) -> str:
    return f"CASE WHEN length({w}) > {MIN_STEM + 1} AND regexp_full_match({w}, '[a-z]+') AND ends_with({w}, 'e') THEN left({w}, length({w}) - 1) ELSE {w} END"


def stems(toks: str) -> str:
    for step in (_pass, _pass, _double, _final_e):
        toks = f"list_transform({toks}, lambda w: {step('w')})"
    return toks


def lexical(c: str) -> str:
    return stems(content(tokens(c)))


def topical(c: str) -> str:
    skip = sorted({py_stem(w) for w in SCAFFOLDING})
    return f"list_filter({lexical(c)}, lambda t: t NOT IN ({text_list(skip)}))"


def count_tokens(c: str) -> str:
    atoms = f"regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{WS}]')"
    cost = "CASE WHEN regexp_full_match(a, '[\\p{L}\\p{N}]+') THEN ceil(length(a) / 4.0) ELSE 1 END"
    return f"CAST(coalesce(list_sum(list_transform({atoms}, lambda a: {cost})), 0) AS INT)"


def _kind(x: str) -> str:
    return (
        f"CASE WHEN {strip(x)} = '' THEN 'b' WHEN regexp_matches({x}, '^[{WS}]*(?:#{{1,6}}[{WS}]|\\|)') THEN 'a' "
        f"WHEN regexp_matches({x}, '^[{WS}]*(?:[-*+][{WS}]|\\d+[.)][{WS}]|>)') THEN 's' ELSE 'p' END"
    )


def joined_lines(c: str) -> str:
    """Logical lines, each after a chr(1)."""
    lines = f"str_split({c}, chr(10))"
    return (
        f"list_aggregate(list_transform({lines}, lambda x, i: CASE WHEN {_kind('x')} = 'b' THEN '' ELSE "
        f"(CASE WHEN {_kind('x')} IN ('a', 's') OR i = 1 OR {_kind(f'{lines}[i - 1]')} IN ('a', 'b') THEN chr(1) ELSE ' ' END) || {strip('x')} END), "
        f"'string_agg', '')"
    )


def joined_sentences(c: str) -> str:
    """Sentences, each after a chr(1) or chr(2)."""
    cut = f"regexp_replace({joined_lines(c)}, '([.!?][\"''*_)\\]]{{0,2}})\\s+([\"''(\\[*_]*[A-Z0-9])', '\\1' || chr(2) || '\\2', 'g')"
    short = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    glue = f"'(^|[\\s\\x01\\x02])((?i:{short}))\\x02'"
    for _ in range(2):
        cut = f"regexp_replace({cut}, {glue}, '\\1\\2 ', 'g')"
    return cut


def sentences(c: str) -> str:
    return f"list_filter(regexp_split_to_array({joined_sentences(c)}, '[\\x01\\x02]'), lambda x: x <> '')"


def truncate(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(left({c}, {n}), '(?s) [^ ]*$', '') || '…' END"


CHUNKS = "SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, source, title, section, text, ordinal FROM chunks"
ITEMS = (
    "SELECT DISTINCT ON (id) id, question, reference_answer, expected_sources, answerable, category, difficulty FROM golden_items"
)
RESULTS = "SELECT DISTINCT ON (result_id) * FROM item_results"
DOCS = "SELECT DISTINCT ON (doc_id) doc_id, source, title, text, content_type FROM library_docs"
CANDIDATES = (
    "SELECT DISTINCT ON (qid, chunk_id) qid, chunk_id, dense_score, lexical_score, dense_rank, lexical_rank FROM retrieved_chunks"
)
