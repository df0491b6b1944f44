"""Documents from Markdown, text, HTML and PDF files, folders, tables and fetched pages.

File metadata is native: ``binaryFile`` lists and filters, Column expressions take front
matter, titles and ids.  Only parsing HTML and PDF runs in Arrow batches.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS, strip

KINDS = {
    "markdown": (".md", ".markdown", ".mdown"), "text": (".txt", ".text", ".rst"), "pdf": (".pdf",), "html": (".html", ".htm"),
}
SUPPORTED = tuple(s for group in KINDS.values() for s in group)
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
#: Tags that carry no text of their own, and those whose text is kept.
DROPPED = {"script", "style", "nav", "footer", "noscript", "aside"}
KEPT = {"h1", "h2", "h3", "h4", "p", "li", "pre", "td"}


def stem_of(source: Column) -> Column:
    base = F.element_at(F.split(source, "/"), -1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def suffix_of(source: Column) -> Column:
    return F.lower(F.regexp_extract(F.element_at(F.split(source, "/"), -1), r"(?<=.)(\.[^.]*)$", 1))


def doc_id(source: Column) -> Column:
    """Readable stem and eight digits of the source's SHA-1."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem_of(source)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(slug == "", "doc").otherwise(slug), F.lit("-"), F.left(F.sha1(source), F.lit(8)))


def content_kind(source: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, suffixes in KINDS.items():
        out = F.when(suffix_of(source).isin(*suffixes), kind).otherwise(out)
    return out


def flat_yaml(block: Column) -> Column:
    """``key: value`` lines of a flat mapping; NULL if any line is something else."""
    lines = F.filter(F.split(block, r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*#"))
    good = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z_][\w .-]*:(\s|$)"))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("k"),
            F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)), r"^([\"'])(.*)\1$", "$2").alias("v"),
        ),
    )
    return F.when(good & (F.size(lines) > 0), F.map_from_entries(F.array_distinct(entries)))


def front_matter(text: Column) -> tuple[Column, Column]:
    """Metadata map and body; an absent or malformed block leaves the text whole."""
    block = F.regexp_extract(text, FRONT_MATTER, 1)
    meta = F.when(text.rlike(FRONT_MATTER), F.when(F.trim(block) == "", F.create_map().cast("map<string,string>")).otherwise(flat_yaml(block)))
    body = F.when(meta.isNotNull(), F.regexp_replace(text, FRONT_MATTER, "")).otherwise(text)
    return F.coalesce(meta, F.create_map().cast("map<string,string>")), body


def markdown_title(body: Column) -> Column:
    """The first line that is not blank, if it is a ``# `` heading; else NULL."""
    title = strip(F.regexp_extract(body, rf"\A[{WS}]*# ([^\r\n]*)", 1))
    return F.when(body.rlike(rf"\A[{WS}]*# "), title)


def markdown_documents(files: DataFrame) -> DataFrame:
    """Documents from ``source, text`` of Markdown files."""
    meta, body = front_matter(F.col("text"))
    rows = files.select("source", meta.alias("meta"), body.alias("body"))
    named = lambda k: F.when(F.coalesce(F.col("meta")[k], F.lit("")) != "", F.col("meta")[k])
    return rows.select(
        F.coalesce(named("doc_id"), doc_id(F.col("source"))).alias("doc_id"), "source",
        F.coalesce(named("title"), markdown_title(F.col("body")), stem_of(F.col("source"))).alias("title"),
        strip(F.col("body")).alias("text"), F.lit("markdown").alias("content_type"),
        F.map_filter("meta", lambda k, v: ~k.isin("title", "doc_id")).alias("metadata"),
    )


def text_documents(files: DataFrame) -> DataFrame:
    return files.select(
        doc_id(F.col("source")).alias("doc_id"), "source", stem_of(F.col("source")).alias("title"), strip(F.col("text")).alias("text"),
        F.lit("text").alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


class _Outline(HTMLParser):
    """Text of kept tags in document order; a nested kept tag is given again."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, list[str], int]] = []
        self.found: list[tuple[int, str, list[str]]] = []
        self.dropped, self.title, self.in_title, self.order = 0, [], False, 0

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped += 1
        self.in_title |= tag == "title"
        if tag in KEPT and not self.dropped:
            self.open.append((tag, [], self.order))
            self.order += 1

    def handle_endtag(self, tag):
        if tag in DROPPED and self.dropped:
            self.dropped -= 1
        if tag == "title":
            self.in_title = False
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for name, words, order in self.open[k:]:
                    self.found.append((order, name, words))
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.dropped:
            return
        if self.in_title:
            self.title.append(data.strip())
        elif data.strip():
            for _, words, _ in self.open:
                words.append(data.strip())

    def result(self) -> tuple[str, str]:
        rows = sorted([*self.found, *((o, t, w) for t, w, o in self.open)])
        lines = []
        for _, tag, words in rows:
            body = " ".join(words)
            if body:
                head = "#" * int(tag[1]) + " " if tag[0] == "h" else "- " if tag == "li" else ""
                lines.append(head + body)
        return "".join(self.title), "\n\n".join(lines)


def html_outline(html: str | None) -> tuple[str, str]:
    """Title and text skeleton of a page; text outside the kept tags is lost."""
    parser = _Outline()
    parser.feed(html or "")
    parser.close()
    return parser.result()


def html_documents(files: DataFrame, fallback: str | None = None) -> DataFrame:
    """Documents from ``source, text`` (HTML). ``fallback`` names a column used where a page has no title."""

    @F.pandas_udf("title string, text string")
    def outline(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([html_outline(p) for p in pages], columns=["title", "text"])

    rows = files.withColumn("o", outline(F.coalesce("text", F.lit(""))))
    other = F.col(fallback) if fallback else stem_of(F.col("source"))
    return rows.select(
        doc_id(F.col("source")).alias("doc_id"), "source",
        F.when(F.col("o.title") != "", F.col("o.title")).otherwise(other).alias("title"), F.col("o.text").alias("text"),
        F.lit("html").alias("content_type"), F.create_map().cast("map<string,string>").alias("metadata"),
    )


def stitch_pages(pages: DataFrame) -> DataFrame:
    """``source, text`` from ``source, page, content``: page headings, blank pages skipped, numbers kept."""
    body = strip(F.coalesce("content", F.lit("")))
    kept = pages.withColumn("b", body).where(F.col("b") != "")
    part = F.struct("page", F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), "b").alias("t"))
    joined = kept.groupBy("source").agg(F.sort_array(F.collect_list(part)).alias("p"))
    texts = joined.select("source", F.array_join(F.col("p.t"), "\n\n").alias("text"))
    return pages.select("source").distinct().join(texts, "source", "left").fillna("", ["text"])


def read_pdf(data: bytes) -> tuple[str | None, list[str]]:
    """Title and page texts of a PDF; needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the package pypdf") from e
    reader = PdfReader(io.BytesIO(data))
    return reader.metadata.title if reader.metadata else None, [page.extract_text() or "" for page in reader.pages]


def pdf_pages(files: DataFrame, reader: Callable[[bytes], tuple[str | None, list[str]]] = read_pdf) -> DataFrame:
    """``source, page, content, title, pages`` from ``source, content`` (bytes); a PDF without pages has page 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for source, data in zip(pdf["source"], pdf["content"], strict=True):
                title, pages = reader(data)
                rows += [(source, n, text, title, len(pages)) for n, text in enumerate(pages, 1)] or [(source, 0, "", title, 0)]
            yield pd.DataFrame(rows, columns=["source", "page", "content", "title", "pages"])

    return files.select("source", "content").mapInPandas(run, "source string, page int, content string, title string, pages int")


def pdf_documents(files: DataFrame, reader: Callable[[bytes], tuple[str | None, list[str]]] = read_pdf) -> DataFrame:
    """Documents of PDF files: pages stitched, the PDF's own title or the stem, the number of pages as metadata."""
    pages = pdf_pages(files, reader)
    about = pages.groupBy("source").agg(F.max("title").alias("t"), F.max("pages").alias("n"))
    docs = text_documents(stitch_pages(pages)).join(about, "source")
    own = strip(F.coalesce("t", F.lit("")))
    docs = docs.withColumns({
        "title": F.when(own != "", own).otherwise(F.col("title")), "content_type": F.lit("pdf"),
        "metadata": F.create_map(F.lit("pages"), F.col("n").cast("string")),
    })
    return docs.select(DOCUMENT)


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Right-anchored glob match on whole path parts."""
    out = F.lit(False)
    for pattern in patterns:
        parts = [p for p in PurePosixPath(pattern).parts if p not in ("**", ".")] if pattern != "**/*" else ["*"]
        body = "/".join(re.escape(p).replace(r"\*\*", "[^/]*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") for p in parts)
        deeper = "[^/]+/" if pattern.startswith("**/") and pattern != "**/*" else ""
        out = out | path.rlike(f"(^|/){deeper}{body}$")
    return out


def list_files(spark: SparkSession, folder: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """``source, content`` of supported files below a folder; hidden parts are skipped. A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = "file:" + folder.rstrip("/") if "://" not in folder and not folder.startswith("file:") else folder.rstrip("/")
    path = F.regexp_replace("path", "^file:/+", "file:/")
    relative = F.regexp_replace(path, "^" + re.escape(re.sub("^file:/+", "file:/", root)) + "/", "")
    rows = files.select(F.regexp_replace(path, "^file:", "").alias("source"), relative.alias("relative"), "content")
    rows = rows.where(suffix_of(F.col("source")).isin(*SUPPORTED) & ~F.col("relative").rlike(r"(^|/)\."))
    rows = rows.where(glob_match(F.col("relative"), include or ["**/*"]))
    if exclude:
        rows = rows.where(~glob_match(F.col("relative"), exclude))
    return rows.drop("relative")


DOCUMENT = ["doc_id", "source", "title", "text", "content_type", "metadata"]


def load_documents(files: DataFrame, with_pdf: bool = True) -> DataFrame:
    """Documents of every kind from ``source, content``; the first of equal ids by source wins."""
    kinds = files.withColumn("kind", content_kind(F.col("source")))
    texts = kinds.where(F.col("kind") != "pdf").select("source", "kind", F.decode("content", "UTF-8").alias("text"))
    out = markdown_documents(texts.where("kind = 'markdown'")).select(DOCUMENT)
    out = out.unionByName(text_documents(texts.where("kind = 'text'")).select(DOCUMENT))
    out = out.unionByName(html_documents(texts.where("kind = 'html'")).select(DOCUMENT))
    if with_pdf:
        out = out.unionByName(pdf_documents(kinds.where("kind = 'pdf'")))
    return merge_documents(out)


def merge_documents(docs: DataFrame) -> DataFrame:
    """One document per id: the first by source."""
    w = Window.partitionBy("doc_id").orderBy("source")
    return docs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def fetch(url: str, timeout: float = 20.0) -> str:
    """A page's HTML; redirects are followed, and answers of 400 and above raise."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"User-Agent": "quillspark"}), timeout=timeout) as reply:  # raises on 4xx and 5xx
        return reply.read().decode(reply.headers.get_content_charset() or "utf-8", "replace")


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str] = fetch) -> DataFrame:
    """Documents from web pages; ``fetch(url)`` returns HTML and raises on errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"source": pdf["url"], "text": [fetch(u) for u in pdf["url"]]})

    pages = urls.select("url").mapInPandas(run, "source string, text string")
    docs = html_documents(pages, fallback="source")
    return docs.withColumn("metadata", F.create_map(F.lit("fetched_from"), F.col("source")))


GOLDEN = (
    "id string, question string, reference_answer string, expected_sources array<string>, answerable boolean, category string, difficulty string"
)


def read_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Golden items from JSON lines; id and question are required, a broken line fails the read."""
    rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    rows = rows.withColumn("answerable", F.coalesce("answerable", F.lit(True)))
    bad = rows.where(F.col("id").isNull() | F.col("question").isNull())
    if not bad.isEmpty():
        raise ValueError("a golden item lacks id or question")
    return rows.limit(limit) if limit else rows


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the broken lines as text."""
    rows = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path).cache()
    return rows.where("_broken is null").drop("_broken"), rows.where("_broken is not null").select("_broken")
