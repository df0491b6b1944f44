"""Stores, manifests and reports.

A store's one pointer file names the data of all its tables. Data is written in whole before the
pointer is replaced by an atomic rename, so a reader, a lost executor or a crash between two
steps sees either the old state of every table or the new one, never a mixture.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, or None if it is missing."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the target, then rename over it in one step."""
    fs, p = _fs(spark, path)
    side = _fs(spark, f"{path}.{uuid.uuid4().hex}")[1]
    out = fs.create(side, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    sc = spark.sparkContext
    rename = getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.toUri(), sc._jsc.hadoopConfiguration()).rename(side, p, how)


def _version() -> str:
    return f"v-{datetime.now(UTC):%Y%m%d%H%M%S}-{uuid.uuid4().hex[:8]}"


class LibraryStore:
    """Tables of one document library, cut into buckets by document.

    A change rewrites only the buckets it touches; the pointer maps every bucket of every table to the folder
    that holds it. Rows are bucketed by a hash of ``doc_id``, so all of a document is in one bucket.
    """

    TABLES = ("chunks", "vectors", "manifest")

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = self.state().get("buckets", buckets)

    def state(self) -> dict:
        """What the pointer says; empty for a new store."""
        return json.loads(read_text(self.spark, f"{self.folder}/CURRENT") or "{}")

    @property
    def fingerprint(self) -> str | None:
        return self.state().get("fingerprint")

    def bucket(self, doc_id: str = "doc_id") -> Column:
        return F.pmod(F.xxhash64(F.col(doc_id).cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, ids: DataFrame) -> list[int]:
        """Buckets of the given documents: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in ids.select(self.bucket()).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table or some of its buckets; None if there is nothing."""
        held = self.state().get("tables", {}).get(table, {})
        paths = sorted(f"{self.folder}/{at}/bucket={b}" for b, at in held.items() if buckets is None or int(b) in buckets)
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, rows: dict[str, DataFrame], touched: list[int], fingerprint: str | None = None) -> None:
        """Replace the ``touched`` buckets of the given tables by ``rows``, all at once."""
        state = self.state()
        tables = {t: dict(state.get("tables", {}).get(t, {})) for t in self.TABLES}
        version = _version()
        for table, df in rows.items():
            at = f"{table}/{version}"
            df.withColumn("bucket", self.bucket()).write.partitionBy("bucket").parquet(f"{self.folder}/{at}")
            fs, p = _fs(self.spark, f"{self.folder}/{at}")
            written = {f.getPath().getName().removeprefix("bucket=") for f in fs.listStatus(p) if f.getPath().getName().startswith("bucket=")}
            kept = {b: x for b, x in tables[table].items() if int(b) not in touched}
            tables[table] = kept | dict.fromkeys(sorted(written), at)
        new = {"version": version, "buckets": self.buckets, "fingerprint": fingerprint or state.get("fingerprint"), "tables": tables}
        write_text(self.spark, f"{self.folder}/CURRENT", json.dumps(new, sort_keys=True))

    def vacuum(self) -> int:
        """Delete data that the pointer no longer names; only when no reader of an older state is left."""
        tables, gone = self.state().get("tables", {}), 0
        for table in self.TABLES:
            fs, p = _fs(self.spark, f"{self.folder}/{table}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                at = f"{table}/{f.getPath().getName()}"
                used = {b for b, x in tables.get(table, {}).items() if x == at}
                for d in fs.listStatus(f.getPath()):
                    name = d.getPath().getName()
                    if name.startswith("bucket=") and name.removeprefix("bucket=") not in used:
                        gone += int(fs.delete(d.getPath(), True))
        return gone

    def reset(self) -> None:
        fs, p = _fs(self.spark, self.folder)
        fs.delete(p, True)


def save_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    write_text(spark, path, json.dumps(manifest | {"updated_at": datetime.now(UTC).isoformat()}, indent=2, sort_keys=True))


def load_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest; a missing or corrupt one is empty."""
    try:
        found = json.loads(read_text(spark, path) or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def export_contexts(results: DataFrame, passages: DataFrame) -> DataFrame:
    """``question, answer, contexts, ground_truth`` of answered, answerable items, for an outside scorer."""
    texts = passages.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("c"))
    return (
        results.where(F.col("answerable") & ~F.col("abstained"))
        .join(texts, "id")
        .select("question", "answer", F.col("c.text").alias("contexts"), F.col("reference_answer").alias("ground_truth"))
    )


def report_markdown(metrics: DataFrame, breakdown: DataFrame, failures: DataFrame, most: int = 25) -> str:
    """Report of small aggregates; at most ``most`` failures are fetched."""
    lines = ["# Evaluation report", "", "| metric | value |", "|---|---|"]
    lines += [f"| {r['metric']} | {r['value']:.4f} |" for r in metrics.orderBy("metric").collect()]
    lines += ["", "| dimension | name | n | recall | faithfulness | F1 | abstained |", "|---|---|---|---|---|---|---|"]
    for r in breakdown.orderBy("dimension", "name").limit(500).collect():
        lines.append(
            f"| {r['dimension']} | {r['name']} | {r['n']} | {r['recall_at_k']:.3f} | {r['faithfulness']:.3f} | {r['answer_f1']:.3f} | {r['abstained']} |"
        )
    rows = failures.orderBy("id").limit(most).collect()
    if rows:
        lines += ["", f"## Notable failures (first {most})", "", "| id | question | issue |", "|---|---|---|"]
        lines += [f"| `{r['id']}` | {(r['question'] or '').replace('|', chr(92) + '|')} | {r['issue']} |" for r in rows]
    return "\n".join(lines) + "\n"


def report_json(metrics: DataFrame, breakdown: DataFrame, checks: DataFrame, profile: str = "offline") -> str:
    """The same report for programs: metrics by group, breakdown and gates."""
    groups: dict[str, dict] = {}
    for r in metrics.orderBy("metric").collect():
        group, _, name = r["metric"].partition(".")
        groups.setdefault(group, {})[name] = r["value"]
    rows = lambda df, *order: [r.asDict() for r in df.orderBy(*order).limit(500).collect()]
    gates = rows(checks, "metric")
    return json.dumps(
        {"profile": profile, "metrics": groups, "breakdown": rows(breakdown, "dimension", "name"), "gates": gates, "passed": all(g["passed"] for g in gates)},
        indent=2,
    )
