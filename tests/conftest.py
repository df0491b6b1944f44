"""One local session for all tests, and a small corpus with every block structure."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillspark.session import build_session  # noqa: E402

HANDBOOK = """# Widget Handbook

Intro line one
wraps here. Second sentence, e.g. This one stays glued.

## Refund window

**You have 14 calendar days to return a widget.** Refunds are paid within 5 days.

## Rate limits

Requests are limited to 100 per second. Exceeding it returns HTTP 429.

```python
# not a heading
call(1)
```

| plan | limit |
|------|-------|
| free | 10 |
"""

GLOSSARY = """# Glossary

## Widget

A widget is a small part. Widgets ship in boxes of ten.

## Sprocket

A sprocket turns. Sprockets are sold in pairs.
"""


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def docs(spark):
    rows = [
        ("handbook", "docs/handbook.md", "Widget Handbook", HANDBOOK, "markdown", {"owner": "ops"}),
        ("glossary", "docs/glossary.md", "Glossary", GLOSSARY, "markdown", None),
        ("blank", "docs/blank.txt", "Blank", "  \n ", "text", None),
        ("none", "docs/none.txt", None, None, None, None),
    ]
    schema = "doc_id string, source string, title string, text string, content_type string, metadata map<string,string>"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def chunks(spark):
    rows = [
        ("c1", "d1", "a.md", "Disputes", "Dispute fees", "The dispute fee is 15.00 per case. Refunding disputes costs nothing else."),
        ("c2", "d1", "a.md", "Payouts", "Schedule", "Payouts are settled every Friday to the bank account on file."),
        ("c3", "d2", "b.md", "Errors", "Limits", "HTTP 429 means too many requests. Read the Retry-After header and wait."),
        ("c4", "d3", "c.md", "Brand", "Colours", "Use teal for primary buttons and grey for secondary ones."),
        ("c5", "d3", "c.md", "Brand", None, None),
    ]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, source string, title string, section string, text string")
