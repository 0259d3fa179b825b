from __future__ import annotations

import pytest

WIDE = "doc_id long, text string, lang string, source string, n_chars long, run long, digest string, kept int, id string, score double, block int, words string, `Text 2` string"


@pytest.fixture
def docs(spark):
    """Documents with extra columns of clashing names: docs([(id, text), ...], lang=...)."""

    def make(rows, lang="en"):
        data = [(i, t, lang, "s", len(t or ""), 1, "d", 2, "x", 0.5, 3, "w", "y") for i, t in rows]
        return spark.createDataFrame(data, WIDE)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return docs([(1, None), (2, ""), (3, long), (4, long), (5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (6, "   \n\t "), (7, "é" * 3000), (8, "!!! ??")])
