from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def frame(spark):
    """Documents from (doc_id, text) pairs."""

    def make(pairs, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make
