import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, k string, w string, key string"


@pytest.fixture()
def docs_of(spark):
    """A documents table from texts (ids in order) or from (id, text) pairs, with extra columns of clashing names."""

    def build(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, lang, f"s{(i or 0) % 3}", len(t or ""), "x", "x", "x", "x") for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return build
