import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def sample():
    """The small documents table, whole."""
    return "/root/testdata/sf0.001"


def frame(spark, texts, ids=None, **more):
    """Documents from texts, with a clashing extra column or two."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    lang, source = more.get("lang", ["en"] * n), more.get("source", [f"s{i % 5}" for i in range(n)])
    rows = [(i, t, a, s, None if t is None else len(t), "x", "k") for i, t, a, s in zip(ids, texts, lang, source, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, n string")


@pytest.fixture
def make(spark):
    return lambda texts, ids=None, **more: frame(spark, texts, ids, **more)
