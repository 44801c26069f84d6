import random

import pytest


@pytest.fixture()
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def docs_frame(spark):
    """A frame of documents from ``(doc_id, text)`` with columns whose names clash with those of the operators."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, rep bigint, bucket string, key string, h string"
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", None if t is None else len(t), 0.5, 1, "x", "k", "h") for i, t in rows], schema)

    return make
