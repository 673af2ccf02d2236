from __future__ import annotations

import random

import pytest

from riskflow.llm.common import workers_find_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, kept string, place string, words string, one long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns whose names operators use themselves. Rows are (doc_id, text[, lang, source])."""
    workers_find_package(spark)

    def build(rows: list[tuple]):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, "en", "s")[:4] if len(row) == 2 else (*row, "s")[:4]
            full.append((doc_id, text, lang, source, len(text or ""), "u", "k", "p", "w", 1))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and long texts, repeated rows, equal texts, white space of every kind."""
    rnd = random.Random(5)
    long_text = " ".join(rnd.choice(WORDS) for _ in range(6000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n\u000b\f\r", "en", "a"), (None, "no id here at all", "en", None), (None, None, None, None),
            (4, long_text, "en", "a"), (5, long_text + " end", "en", "b"), (6, "One two\nthree", "de", "b"), (7, "One  two three", "de", "b"), (8, "onetwothree", "de", "b"),
            (9, "dup row", "en", "a"), (9, "dup row", "en", "a"), (10, "single", "fr", "c"), (11, "Éa ß 漢字 \U0001f600", "fr", "c"), (12, "x" * 5000, "fr", "c")]
    for i in range(20, 60):
        rows.append((i, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 60))), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None])))
    return rows


@pytest.fixture(scope="session")
def rows_of():
    def collect(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return collect
