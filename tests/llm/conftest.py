"""Documents with every awkward case: nulls, blanks, long texts, copies, repeated rows, extra columns."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, fp long, pos int, size double"


def made_rows() -> list[tuple]:
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Été", "straße", "niño", "zeta", "token", "the", "of", "and"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    common = "This line stands in many documents."
    texts = [line(rng.randint(1, 60)) + "\n" + (common if i % 3 == 0 else line(9)) + "\n  " + (common.upper() if i % 4 == 0 else line(4)) for i in range(60)]
    texts += [None, "", " ", "\n\n", "short\nshort", common, common, "x" * 40_000, (line(12) + "\n") * 1500, texts[3], texts[3], texts[5] + " tail", "Ünïcödé \x0b\x0c lines\r\nÜnïcödé lines here", "!!! 123", "日本語のテキスト"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", None, "clash", 1, 2, 0.5) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "a row without an id\n" + common, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    return made_rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
