import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, bucket int, part string, length int, predicted string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows and columns whose names clash."""
    prose = " ".join(f"word{i % 97} and{i % 13}" for i in range(400))
    rows = [
        (1, None), (2, ""), (3, prose), (3, prose), (4, prose + " tail end"), (None, prose), (None, None), (5, "x"),
        (6, "mail ann.b1@mail.example.com now"), (7, "lang " * 30_000), (8, "é" * 5000), (9, "\x00 \t\n  "), (9, "other text under the same id"),
        (10, "1" * 20_000), (11, "日本語 テキスト 👍 text"), (12, prose.upper()),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 1, "a", "b", 2, "c", 3, "d") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
