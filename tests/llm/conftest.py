import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    long = " ".join(f"w{i}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [
        (1, "a b c", "en", "s1", 5, "x"), (1, "a b c", "en", "s1", 5, "x"), (2, None, None, None, None, None),
        (None, passage, "en", "s1", 9, "y"), (None, None, None, None, None, None),
        (3, "", "en", "s2", 0, "z"), (4, " \n\t ", "en", "s2", 4, "z"),
        (5, long, "en", "s1", len(long), "z"), (6, "head " + passage + " tail", "de", "s3", 1, "z"),
        (7, passage, "de", None, 1, "z"), (8, long + " " + passage, "de", "s3", 1, "z"),
        (9, "é 😀 日本 " * 40, "ja", "s3", 1, "z"), (10, "x " * 200, "ja", "s3", 1, "z"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
