import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

TABLES = "documents benchmark pages embeddings labels".split()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts():
    """Awkward texts: null, empty, blank, no letters, very long, repeated rows, other scripts."""
    long = "the and of " * 30_000
    return [(1, None), (2, ""), (3, "   \n\t "), (4, "%%% *** 12 34"), (5, long), (6, "Alpha beta gamma"), (6, "Alpha beta gamma"),
            (7, "ÉCOLE straße ΑΣ 日本語 😀"), (8, "x" * 50_000), (None, "a row without id"), (9, "alpha BETA gamma")]


@pytest.fixture()
def awkward(spark, texts):
    """The awkward texts with extra columns whose names could clash."""
    rows = [(i, t, "en", "src", 0, "k", 1, 2, "f", 3) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, block int, rank int, fp string, n int")


@pytest.fixture()
def nothing(awkward):
    return awkward.where("false")
