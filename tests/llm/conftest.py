import os

import pytest
from pyspark.sql import functions as F

os.environ.setdefault("OMP_NUM_THREADS", "1")
FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "the of and " * 8000 + "end"
EDGE = [
    (1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \t\n", None, "s", 3), (4, "12 34 %%", "en", "s", 8),
    (5, "the house and the garden of the old town", "en", "s", 40), (5, "the house and the garden of the old town", "en", "s", 40),
    (6, "the house and the garden of the old town", "en", "s", 40), (7, LONG, "en", "s", len(LONG)),
    (8, "la maison et le jardin de la vieille ville", "fr", "s", 42), (9, "a@b.c " * 3 + "+1 (266) 555-7228", "fr", "s", 35),
    (None, "no name here at all", "en", "s", 19), (10, "x", None, None, None),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(edge):
    """Extra columns that have the names of results."""
    names = ["lang_pred", "score", "ambiguous", "predicted", "ids", "decoded", "spans", "fingerprint", "component_id", "key",
             "size", "shard", "slot", "word", "n", "id", "code", "learned", "cell", "vec", "host", "path", "rule", "verdict", "LABEL"]
    return edge.withColumns({n: F.lit("extra") for n in names})
