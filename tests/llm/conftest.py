import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: Names that the operators use inside, on columns that they must leave alone.
EXTRA = ["id", "text_hash", "__hash", "__key", "__gone", "__text", "__left", "score", "contamination", "length", "shard", "fp", "n_words"]


@pytest.fixture(scope="session")
def read(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with extra columns whose names clash."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in EXTRA)])

    def made(rows):
        return spark.createDataFrame([(i, t, *(f"{n}-{i}" for n in EXTRA)) for i, t in rows], schema)
    return made


LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="session")
def tricky(make):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = "\n".join(f"{LINE} {k} {k * k}" for k in range(3000))
    return make([(1, None), (2, ""), (3, "  \n\t \n"), (4, "word"), (5, "word"), (5, "word"), (6, long_text), (7, long_text), (None, long_text),
                 (None, None), (None, "word"), (8, "é漢字😀  x\n\n\ny"), (9, LINE + " " + LINE), (10, LINE), (10, "other " + LINE)])


@pytest.fixture(scope="session")
def empty(make):
    return make([])


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
