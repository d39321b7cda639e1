import pytest
from pyspark.sql import types as T

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows as documents; further columns with names that operators use inside."""

    def make(texts, ids=None, langs=None, extra=True):
        ids = range(len(texts)) if ids is None else ids
        langs = [None] * len(texts) if langs is None else langs
        rows = [(i, t, g, f"s{k % 3}", None if t is None else len(t)) for k, (i, t, g) in enumerate(zip(ids, texts, langs))]
        df = spark.createDataFrame(rows, DOCUMENTS)
        if extra:
            for name in ("key", "digest", "component", "number", "row", "score", "shingles", "own", "n_tokens", "part", "cell", "value"):
                from pyspark.sql import functions as F

                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def schema_of():
    return lambda df: {f.name: f.dataType for f in df.schema.fields}


LONG = T.LongType()
