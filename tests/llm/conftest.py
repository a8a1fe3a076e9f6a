import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with those of results."""

    def make(*pairs, partitions=3):
        rows = [(key, text, "en", "src0", None if text is None else len(text)) for key, text in pairs]
        df = spark.createDataFrame(rows, DOCUMENTS)
        return df.repartition(partitions).withColumns({"score": F.lit("x"), "ids": F.lit("y"), "kept": F.lit("z")})

    return make
