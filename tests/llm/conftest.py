import duckdb
import pytest

from tests.conftest import SF_SMALL

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns that carry names the operators use inside.
CLASH = {"row": "r", "t": 1, "gone": 2, "key": "k", "_matches": 3, "_toxicity": 4.0, "h": 5, "uid": 6, "hub": True, "spans": "s"}


@pytest.fixture(scope="session")
def small():
    """Tables of the smallest scale as lists of tuples, by name."""
    con = duckdb.connect()
    return lambda name, cols="*": con.execute(f"SELECT {cols} FROM '{SF_SMALL}/{name}.parquet'").fetchall()


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) rows as a documents table; ``clash`` adds columns with names used inside the operators."""
    def make(rows, clash=False):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOC)
        if clash:
            from pyspark.sql import functions as F
            df = df.withColumns({k: F.lit(v) for k, v in CLASH.items()})
        return df
    return make
