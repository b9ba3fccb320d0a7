from __future__ import annotations

import pytest
from pyspark.sql import types as T

#: Columns of ``documents`` and names that the operators or their results use themselves.
CLASH = ("_id", "_text", "_row_key", "_row_sha", "kept", "score", "fingerprint", "length", "Text_SHA256")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang]) rows, with extra columns of clashing names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                           T.StructField("n_chars", T.LongType()),
                           *(T.StructField(c, T.StringType()) for c in CLASH)])

    def make(rows):
        full = [(*r, *([None] * (3 - len(r))), "src0", 0, *CLASH) for r in rows]
        return spark.createDataFrame(full, schema)
    return make


@pytest.fixture(scope="session")
def write_tables(spark, tmp_path_factory):
    """A folder of Parquet tables as the queries read them."""
    def write(**tables):
        d = tmp_path_factory.mktemp("sf")
        for name, df in tables.items():
            df.write.parquet(f"{d}/{name}.parquet")
        return str(d)
    return write


@pytest.fixture(scope="session")
def against_oracle(spark):
    """Rows of a query and of its DuckDB SQL over the same folder, both sorted."""
    import duckdb

    def run(module, name, sf_dir, tables):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet/*.parquet'")
        cur = con.execute(module.ORACLE[name])
        cols = [c[0] for c in cur.description]
        want = sorted(map(repr, cur.fetchall()))
        got = sorted(repr(tuple(r)) for r in module.QUERIES[name](spark, sf_dir).select(*cols).collect())
        return got, want
    return run
