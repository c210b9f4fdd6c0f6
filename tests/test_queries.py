"""Every query against its SQL in DuckDB."""

import duckdb
import pytest

from strandlog.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(catalogue.oracle_sql()[name]).to_arrow_table()
    got = catalogue.queries()[name](spark, SF).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    rows = lambda t: sorted(repr([r[c] for c in sorted(r)]) for r in t.to_pylist())
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
