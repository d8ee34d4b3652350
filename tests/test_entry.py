"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from trolley import registry

SLOW_ROWS_ONLY = {"kmeans_segments", "kmeans_centers", "kmeans_elbow", "pca_coordinates", "recommend_customer_svd"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "frecuencia_absoluta" in df.columns


def test_every_query_has_oracle_or_is_declared_rows_only():
    missing = set(registry.QUERIES) - set(registry.SQL)
    assert missing <= SLOW_ROWS_ONLY


def test_entry_holds_every_query_of_the_registry():
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.SQL) <= set(E.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_oracle(spark, duck, name):
    import sys, os
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
    from check_oracle import digest
    df = registry.QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(registry.SQL[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_entry_without_a_library_of_the_operators():
    """Where a library of the training-data operators is missing, all other queries remain."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['sentencepiece'] = None; import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.SQL))]
