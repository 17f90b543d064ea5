import pytest


@pytest.fixture(scope="session")
def compared(spark):
    """Rows of a query and of its SQL over tables of small data."""
    import duckdb

    import __spark_entry__ as entry
    from check_oracle import TABLES, rows

    def run(name, sf="/root/testdata/sf0.001"):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        df = entry.queries()[name](spark, sf)
        cur = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in cur.description]
        assert sorted(columns) == sorted(df.columns)
        return rows([tuple(r) for r in df.collect()], df.columns), rows(cur.fetchall(), columns)

    return run
