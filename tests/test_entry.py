import duckdb
import pytest

import __spark_entry__ as entry

from lodestone import queries


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and set(queries.QUERIES) <= set(entry.queries())


def test_merges_of_whole_tables(spark, sf):
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier")}
    c = {how: queries.QUERIES[f"merge_whole_{how}"](spark, sf).count() for how in ("inner", "left", "right", "outer")}
    assert 0 < c["inner"] < n["supplier"] and (c["left"], c["right"], c["outer"]) == (n["customer"], n["supplier"], n["customer"] + n["supplier"] - c["inner"])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    with duckdb.connect() as db:
        for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        found = db.sql(queries.ORACLE_SQL[name])
        columns, want = found.columns, found.fetchall()
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: [(x is None, str(round(x, 6) if isinstance(x, float) else x)) for x in r]
    assert sorted(map(key, ([r[c] for c in sorted(columns)] for r in rows))) == sorted(map(key, ([r[columns.index(c)] for c in sorted(columns)] for r in want)))
