"""Every query with SQL gives the rows of DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from facetwise.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return "nan" if math.isnan(v) else round(float(v), 9)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert rows
        return
    res = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, rows) == rows_of(names, res.fetchall())


def test_entry_without_the_training_data_operators(monkeypatch):
    """The other queries are there if the subpackage, or the pipeline, can't be imported."""
    import sys

    import __spark_entry__ as entry

    whole = set(entry.queries())
    monkeypatch.setitem(sys.modules, "facetwise.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(entry.queries()) == set(catalogue.QUERIES) <= whole and set(entry.oracle_sql()) == set(catalogue.ORACLES)
