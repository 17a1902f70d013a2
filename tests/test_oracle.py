"""Every registered query of the scholarly part against its SQL."""

import os

import duckdb
import pytest

from lodestone.plans import queries as q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    want = duck.sql(q.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((plain(r) for r in df.select(*columns).collect()), key=str) == sorted((plain([r[i] for i in at]) for r in want.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["source", "doc_id", "rrf", "rank"]


def test_entry_without_the_optional_part(monkeypatch):
    """A library that only the training-data queries need is missing: the others stay."""
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith(("lodestone.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    import lodestone

    monkeypatch.delattr(lodestone, "llm", raising=False)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    with pytest.warns(UserWarning, match="left out"):
        assert set(entry.queries()) == set(q.QUERIES)
