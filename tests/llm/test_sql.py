import duckdb
import pytest

from symgrid.llm import queries as Q

from .fixtures import DOCS

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{DOCS}/{t}.parquet'")
    got, want = Q.queries()[name](spark, DOCS).toPandas(), con.sql(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    c = sorted(got.columns)
    as_rows = lambda d: sorted(map(repr, d[c].astype(object).itertuples(index=False, name=None)))
    norm = lambda d: d.assign(**{k: d[k].astype(float).round(9) for k in c if d[k].dtype.kind in "fiu"})
    assert as_rows(norm(got)) == as_rows(norm(want))


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{i}" for i in range(1, 11)]
