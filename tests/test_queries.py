import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.queries() if n in entry.oracle_sql()])
def test_same_rows_as_sql(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), entry.oracle_sql()[name]
    columns = sorted(df.columns)
    want = duck.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} from ({sql})")
    assert sorted(want.columns) == columns
    plain = lambda rows: sorted(repr(tuple(float(v) if isinstance(v, float) else v for v in r)) for r in rows)
    assert plain(df.select(*columns).collect()) == plain(want.fetchall())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql() and not n.startswith("op") and n != "pipeline"])
def test_other_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_search_ranks_every_match(spark):
    every, best = {}, {}
    for out, name in ((every, "keyword_search_all"), (best, "keyword_search")):
        for r in entry.queries()[name](spark, SF).collect():
            out.setdefault(r.query, []).append((-r.score, r.ref))
    assert min(len(x) for x in every.values()) > 20 and best.keys() == every.keys()
    assert all(sorted(best[q]) == sorted(every[q])[:20] for q in every)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
