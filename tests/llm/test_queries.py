from oracle import assert_same, views

from shelfmark.llm import queries


def test_sql_gives_the_same_rows(spark, sf_dir):
    con = views(sf_dir)
    for name, sql in queries.oracle_sql().items():
        assert_same(queries.queries()[name](spark, sf_dir).toPandas(), con.sql(sql).df())


def test_ten_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
