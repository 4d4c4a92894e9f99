"""Every query of the catalogue against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from folioforge.plans import catalogue, enrichment, records  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    fix = lambda v: float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(fix(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, DIR)
    got = rows(df.columns, df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, found.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_titles_with_unfinished_entities(spark, tmp_path):
    titles = ["a&amp;&amp;&amp", "x &copy 2 &copy; y", "&amp;lt; &lt &bogus; &", "two  spaces ", "T</title><title>U", ""]
    made = [(k, f"<html><head><title>{t}</title></head><body><p title='&amp'>x</p></body></html>") for k, t in enumerate(titles)]
    spark.createDataFrame([*made, (99, "<p>none</p>"), (100, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in catalogue.QUERIES["page_title"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(catalogue.ORACLE_SQL["page_title"]).fetchall())
