"""Every query of the library against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from prose.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_gate_comes_before_ranking(spark):
    from prose.operators import retrieve
    from prose.sources import tables

    hits = retrieve.dense(tables.retrieval_queries(spark, SF), tables.chunks(spark, SF))
    later = "novel_number > novel_number_now or (novel_number = novel_number_now and chapter_index > current_chapter)"
    assert hits.filter(later).count() == 0
    assert hits.groupBy("query").count().filter("count > 40").count() == 0


def test_entry_point_names_match():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_chapters_of_documents_without_text(spark, tmp_path):
    """Null and blank documents have an epilogue alone, which stays section 1, as the SQL states."""
    texts = [(0, "one\n two"), (1, None), (2, ""), (3, " \n\n\t"), (4, "x\r")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got, want = QUERIES["chapter_split"](spark, str(tmp_path)), con.sql(ORACLE["chapter_split"])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)
