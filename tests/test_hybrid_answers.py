"""The systems over hybrid search against their SQL, and what sets them apart from term search."""

import os

import pytest

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(FOLDER), reason="needs the test tables")


def same_as_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{FOLDER}/{file}')")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    plain = lambda row: tuple(round(x, 5) if isinstance(x, float) else str(x) for x in row)
    mine = sorted(plain(r) for r in got.select(*columns).collect())
    theirs = con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in theirs.description].index(c) for c in columns]
    assert mine and mine == sorted(plain([r[i] for i in place]) for r in theirs.fetchall())
    return mine


@pytest.mark.parametrize("name", ["baseline_b0", "extractive_answer", "context_sufficiency", "recovery_merge"])
def test_queries_over_hybrid_search(spark, name):
    same_as_sql(spark, f"hybrid_{name}")


@pytest.mark.parametrize("name", ["hybrid_baseline_b1", "hybrid_baseline_e1"])
def test_answers_need_all_facts(spark, name):
    same_as_sql(spark, name)


def test_no_answer_on_half_of_the_facts_or_on_a_conflict(spark, monkeypatch):
    from lodestone.plans import evidence_queries as E

    q = spark.createDataFrame([("all", "harbour lantern"), ("half", "harbour lantern"), ("clash", "harbour lantern")], "qid string, question string")
    monkeypatch.setattr(E, "questions", lambda *_: q)
    texts = [("all", 1, "The harbour lantern of 1900"), ("half", 1, "The harbour"), ("clash", 1, "harbour 1900"), ("clash", 2, "lantern 1901")]
    rows = spark.createDataFrame([(x, f"{x}{n}", "d", t) for x, n, t in texts], "qid string, chunk_id string, document_id string, text string")
    assert {tuple(r) for r in E._assessed_context(spark, "", rows).collect()} == {("all", True), ("half", False), ("clash", False)}
