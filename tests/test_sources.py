"""Files, streams and the registry."""

import os
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.streaming import ingest


def test_scan_documents(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"caf\xe9 text")
    (tmp_path / "sub" / "b.md").write_text("# Head")
    (tmp_path / "empty.txt").write_text("  ")
    (tmp_path / "c.csv").write_text("x")
    stream = zlib.compress(b"BT (Hello \\(world\\)) Tj ET")
    (tmp_path / "d.pdf").write_bytes(b"%PDF\nstream\n" + stream + b"\nendstream\nstream\nBT (Two) Tj ET\nendstream")
    got = sorted((r.document_id, r.page, r.text) for r in files.scan_documents(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "caf text"), ("b", 1, "# Head"), ("d-p1", 1, "Hello (world)"), ("d-p2", 2, "Two")]


def test_records_and_chunks(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1"}\n\n{"id": "2"}\n')
    assert files.read_records(spark, str(tmp_path / "r.jsonl"), "id string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception):
        files.read_records(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    (tmp_path / "c.json").write_text('[{"chunk_id": "c", "text": "abc"}]')
    row = files.read_chunks(spark, str(tmp_path / "c.json")).first()
    assert (row.section, row.token_count, row.char_count) == ("General", 0, 3)


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n long, k string")
    for kind in ("parquet", "csv", "json"):
        files.write_table(df, str(tmp_path / kind), kind, by="k")
        assert spark.read.option("header", "true").format(kind).load(str(tmp_path / kind)).count() == 2
    with pytest.raises(ValueError):
        files.write_table(df, str(tmp_path / "x"), "xml")
    files.write_index(spark.createDataFrame([("c", "river loan")], "chunk_id string, text string"), str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index" / "postings")).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 3).alias("page_id"), F.lit("d").alias("document_id"), F.lit("n").alias("document_name"), F.lit("p").alias("source_path"), F.lit(1).alias("page"), F.lit("# Head\n\n12\nbody").alias("text"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ingested_at"))
    rows.write.parquet(str(tmp_path / "in"))
    query = ingest.append_cleaned(ingest.once(ingest.pages(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.page_id for r in got) == [0, 1, 2] and got[0].text == "# Head\nbody" and got[0].heading == "Head"
    events = spark.range(4).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 2000).cast("timestamp_ntz").alias("ts"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"))
    assert sorted(r.events for r in ingest.windows(events).collect()) == [2, 2]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    from lodestone.plans import registry

    assert registry.FLAGSHIP in registry.QUERIES


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="needs the test tables")
@pytest.mark.parametrize("name", ["token_counts", "bm25_search", "sufficiency_judge", "system_summary", "grounded_answers", "dedupe_hits"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    got = entry.queries()[name](spark, folder)
    columns = sorted(got.columns)
    plain = lambda row: tuple(round(x, 5) if isinstance(x, float) else str(x) for x in row)
    mine = sorted(plain(r) for r in got.select(*columns).collect())
    theirs = con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in theirs.description].index(c) for c in columns]
    assert mine == sorted(plain([r[i] for i in place]) for r in theirs.fetchall())


def test_one_file_and_the_index_read_back(spark, tmp_path):
    (tmp_path / "a.MD").write_text("# Head")
    assert [tuple(r) for r in files.scan_document(spark, str(tmp_path / "a.MD")).select("document_id", "text").collect()] == [("a", "# Head")]
    with pytest.raises(ValueError):
        files.scan_document(spark, str(tmp_path / "a.csv"))
    with pytest.raises(Exception):
        files.scan_document(spark, str(tmp_path / "none.txt")).collect()
    files.write_index(spark.createDataFrame([("c", "river loan"), ("d", None)], "chunk_id string, text string"), str(tmp_path / "index"))
    got = files.read_index(spark, str(tmp_path / "index"))
    assert {r.term: r.df for r in got["terms"].collect()} == {"river": 1, "loan": 1} and got["lengths"].count() == 2 and got["vectors"].count() == 2
    docs = spark.createDataFrame([(1, "a.b.txt", "x" * 900), (2, None, "short"), (3, "c.md", None)], "doc_id long, document_name string, text string")
    assert sorted((r.corpus_id or "", r.document_id, len(r.text)) for r in files.local_index(docs).collect()) == [("", "2:chunk-1", 5), ("a.b", "1:chunk-1", 800), ("a.b", "1:chunk-2", 220)]


def test_medians_and_fit_over_many_scores(spark):
    from statistics import median

    from lodestone.operators import metrics

    values = {"a": [3.0, 1.0, 2.0, 2.0], "b": [5.0], "c": [1.0, 1e9, 2.0, -4.0, 7.0, 7.0], "d": []}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    for buckets in (1, 3, 4_096):
        assert {r.k: r.median for r in metrics.medians(rows, "k", "v", buckets).collect()} == {k: median(v) for k, v in values.items() if v}
    scores = spark.createDataFrame([(i / 20, (i * 7 % 10) / 10, i % 3 > 0) for i in range(20)], "sufficiency double, confidence double, correct boolean")
    few, many = metrics.fit_selective(scores, epochs=4), metrics.fit_selective(scores, epochs=4, most=3)
    assert all(abs(x - y) < 1e-9 for x, y in zip(few, many))
