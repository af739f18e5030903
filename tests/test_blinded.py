"""The blinded sample of the benchmark."""


def test_half_of_the_questions_of_each_source_with_all_variants(spark, tmp_path):
    import duckdb

    from lodestone.plans import metric_queries as M

    rows = [(f"{s}{q:02d}{v}", s, f"question {19 - q}", f"context {v}", "label") for s in ("a", "b") for q in range(20) for v in ("x", "y")]
    rows += [rows[0], (None, "a", "question 1", "c", "label"), ("z", None, "question 1", "c", "label"), ("z2", "a", None, "c", "label")]
    path = str(tmp_path / "sufficiency_benchmark.parquet")
    spark.createDataFrame(rows, "id string, source_dataset string, original_question string, context string, gold_label string").coalesce(1).write.parquet(path)
    want = sorted((f"{s}{q:02d}{v}", s, f"question {19 - q}", f"context {v}", "", "") for s in ("a", "b") for q in range(20) if q % 10 in (0, 1, 4, 6, 9) for v in ("x", "y"))
    assert sorted(map(tuple, M.blinded_benchmark_subset(spark, str(tmp_path)).collect())) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW sufficiency_benchmark AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert sorted(con.execute(M.SQL["blinded_benchmark_subset"]).fetchall()) == want
