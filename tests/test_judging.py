"""Judging, answering, metrics, record checks."""

import math

from pyspark.sql import functions as F

from lodestone.operators import answering, contracts, judging, metrics, structured


def frames(spark):
    facts = spark.createDataFrame([("a", 1, "river depth"), ("a", 2, "river name"), ("b", 1, "loan"), ("c", 1, "gate"), ("d", 1, "the")], "qid string, fact_no long, description string")
    snippets = spark.createDataFrame(
        [("a", "s1", "The RIVER has a depth", "k"), ("a", "s2", "name", "k"), ("b", "s1", "a loan of 5", "k"), ("b", "s2", "a loan of 6", "k"), ("d", "s1", None, "k")], "qid string, sid string, text string, corpus_id string"
    )
    claims = spark.createDataFrame([("a", 1, "The river is deep", ["s1"]), ("b", 1, "loan", ["s9"]), ("b", 2, "x", [])], "qid string, claim_no long, text string, sids array<string>")
    return facts, snippets, claims


def test_assessment_branches(spark):
    got = {r.qid: (r.covered, r.unsupported, round(r.score, 3), r.label) for r in judging.assess(*frames(spark)).collect()}
    assert got == {"a": (1, 0, 0.5, "useful_but_incomplete"), "b": (1, 2, 0.5, "conflicting"), "c": (0, 0, 0.0, "unanswerable"), "d": (1, 0, 1.0, "sufficient")}


def test_unsupported_and_guard(spark):
    _, snippets, claims = frames(spark)
    assert sorted(map(tuple, judging.unsupported(claims, snippets).collect())) == [("b", 1), ("b", 2)]
    assert [tuple(r) for r in judging.known_citations(claims, snippets).collect()] == [("a", 1, "s1", 0)]


def test_claim_support(spark):
    _, snippets, claims = frames(spark)
    got = {(r.qid, r.claim_no): round(r.support, 3) for r in judging.claim_support(claims, snippets).collect()}
    assert got == {("a", 1): 0.667, ("b", 1): 0.0, ("b", 2): 0.0}


def test_empty_tables(spark):
    facts, snippets, claims = (x.limit(0) for x in frames(spark))
    assert judging.assess(facts, snippets, claims).count() == 0


def test_grounded_answers(spark):
    rows = spark.createDataFrame(
        [("q", "Who leads the loan office?", 1, "c1", "d", "Nothing here today. Nina leads the office. Nina leads the office."), ("q", "Who leads the loan office?", 2, "c2", "d", "Nina leads the office. The loan office leads on."), ("r", "zzz?", 1, "c3", "d", "First one here. Second.")],
        "qid string, question string, rank long, chunk_id string, document_id string, text string",
    )
    got = {r.qid: r for r in answering.grounded(rows).collect()}
    assert got["q"].answer == "The loan office leads on. Nina leads the office." and got["q"].chunk_ids == "c2,c1" and got["q"].confidence == 0.94
    assert got["r"].answer == "First one here." and got["r"].claims == 1
    claims = answering.claims(rows.withColumn("text", F.lit("Same  text"))).collect()
    assert sorted((r.qid, r.claim_no, r.chunk_id, r.claim) for r in claims) == [("q", 1, "c1", "Same text"), ("r", 1, "c3", "Same text")]


def test_binary_metrics_without_positives(spark):
    rows = spark.createDataFrame([(False, True), (False, False), (None, True)], "predicted boolean, actual boolean")
    got = metrics.binary(rows).first()
    assert (got.tp, got.tn, got.fp, got.fn, got.accuracy, got.precision, got.f1) == (0, 1, 0, 1, 0.5, 0.0, 0.0)
    assert metrics.binary(rows.limit(0)).first().f1 == 0.0


def test_accuracy_coverage_against_brute_force(spark):
    data = [(i * 37 % 101 / 101, i % 3 > 0) for i in range(60)] + [(0.5, True), (0.02, False), (1.0, True)]
    rows = spark.createDataFrame(data, "p double, correct boolean")
    got = metrics.accuracy_coverage(rows).orderBy("tau").collect()
    for i, r in enumerate(got):
        hit = [c for p, c in data if p >= i / 50]
        assert (r.attempted, r.correct) == (len(hit), sum(hit))
        assert math.isclose(r.accuracy, sum(hit) / len(hit) if hit else 1.0)
    assert metrics.accuracy_coverage(rows.limit(0)).count() == 0


def test_selective_fit_moves_towards_the_data(spark):
    rows = spark.createDataFrame([(1.0, 0.9, True)] * 5 + [(0.0, 0.4, False)] * 5, "sufficiency double, confidence double, correct boolean")
    w1, _, b = metrics.fit_selective(rows)
    assert w1 > 2.5 and b < -2
    assert metrics.fit_selective(rows.limit(0)) == (2.5, 1.5, -2.0)


def test_structured_repair(spark):
    raw = ['{"sufficient": true, "probability": 2}', 'x\n```json\n{"sufficient": true, "probability": 0.5,}\n```', "{'sufficient': True, 'probability': 0.25}", "sufficient: yes and probability: 0.3", "garbage", "", None]
    got = [tuple(r.x)[:2] for r in spark.createDataFrame([(t,) for t in raw], "t string").select(structured.sufficiency(F.col("t")).alias("x")).collect()]
    assert got == [(True, 1.0), (True, 0.5), (True, 0.25), (True, 0.3), (False, 0.0), (False, 0.0), (False, 0.0)]


def test_contracts(spark):
    rows = spark.createDataFrame([(1, "a", 2), (2, None, -1), (2, "", 3)], "id long, name string, n long")
    assert sorted(map(tuple, contracts.errors(rows, "id", {"unnamed": F.trim("name") != "", "negative": F.col("n") >= 0}).collect())) == [(2, "negative"), (2, "unnamed"), (2, "unnamed")]
    assert [tuple(r) for r in contracts.repeated(rows, "id").collect()] == [(2, 2)]
