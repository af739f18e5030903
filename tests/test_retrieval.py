"""Search, fusion, reranking, planning."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import index, planning, retrieval

CHUNKS = [("c1", "The river of Lomdan floods the valley."), ("c2", "A loan was repaid in Lomdan."), ("c3", "River river valley loan"), ("c4", ""), ("c5", None), ("c6", "River river valley loan")]


def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, text string").withColumn("first", F.lit("clash"))


def questions(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, question string").withColumn("term", F.lit("clash"))


def brute_bm25(query):
    tokens = lambda t: [x for x in re.findall("[a-z0-9]+", (t or "").lower()) if len(x) > 1]
    docs = {c: tokens(t) for c, t in CHUNKS}
    avg = sum(map(len, docs.values())) / len(docs)
    out = {}
    for c, d in docs.items():
        s = 0.0
        for t in tokens(query):
            df = sum(t in x for x in docs.values())
            if t in d:
                tf = d.count(t)
                s += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s:
            out[c] = s
    return out


def test_bm25_against_brute_force_with_repeats_and_ties(spark):
    got = retrieval.bm25(questions(spark, ("a", "river river valley"), ("b", "river river valley"), ("c", "zzz"), ("d", None), ("e", "loan")), chunks(spark), 3)
    rows = got.orderBy("qid", "rank").collect()
    assert {r.qid for r in rows} == {"a", "b", "e"}
    want = brute_bm25("river river valley")
    for r in rows:
        if r.qid in "ab":
            assert abs(r.score - want[r.chunk_id]) < 1e-9
    assert [r.chunk_id for r in rows if r.qid == "a"] == ["c3", "c6", "c1"]


def test_bm25_by_join_and_without_broadcast_is_the_same(spark, monkeypatch):
    q = questions(spark, ("a", "river loan"), ("e", "valley of Lomdan"), ("n", None))
    many = chunks(spark).unionByName(spark.range(3_000).select(F.concat(F.lit("x"), F.col("id")).alias("chunk_id"), F.when(F.col("id") % 7 == 0, "a loan by the river").otherwise("no such word").alias("text"), F.lit("").alias("first")))
    rows = lambda: sorted((r.qid, r.chunk_id, round(r.score, 9), r["rank"]) for r in retrieval.bm25(q, many).collect())
    one = rows()
    assert len(one) == 24
    monkeypatch.setattr(retrieval, "BATCH_TERMS", 0)
    assert rows() == one
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    assert rows() == one


def test_empty_inputs(spark):
    assert retrieval.bm25(questions(spark, ("a", "x")).limit(0), chunks(spark)).count() == 0
    assert retrieval.bm25(questions(spark, ("a", "river")), chunks(spark).limit(0)).count() == 0
    assert retrieval.dense(questions(spark, ("a", "river")).limit(0), chunks(spark)).count() == 0


def test_vectors_have_length_one_and_blocks_do_not_matter(spark):
    v = index.vector("The river of Lomdan")
    assert abs(np.linalg.norm(v) - 1) < 1e-12 and not index.vector("").any() and not index.vector(None).any()
    rows = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * (k + 1)) for k in range(4)]).alias("vector"))
    q = rows.where("id % 20 = 0").withColumnRenamed("id", "qid")
    one = sorted(map(tuple, retrieval.nearest(q, rows, "id", "long", 5).select("qid", "id", "rank").collect()))
    many = sorted(map(tuple, retrieval.nearest(q, rows, "id", "long", 5, block=3).select("qid", "id", "rank").collect()))
    data = np.array([[math.sin(i * (k + 1)) for k in range(4)] for i in range(200)])
    want = []
    for i in range(0, 200, 20):
        order = sorted(range(200), key=lambda j: (-round(float(data[i] @ data[j]), 9), j))[:5]
        want += [(i, j, n + 1) for n, j in enumerate(order)]
    assert one == many == sorted(want)


def test_fusion_is_symmetric_but_for_ties(spark):
    a = spark.createDataFrame([("q", "c1", 1), ("q", "c2", 2)], "qid string, chunk_id string, rank long")
    b = spark.createDataFrame([("q", "c2", 1), ("q", "c3", 2)], "qid string, chunk_id string, rank long")
    one = {r.chunk_id: (round(r.score, 12), r["rank"]) for r in retrieval.fuse(a, b).collect()}
    two = {r.chunk_id: round(r.score, 12) for r in retrieval.fuse(b, a).collect()}
    assert one["c2"][1] == 1 and {k: v[0] for k, v in one.items()} == two


def test_rerank_prefers_the_phrase(spark):
    c = spark.createDataFrame([("x", "loan of the river"), ("y", "the river loan is here"), ("z", None)], "chunk_id string, text string")
    cand = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3), ("q", "gone", 4)], "qid string, chunk_id string, rank long")
    got = retrieval.rerank(cand, questions(spark, ("q", "river loan")), c).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "z"] and abs(got[0].score - 5.1) < 1e-9


def test_lexical_order_and_routing(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a", "leads Zen"), (2, "b", "leads Zen"), (3, "b", "nothing"), (4, "a", None)], "doc_id long, corpus_id string, text string")
    q = spark.createDataFrame([("q", "leading zen", ["a", "b"]), ("r", "leads zen", ["b"]), ("s", "", ["a"])], "qid string, query string, corpora array<string>")
    got = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in retrieval.lexical(q, d).collect())
    assert got == [("q", 1, 1, 2.0), ("q", 2, 2, 2.0), ("r", 1, 2, 4.0)]
    big = d.unionByName(spark.range(100, 5_000).selectExpr("id doc_id", "if(id % 2 = 0, 'a', 'b') corpus_id", "if(id % 9 = 0, 'he leads a zen walk', 'walk') text"))
    both = []
    for terms in (10, 0):
        monkeypatch.setattr(retrieval, "BATCH_TERMS", terms)
        for options in ({}, {"stemmed": False}, {"ratio": True, "phrase": False}):
            both.append(sorted((r.qid, r["rank"], r.doc_id, round(r.score, 9)) for r in retrieval.lexical(q, big, **options).collect()))
    assert both[:3] == both[3:] and len(both[0]) == 10


def test_planning(spark):
    q = questions(spark, ("1", "Who founded NovaTech and when was it founded?"), ("2", "Where is it?"), ("3", "  "), ("4", None), ("5", "Who and who?"))
    got = sorted(map(tuple, planning.plan_facts(q).collect()))
    assert got == [("1", 1, "Who founded NovaTech"), ("1", 2, "when was it founded about NovaTech"), ("2", 1, "Where is it"), ("5", 1, "Who")]
    corpora = spark.createDataFrame([("company", "profiles of founded firms"), ("legal", "rulings")], "id string, description string")
    routed = sorted((r.qid, r.fact_no, r.corpus_id, r.place) for r in planning.routes(planning.plan_facts(q), corpora).collect())
    assert routed == [("1", 1, "company", 1), ("1", 2, "company", 1), ("2", 1, "company", 1), ("2", 1, "legal", 2), ("5", 1, "company", 1), ("5", 1, "legal", 2)]
    row = spark.createDataFrame([("What did the firm make in May", "revenue of firm")], "q string, m string").select(planning.reformulated(F.col("q"), F.col("m")).alias("x")).first()
    assert row.x == "did firm make revenue"


def test_relevance(spark):
    ranked = spark.createDataFrame([("a", "x", 1), ("a", "y", 7)], "qid string, item string, rank long")
    truth = spark.createDataFrame([("a", "y"), ("b", "z")], "qid string, item string")
    assert retrieval.relevance(ranked, truth).first().asDict() == {"queries": 2, "recall_5": 0.0, "recall_10": 0.5, "mrr": 0.0714}


def test_spans(spark):
    text = "Once Nina leads the Zen office"
    assert retrieval._span(text, "leads the zen", set()) == (10, 23)
    assert text[slice(*retrieval._span(text, "who is nina of zen", {"nina", "zen"}))] == "Nina leads the Zen"
    d = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    q = spark.createDataFrame([("a", "Nina, Zen"), ("b", "absent")], "qid string, query string")
    hits = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2), ("c", 1)], "qid string, doc_id long")
    assert sorted(map(str, retrieval.spans(hits, q, d).collect())) == sorted(map(str, spark.createDataFrame([("a", 1, 5, 23), ("b", 1, None, None), ("a", 2, None, None)], "qid string, doc_id long, start long, end long").collect()))
