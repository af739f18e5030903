"""Conflicts by fact, guarded answers, first-wins hits, labels and strict readers."""

import random

from pyspark.sql import functions as F

from lodestone.operators import answering, judging, structured

FACTS = "qid string, fact_no long, description string, terms array<string>, conflict_terms array<string>"
SNIPPETS = "qid string, sid string, text string, corpus_id string"


def test_conflicts_count_only_among_what_supports_the_fact(spark):
    facts = spark.createDataFrame([("a", 1, "founding", ["founded"], ["1901", "1905"]), ("a", 2, "seat", ["seat"], ["1901", "1905"]), ("b", 1, "x", ["founded"], None), ("b", 2, "y", ["founded"], [])], FACTS)
    found = spark.createDataFrame([("a", "s1", "Founded in 1901.", "c"), ("a", "s2", "FOUNDED in 1905", "c"), ("a", "s3", "the seat of 1901", "c"), ("a", "s4", None, "c"), ("b", "s1", "founded 1901 or 1905", "c")], SNIPPETS).withColumn("term", F.lit("clash"))
    got = [tuple(r) for r in judging.fact_conflicts(facts, found).select("qid", "fact_no", "term", "sids").orderBy("term").collect()]
    assert got == [("a", 1, "1901", "s1"), ("a", 1, "1905", "s2")]
    claims = spark.createDataFrame([("a", 1, ["s1"])], "qid string, claim_no long, sids array<string>")
    labels = {r.qid: (r.label, r.conflicts, r.score) for r in judging.assess(facts, found, claims, by_fact=True).collect()}
    assert labels == {"a": ("conflicting", 1, 0.5), "b": ("sufficient", 0, 1.0)}
    # without values that exclude each other nothing conflicts
    assert {r.label for r in judging.assess(facts.drop("conflict_terms"), found, claims, by_fact=True).collect()} == {"sufficient"}
    assert judging.fact_conflicts(facts.limit(0), found).count() == 0


def test_guarded(spark):
    claim = lambda n, *sids: (n, list(sids))
    rows = [
        ("a", "An answer.", "answered", "sufficient", 0, [claim(1, "s1"), claim(2, "s2")]), ("b", "An answer.", "answered", "sufficient", 0, [claim(1, "s1"), claim(2, "s9")]), ("c", "An answer.", "answered", "conflicting", 0, [claim(1, "s1")]),
        ("d", "Part.", "partial", "useful_but_incomplete", 1, [claim(1, "s1", "s9")]), ("e", "All.", "answered", "useful_but_incomplete", 1, []), ("f", "All.", "answered", "insufficient", 1, [claim(1, "s9")]), ("g", None, "answered", "sufficient", 0, []),
    ]
    answers = spark.createDataFrame(rows, "qid string, answer string, answer_status string, label string, missing int, claims array<struct<claim_no:bigint,sids:array<string>>>")
    found = spark.createDataFrame([(q, s, "t", "c") for q in "abcdef" for s in ("s1", "s2")], SNIPPETS)
    got = {r.qid: (r.status, r.answer, [(c.claim_no, c.sids) for c in r.claims], r.dropped) for r in answering.guarded(answers, found).collect()}
    assert got == {
        "a": ("answered", "An answer.", [(1, ["s1"]), (2, ["s2"])], 0), "b": ("partial", "An answer.", [(1, ["s1"])], 1), "c": ("partial", answering.CONFLICTING, [(1, ["s1"])], 0), "d": ("partial", "Part.", [(1, ["s1"])], 0),
        "e": ("partial", answering.INCOMPLETE, [], 0), "f": ("unanswerable", answering.NO_ANSWER, [], 0), "g": ("answered", "", [], 0),
    }


def brute_first_wins(hits):
    ids, keys, out = set(), set(), []
    for place, sid, corpus, document, text in sorted(hits):
        key = (corpus, document, " ".join((text or "").lower().split()))
        if sid in ids or key in keys:
            continue
        ids.add(sid)
        keys.add(key)
        out.append(place)
    return out


def test_first_wins_against_one_by_one(spark):
    rng, rows = random.Random(6), []
    for q in range(30):
        rows += [(f"q{q}", p, rng.choice("abcd"), rng.choice("xy"), rng.choice("12"), rng.choice(["Some text", "some  TEXT ", "other", "", None])) for p in range(rng.choice([1, 5, 12]))]
    df = spark.createDataFrame(rows, "qid string, place long, sid string, corpus_id string, document_id string, text string").withColumn("key", F.lit("clash"))
    got = {}
    for r in answering.first_wins(df).collect():
        got.setdefault(r.qid, []).append(r.place)
    assert {q: sorted(p) for q, p in got.items()} == {q: brute_first_wins([r[1:] for r in rows if r[0] == q]) for q in got} and len(got) == 30
    assert answering.first_wins(df.limit(0)).count() == 0


def test_labels(spark):
    rows = spark.createDataFrame([("a.pdf", 3, "c1"), ("a.pdf", None, "c2"), (None, None, "c3")], "n string, p int, c string")
    assert [r[0] for r in rows.select(answering.citation_label(F.col("n"), F.col("p"), F.col("c"))).collect()] == ["[a.pdf, Page 3, Chunk c1]", "[a.pdf, Chunk c2]", "[Chunk c3]"]


def test_strict_and_older_readers(spark):
    texts = ['{"k": 3}', '{"k": "3"}', '{"j": 1}', "[1]", "{k: 1}", None, "", '{"k": 2.5}', '{"k": null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(structured.strict(F.col("t"), {"k": "number"})).collect()]
    assert got[:7] == ["", "k must be a number", "missing required field(s): k", "not an object", "not JSON", "not JSON", "not JSON"] and got[7] == "" and got[8] != ""
    old = ['{"status": "SUFFICIENT", "confidence": 0.7, "missing_facts": ["a"]}', '{"status": "insufficient", "sufficiency_score": 0.2, "confidence": 0.9}', '{"status": "maybe", "confidence": 1}', '{"status": "sufficient"}', '{"status": "sufficient", "confidence": "x"}', "[]", None, "{bad"]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in old], "t string").select(structured.assessment(F.col("t"))).collect()]
    assert (out[0].status, out[0].score, out[0].missing_facts, out[0].error) == ("sufficient", 0.7, ["a"], "") and out[1].score == 0.2
    assert [x.error for x in out[2:5]] == ["invalid status", "neither sufficiency_score nor confidence", "confidence must be a number"] and all(x.status is None and x.error for x in out[2:])
