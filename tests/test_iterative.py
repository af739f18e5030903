"""Retrieval in up to three passes."""


def test_three_passes_and_nothing_cut(spark, monkeypatch):
    from lodestone.plans import evidence_queries as E

    texts = {"p1c1": "harbour", "p2c3": "lantern"}
    q = spark.createDataFrame([("open", "harbour lantern glacier"), ("whole", "harbour")], "qid string, question string")
    c = spark.createDataFrame([(f"p{n}c{i}", "d", texts.get(f"p{n}c{i}", "x")) for n in (1, 2, 3, 4) for i in range(1, 7)], "chunk_id string, document_id string, text string")
    calls = []

    def search(asked, chunks, k):
        rows = [r.qid for r in asked.collect()]
        calls.append(sorted(rows))
        n = len(calls)
        found = ["p1c1"] + [f"p{n}c{i}" for i in range(2, 7)]
        return spark.createDataFrame([(x, h, 1.0, i + 1) for x in rows for i, h in enumerate(found)], "qid string, chunk_id string, score double, rank int")

    monkeypatch.setattr(E, "questions", lambda *_: q)
    monkeypatch.setattr(E, "chunks", lambda *_: c)
    monkeypatch.setattr(E.retrieval, "hybrid", search)
    got = E.QUERIES["hybrid_iterative_retrieval"](spark, "").collect()
    held = {x: [r.chunk_id for r in sorted(got, key=lambda r: r.place) if r.qid == x] for x in ("open", "whole")}
    first = ["p1c1"] + [f"p1c{i}" for i in range(2, 7)]
    assert held == {"open": first + [f"p{n}c{i}" for n in (2, 3) for i in range(2, 7)], "whole": first}
    assert calls == [["open", "whole"], ["open"], ["open"]]
