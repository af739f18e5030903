"""Leaked passages against brute force."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import leakage

W = lambda t: re.findall(r"[^\W_]+", (t or "").lower())


def brute_tiles(d, p, least):
    """Greedy string tiling by its definition."""
    fd, fp, out = [True] * len(d), [True] * len(p), []
    while True:
        best, found = least, []
        for i in range(len(d)):
            for j in range(len(p)):
                n = 0
                while i + n < len(d) and j + n < len(p) and d[i + n] == p[j + n] and fd[i + n] and fp[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return sorted(out)
        for i, j in found:
            if all(fd[i : i + best]) and all(fp[j : j + best]):
                out.append((best, i, j))
                fd[i : i + best] = fp[j : j + best] = [False] * best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=15), st.integers(1, 4))
def test_tiles_against_brute_force(d, p, least):
    got = leakage.tile(np.array(d, dtype=np.uint64), np.array(p, dtype=np.uint64), least)
    assert sorted(got) == brute_tiles(d, p, least)


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(f"i{k}", " ".join(text(40)), " ".join(text(rng.choice([4, 9, 14]))) + "?") for k in range(12)] + [("null", None, None), ("twin", None, None)]
    items[-1] = ("twin", items[0][1], items[0][2])
    docs = []
    for n in range(80):
        body = text(60)
        _, c, q = items[n % 12]
        k = n % 5
        if k == 0:
            cut = W(c)[5 : 5 + rng.choice([12, 13, 20])]
            body[10:10] = [x.upper() + "," for x in cut]
        elif k == 1:
            body[30:30] = W(q)
        docs.append((n, " ".join(body)))
    docs += [(900, None), (901, ""), (902, "short"), docs[0], (903, " ".join(text(20_000)) + " " + items[3][1])]
    want = set()
    for doc, t in docs:
        w = " " + " ".join(W(t)) + " "
        for item, c, q in items:
            cw, qw = W(c), W(q)
            runs = any(" " + " ".join(cw[i : i + 13]) + " " in w for i in range(len(cw) - 12))
            if runs or qw and " " + " ".join(qw) + " " in w:
                want.add((doc, item))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seed", F.lit("clash")).withColumn("part", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id string, context string, question string")
    got = [tuple(r) for r in leakage.leaked(leakage.tilings(d, i)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(leakage, "BROADCAST_SEEDS", 0)
    assert {tuple(r) for r in leakage.leaked(leakage.tilings(d, i)).collect()} == want
    assert leakage.leaked(leakage.tilings(d.limit(0), i)).count() == 0
    assert leakage.leaked(leakage.tilings(d, i.limit(0))).count() == 0


def test_reordered_passages_are_covered(spark):
    w = [f"w{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(w[30:] + w[10:20] + ["x"] + w[:10])), (2, " ".join(w[:9]))], "doc_id long, text string")
    i = spark.createDataFrame([("a", " ".join(w), "")], "item_id string, context string, question string")
    got = leakage.coverage(leakage.tilings(d, i, run=8, least=5), 0.5).collect()
    assert [(r.doc_id, r.tiles, r.covered_share) for r in got] == [(1, 3, 0.75)]


def test_coverage_against_brute_force(spark, monkeypatch):
    """Passages in tiles of five to seven words, and the ends of questions, have no window of eight nor a beginning."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(f"i{k}", " ".join(text(36)), " ".join(text([3, 5, 9, 15][k % 4])) + "?") for k in range(12)] + [("null", None, None), ("empty", "", "")]
    docs = [(900, None), (901, "")]
    for n in range(96):
        _, c, q = items[n % 12]
        c, q, body = W(c), W(q), text(10)
        if n % 5 == 0:
            cuts = [c[i : i + 6] for i in range(0, 36, 6)]
            rng.shuffle(cuts)
            for cut in cuts[: rng.choice([2, 3, 5])]:
                body += cut + text(1)
        elif n % 5 == 1:
            body += q[-rng.choice([5, 7, 12]) :]
        elif n % 5 == 2:
            body += c[10 : 10 + rng.choice([17, 18])]
        elif n % 5 == 3:
            body += q + text(3) + q[:4]
        docs.append((n, " ".join(body + text(10))))
    docs.append(docs[5])
    want = set()
    for doc, t in docs:
        for item, *parts in items:
            for part, p in zip(("context", "question"), map(W, parts)):
                tiles = brute_tiles(W(t), p, 5 if part == "context" else min(5, len(p))) if p and t else []
                if tiles and sum(x[0] for x in tiles) / len(p) >= 0.5:
                    want.add((doc, item, part, len(tiles), sum(x[0] for x in tiles)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id string, context string, question string")

    def got(**more):
        rows = leakage.tilings(d, i, run=8, least=5, **more).where("covered >= 0.5 * words").select("doc_id", "item_id", "part", "tiles", "covered").collect()
        assert len(rows) == len(set(rows))
        return {tuple(r) for r in rows}

    assert len(want) > 40 and got() == want and got(reach=0.5) == want
    assert leakage.coverage(leakage.tilings(d, i, least=5, reach=0.5), 0.5).count() == len(want)
    monkeypatch.setattr(leakage, "BROADCAST_SEEDS", 0)
    assert got(reach=0.5) == want
