"""Near-duplicates against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import near_dup

WORDS = [f"w{i}" for i in range(400)]


def sets(text, k):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def collection(seed=1):
    rng, rows = random.Random(seed), []
    for d in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.choice([22, 40, 120, 400]))]
        for v in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(int(len(w) * rng.choice([0, 0.02, 0.06, 0.12]))):
                at, how = rng.randrange(len(w)), rng.random()
                if how < 0.5:
                    w[at] = rng.choice(WORDS)
                elif how < 0.75:
                    del w[at]
                else:
                    w.insert(at, rng.choice(WORDS))
            if v == 3:
                w = w[len(w) // 4 :] + w[: len(w) // 4]
            rows.append(("page" if d % 3 else "chunk", f"{d}-{v}", " ".join(w)))
    return rows


def brute(rows, k, threshold, least):
    found = set()
    have = [(kind, i, sets(t, k)) for kind, i, t in rows if len(re.findall(r"[^\W_]+", t or "")) >= least]
    for x in range(len(have)):
        for y in range(x):
            (ka, a, sa), (kb, b, sb) = have[x], have[y]
            if ka == kb and a != b and len(sa & sb) >= threshold * len(sa | sb) > 0:
                found.add((ka, min(a, b), max(a, b)))
    return found


@pytest.mark.parametrize("words,similarity,least", [(3, 0.5, 20), (5, 0.8, 1)])
def test_pairs_against_brute_force(spark, words, similarity, least):
    rows = collection()
    # exact copies, another layout, repeated delivery, nulls, short and very long texts
    rows += [("page", "copy", rows[5][2].upper().replace(" ", ",  ")), rows[7], ("page", "null", None), ("page", "empty", ""), ("page", "short", "a b c"), ("page", "short2", "a b c")]
    rows += [("page", "long1", " ".join(f"x{i}" for i in range(30_000))), ("page", "long2", " ".join(f"x{i}" for i in range(2_000, 31_000)))]
    df = spark.createDataFrame(rows, "kind string, id string, text string").withColumn("tokens", F.lit("clash")).withColumn("n", F.lit(0))
    got = [tuple(r) for r in near_dup.pairs_of_records(*near_dup.near_duplicates(df, words, similarity, least)).select("kind", "id_a", "id_b").collect()]
    want = brute(list(dict.fromkeys(rows)), words, similarity, least)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.97 * len(want) and len(want) > 25


def test_groups_are_components_of_the_links(spark):
    rows = collection(3) + [("page", f"same{i}", "one text that is given many times over " * 4) for i in range(50)]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    members, classes, links = near_dup.near_duplicates(df, 3, 0.5, 20)
    got = {(r.kind, r.id): r for r in near_dup.groups_of_records(members, classes, links).collect()}
    assert len(got) == len({r[:2] for r in rows})
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for kind, a, b in near_dup.pairs_of_records(members, classes, links).select("kind", "id_a", "id_b").collect():
        parent[root((kind, a))] = root((kind, b))
    of = {}
    for k in got:
        of.setdefault(root(k), set()).add(got[k].group_id)
    assert all(len(g) == 1 for g in of.values()) and len({next(iter(g)) for g in of.values()}) >= len(of) - 1
    assert got["page", "same7"].copies == 50 and got["page", "same7"].group_id == "same0"


def test_chain_is_one_component(spark):
    links = spark.range(300).selectExpr("id a", "id + 1 b").unionByName(spark.createDataFrame([(1000, 1001)], "a long, b long"))
    got = {r.cid: r.root for r in near_dup.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert near_dup.components(links.limit(0)).count() == 0


def test_empty(spark):
    df = spark.createDataFrame([], "kind string, id string, text string")
    assert near_dup.pairs_of_records(*near_dup.near_duplicates(df)).count() == 0


def test_text_that_repeats_itself(spark):
    """A text of one paragraph said many times has few different windows; all that it shares is still found."""
    rng = random.Random(8)
    rows = []
    for d in range(12):
        paragraph = " ".join(rng.choice(WORDS) for _ in range(60))
        rows += [("page", f"{d}-a", " ".join([paragraph] * 30)), ("page", f"{d}-b", " ".join([paragraph] * 25))]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    got = {tuple(r) for r in near_dup.pairs_of_records(*near_dup.near_duplicates(df, 3, 0.5, 20)).select("kind", "id_a", "id_b").collect()}
    assert got == brute(rows, 3, 0.5, 20) and len(got) >= 12


def test_hot_tokens_and_many_copies_in_parts(spark):
    """Texts with a paragraph in common, and copies of one text: split keys give the same pairs as whole ones."""
    rng = random.Random(9)
    shared = " ".join(rng.choice(WORDS) for _ in range(25))
    rows = [("page", f"p{i}", f"{shared} " + " ".join(rng.choice(WORDS) for _ in range(rng.choice([8, 10, 200])))) for i in range(80)]
    rows += [("page", f"c{i}", "one text that is given many times over and over " * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "kind string, id string, text string")
    whole = near_dup.near_duplicates(df, 3, 0.5, 20)
    split = near_dup.near_duplicates(df, 3, 0.5, 20, group_rows=4, hot_rows=5)
    pairs = lambda found, **how: sorted(tuple(r) for r in near_dup.pairs_of_records(*found, **how).select("kind", "id_a", "id_b").collect())
    want = brute(rows, 3, 0.5, 20)
    assert pairs(whole) == pairs(split) == pairs(split, copies_each=3)
    assert set(pairs(whole)) <= want and len(pairs(whole)) >= 0.97 * len(want) and len(want) > 900


def test_groups_reach_over_kinds(spark, tmp_path):
    from lodestone.llm.queries import p2_groups

    rng = random.Random(10)
    page, other = (" ".join(rng.choice(WORDS) for _ in range(80)) for _ in range(2))
    spark.createDataFrame([(1, page), (2, other), (None, page)], "page_id long, text string").write.parquet(f"{tmp_path}/document_pages.parquet")
    spark.createDataFrame([("x", page.rsplit(" ", 8)[0]), ("y", page.upper()), ("z", page[:40])], "chunk_id string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {(r.record_kind, r.record_id): (r.group_id, r.copies, r.links) for r in p2_groups(spark, str(tmp_path)).collect()}
    assert got == {("page", "1"): ("chunk:x", 2, 1), ("chunk", "x"): ("chunk:x", 1, 1), ("chunk", "y"): ("chunk:x", 2, 1), ("page", "2"): ("page:2", 1, 0)}
