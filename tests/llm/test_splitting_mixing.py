"""Cutting long texts and mixing sources."""

import itertools
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import mixing, splitting


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.integers(5, 30), st.data())
def test_cuts_keep_to_the_limit(kinds, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    ends = splitting.best_cuts(np.array(kinds), limit, overlap)
    assert ends[-1] == len(kinds)
    begin = 0
    for e in ends:
        assert 0 < e - begin <= limit and begin >= 0
        begin = e - overlap
    assert ends == sorted(set(ends))


def cost(kinds, ends, limit, overlap):
    n, step = len(kinds), limit - overlap
    m = -(-(n - overlap) // step)
    ideal = (n + (m - 1) * overlap) / m
    total, begin = 0.0, 0
    for e in ends:
        total += 4.0 + 6.0 * ((e - begin - ideal) / ideal) ** 2 + (splitting.PENALTY[kinds[e - 1]] if e < n else 0)
        begin = e - overlap
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 4]), min_size=9, max_size=14))
def test_cuts_are_the_cheapest(kinds):
    limit, overlap = 6, 2
    best = cost(kinds, splitting.best_cuts(np.array(kinds), limit, overlap), limit, overlap)
    n = len(kinds)
    for k in range(1, 6):
        for cut in itertools.combinations(range(overlap + 1, n), k):
            ends, begin, ok = [*cut, n], 0, True
            for e in ends:
                ok &= 0 < e - begin <= limit
                begin = e - overlap
            if ok:
                assert best <= cost(kinds, ends, limit, overlap) + 1e-9


def test_pieces_end_naturally_and_repeat(spark):
    text = " ".join(f"Sentence {i} has some words, and ends." for i in range(200))
    rows = [("page", "a", text), ("page", "a", text), ("page", "b", "x " * 550), ("page", "c", "x " * 551), ("page", "d", None), ("page", "e", ""), ("chunk", "a", "x" * 9_000), ("page", "f", "y" + "-y" * 400)]
    df = spark.createDataFrame(rows, "kind string, id string, text string").withColumn("piece", F.lit("clash"))
    got = {}
    for r in splitting.split_long(df).orderBy("kind", "id", "piece").collect():
        got.setdefault((r.kind, r.id), []).append(r)
    assert set(got) == {("page", "a"), ("page", "c"), ("page", "f")}
    tokens = splitting.TOKEN.findall
    for key, pieces in got.items():
        assert [p.piece for p in pieces] == list(range(1, len(pieces) + 1))
        assert all(len(tokens(p.text)) == p.tokens <= 550 for p in pieces)
        for p, q in zip(pieces, pieces[1:]):
            assert tokens(p.text)[-80:] == tokens(q.text)[:80]
        joined = tokens(pieces[0].text) + [t for p in pieces[1:] for t in tokens(p.text)[80:]]
        assert joined == tokens(next(t for k, i, t in rows if (k, i) == key))
    assert all(p.cut in ("sentence", "end") for p in got["page", "a"])
    assert splitting.split_long(df.limit(0)).count() == 0


needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="needs the tokenizer files")


@needs_tokenizer
def test_mix_reaches_its_shares(spark):
    # a third of all rows in one source, layouts of its name, a source without target, one without documents
    rows = [(i, f"some words about number {i} and more " * 20, "Big-Source" if i % 3 == 0 else ("small" if i % 30 == 1 else ("mid" if i % 3 == 1 else "other"))) for i in range(600)]
    rows += [(5, "again", "mid"), (900, None, "mid"), (901, "", "mid"), (902, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, targets, block=512)
    s = {r.source: r for r in shares.collect()}
    assert set(s) == {"big_source", "mid", "small", "absent"} and s["absent"].used_tokens == 0
    for name, want in (("big_source", 0.5), ("mid", 0.3), ("small", 0.15)):
        assert abs(s[name].actual_share - want / 0.95) < 0.04 and s[name].most_uses <= s[name].max_repeats
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("pass").alias("p")).collect()
    assert all(r.n == r.p for r in uses)
    # every stretch of the schedule has the shares: low discrepancy
    slots = [r.source for r in mixed.select("slot", "source").distinct().orderBy("slot").collect()]
    for n in (len(slots) // 4, len(slots) // 2, len(slots)):
        assert abs(slots[:n].count("big_source") - n * 0.5 / 0.95) <= 3
    again = mixing.mix(docs, targets, block=512)[0]
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, again.collect()))


@needs_tokenizer
def test_mix_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mixed, shares = mixing.mix(docs, targets)
    assert mixed.count() == 0 and [r.actual_share for r in shares.collect()] == [0.0]
    one = spark.createDataFrame([(1, "a few words", "a")], "doc_id long, text string, source string")
    assert mixing.mix(one, targets)[1].first().actual_share == 1.0
    short = mixing.mix(one, targets, block=2, total_tokens=100)[1].first()
    assert short.most_uses == 2 and short.used_tokens == 2 * short.available_tokens


@needs_tokenizer
def test_counts_are_the_tokenizers():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(mixing.TOKENIZER.replace(".tiktoken", ".json"))
    for text in ("Hello world, it's 1984!", "Übergrößenträger  \n\n x", "日本語 text"):
        assert len(mixing._encoding(mixing.TOKENIZER).encode_ordinary(text)) == len(other.encode(text, add_special_tokens=False).ids)


@needs_tokenizer
def test_blocks_are_of_equal_tokens(spark):
    rows = [(i, f"number {i} says " + "some words and more " * (400 if i == 50 else i % 40), ["big", "big", "mid", "small"][i % 4] if i < 400 else "big") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], "source string, target_share double, max_repeats int")
    pieces, shares = mixing.blocks(docs, targets, block=128)
    slots, uses = {}, {}
    for r in pieces.orderBy("slot", "offset").collect():
        assert r.offset == slots.get(r.slot, (0, r.source))[0] and slots.get(r.slot, (0, r.source))[1] == r.source and r.tokens > 0
        slots[r.slot] = (r.offset + r.tokens, r.source)
        uses.setdefault((r.doc_id, r["pass"]), []).append((r.start, r.tokens))
    # every slot is there and full, but for the last of a source that is used up
    assert sorted(slots) == list(range(len(slots)))
    partial = [source for size, source in slots.values() if size != 128]
    assert len(partial) == len(set(partial)) and all(size <= 128 for size, _ in slots.values())
    # the pieces of a use follow each other
    for found in uses.values():
        at = min(found)[0]
        for start, size in sorted(found):
            assert start == at
            at = start + size
    for r in shares.collect():
        assert abs(r.actual_share - r.target_share) < 0.02 and r.most_uses <= r.max_repeats
        assert r.used_tokens == sum(size for size, source in slots.values() if source == r.source)
