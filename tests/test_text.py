"""Text functions and cutting into chunks."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking
from lodestone.operators.running import total_before


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_clean_page_drops_numbers_and_copyright(spark):
    page = "Page 3 of 9\n  First line  \n\n(c) 2026 Kept\n(c)2026 gone\nCopyright 2026\n12\nLast"
    assert one(spark, T.clean_page(F.col("text")), page) == "First line\n(c) 2026 Kept\nLast"
    assert one(spark, T.clean_page(F.col("text")), None) == ""


def test_headings(spark):
    heading = T.heading(F.col("text"))
    assert one(spark, heading, "plain\n## Two words \nMORE") == "Two words"
    assert one(spark, heading, "ANNUAL REVIEW:\ntext") == "ANNUAL REVIEW"
    assert one(spark, heading, "A B C D E F G H\nno heading") is None
    assert one(spark, heading, None) is None


def test_stems_take_one_suffix(spark):
    rows = spark.createDataFrame([("running",), ("red",), ("boxes",), ("cats",), ("as",), ("ing",)], "w string")
    assert [r.x for r in rows.select(T.stem(F.col("w")).alias("x")).collect()] == ["runn", "red", "box", "cat", "as", "ing"]


def test_tokens_split_at_accents(spark):
    assert one(spark, T.ascii_tokens(F.col("text")), "Naïve A-1 Büro") == ["na", "ve", "a", "1", "b", "ro"]
    assert one(spark, T.index_tokens(F.col("text")), "a bb a bb") == ["bb", "bb"]
    assert one(spark, T.token_count(F.col("text")), "don't  stop_it!") == 5


def test_sentences_and_meaningful(spark):
    assert one(spark, T.sentences(F.col("text")), " One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, T.meaningful(F.col("text")), "What is the cost of the new cost plan?") == ["cost", "new", "plan"]


def windows(words, size, overlap):
    """Brute force of the window rule."""
    if len(words) <= size:
        return [words] if words else []
    out, start = [], 0
    while True:
        out.append(words[start : start + size])
        if start + size >= len(words):
            return out
        start += size - overlap


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 40), min_size=1, max_size=6), st.integers(5, 9), st.integers(0, 4))
def test_word_chunks_against_brute_force(spark, sizes, size, overlap):
    rows = [(i, f"d{i}", 1, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page int, text string")
    got = sorted((r.page_id, int(r.chunk_id.rsplit("-", 1)[1]), r.text) for r in chunking.word_chunks(pages, size, overlap, bucket_pages=2).collect())
    want, n = [], 0
    for i, _, _, text in rows:
        for w in windows(text.split(), size, overlap):
            want.append((i, n, " ".join(w)))
            n += 1
    assert got == want


def test_word_chunks_edges(spark):
    rows = [(1, "a", 1, "x " * 550), (1, "a", 1, "x " * 550), (2, "b", 1, "x " * 551), (3, "c", None, None), (4, "d", 1, "  \n"), (5, "e", 1, "# Head\nshort")]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page int, text string").withColumn("words", F.lit("clash")).withColumn("i", F.lit(0))
    got = {(r.page_id, r.words, r.section) for r in chunking.word_chunks(pages).collect()}
    assert got == {(1, 550, "a"), (2, 550, "b"), (2, 81, "b"), (5, 3, "Head")}
    assert chunking.word_chunks(pages.limit(0)).count() == 0


def test_character_chunks(spark):
    text = "ab  cd " * 30
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None), (1, text)], "doc_id long, text string")
    got = [r.text for r in chunking.character_chunks(rows, 50, 10).orderBy("chunk_number").collect()]
    flat = re.sub(r"\s+", " ", text).strip()
    want, start = [], 0
    while True:
        want.append(flat[start : start + 50].strip())
        if start + 50 >= len(flat):
            break
        start += 40
    assert got == want


def test_total_before_has_no_gaps(spark):
    rows = spark.range(100).selectExpr("id", "id % 2 k", "id v", "id div 7 b")
    got = {r.id: r.before for r in total_before(rows, ["k"], ["id"], "v", "b").collect()}
    assert all(got[i] == sum(j for j in range(i) if j % 2 == i % 2) for i in range(100))
