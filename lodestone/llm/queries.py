"""Queries of the numbered training-data problems that concern text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import answers, leakage, mixing, near_dup, scans, splitting, subjects
from lodestone.tables import table


def pages_and_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """kind, id, text of all pages and chunks as delivered."""
    pages = table(spark, folder, "document_pages").select(F.lit("page").alias("kind"), F.col("page_id").cast("string").alias("id"), "text")
    chunks = table(spark, folder, "chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    return pages.unionByName(chunks)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.noise(table(spark, folder, "document_pages"))


def p1_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Continuous paragraphs of each file in page order."""
    return scans.continuous(scans.paragraphs(table(spark, folder, "document_pages")))


_NEAR = {"words": 3, "similarity": 0.5, "least_words": 20}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.near_duplicates(pages_and_chunks(spark, folder), **_NEAR)
    return near_dup.pairs_of_records(*found).withColumnRenamed("kind", "record_kind")


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record with its group, over pages and chunks together."""
    texts = pages_and_chunks(spark, folder).select(F.lit("record").alias("kind"), F.concat_ws(":", "kind", "id").alias("id"), "text").where("id like '%:_%'")
    found = near_dup.groups_of_records(*near_dup.near_duplicates(texts, **_NEAR))
    return found.select(F.substring_index("id", ":", 1).alias("record_kind"), F.regexp_replace("id", "^[^:]*:", "").alias("record_id"), "group_id", "copies", "links")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_long(pages_and_chunks(spark, folder), limit=550, overlap=80)
    return pieces.withColumnRenamed("kind", "record_kind").withColumnRenamed("id", "record_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the splitter had to cut: those with a second piece."""
    return p3_pieces(spark, folder).where("piece = 2").select("record_kind", "record_id")


def _answer_defects(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "per_question_comparison").dropDuplicates(["question_id"])
    sides = [("b0_answer", "b1_answer", "e1_answer"), ("e1_answer", "b1_answer", "b0_answer")]
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("answer"), F.concat_ws(" ", *rest).alias("others")) for f, *rest in sides])).alias("x")
    asked = rows.select(F.col("question_id").alias("id"), "question", F.col("b1_answer").alias("whole"), (F.col("expected_label") == "sufficient").alias("answerable"), each)
    asked = asked.select("id", "x.field", "question", "x.answer", "x.others", "answerable", "whole")
    declined = F.coalesce(F.col("b1_status") != "answered", F.lit(False)) & (F.col("expected_label") != "sufficient")
    whole = rows.select(F.col("question_id").alias("id"), "question", F.col("b1_answer").alias("answer"), F.concat_ws(" ", "b0_answer", "e1_answer").alias("others"), declined.alias("declined"))
    return answers.defects(asked, whole)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _answer_defects(spark, folder).where("defect is not null").select(F.col("id").alias("question_id"), F.col("field").alias("answer_field"), "defect")


def p5_tags(spark: SparkSession, folder: str) -> DataFrame:
    """How many clauses of each field carry each tag, and how many answers each defect."""
    found = _answer_defects(spark, folder)
    tags = found.select(F.col("field").alias("answer_field"), F.lit("clause").alias("counted"), F.explode("tags").alias("name"))
    pairs = found.where("defect is not null").select(F.col("field").alias("answer_field"), F.lit("answer").alias("counted"), F.col("defect").alias("name"))
    return tags.unionByName(pairs).groupBy("answer_field", "counted", "name").agg(F.count("*").alias("number"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sufficiency_benchmark").select(F.col("id").alias("item_id"), "context", F.col("original_question").alias("question"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaked(leakage.tilings(table(spark, folder, "documents"), _items(spark, folder), run=13), run=13)


def p6_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item in tiles of five words or more, also in another order."""
    return leakage.coverage(leakage.tilings(table(spark, folder, "documents"), _items(spark, folder), least=5, reach=0.5), threshold=0.5)


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of records in slots of 1,024 tokens each."""
    return mixing.blocks(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.blocks(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(table(spark, folder, "documents"), table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.prevailing(_areas(spark, folder)).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and sentences of each area in the corpus."""
    found = subjects.prevailing(_areas(spark, folder)).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("hits").alias("sentences"))
    zero = F.lit(0).cast("long")
    return table(spark, folder, "subject_areas").select("subject").distinct().join(found, "subject", "left").select("subject", F.coalesce("documents", zero).alias("documents"), F.coalesce("sentences", zero).alias("sentences"))


QUERIES = {
    "p1_found": p1_found,
    "p1_paragraphs": p1_paragraphs,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p5_found": p5_found,
    "p5_tags": p5_tags,
    "p6_found": p6_found,
    "p6_coverage": p6_coverage,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
_TEXTS = "t AS (SELECT 'page' AS record_kind, CAST(page_id AS VARCHAR) AS id, any_value(text) AS text FROM document_pages GROUP BY page_id UNION ALL SELECT 'chunk', chunk_id, any_value(text) FROM chunks GROUP BY chunk_id)"
_WORDS = r"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"

SQL: dict[str, str] = {
    "p2_found": f"""WITH {_TEXTS}, w AS (SELECT record_kind, id, {_WORDS.format(x='text')} AS w FROM t),
        s AS (SELECT DISTINCT record_kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM w WHERE len(w) >= 20),
        n AS (SELECT record_kind, id, count(*) AS n FROM s GROUP BY ALL),
        b AS (SELECT x.record_kind, x.id AS id_a, y.id AS id_b, count(*) AS b FROM s x JOIN s y ON x.record_kind = y.record_kind AND x.g = y.g AND x.id < y.id GROUP BY ALL)
        SELECT b.record_kind, id_a, id_b FROM b JOIN n x ON x.record_kind = b.record_kind AND x.id = id_a JOIN n y ON y.record_kind = b.record_kind AND y.id = id_b WHERE 2 * b >= x.n + y.n - b""",
    "p2_groups": f"""WITH RECURSIVE {_TEXTS}, w AS (SELECT record_kind, id, record_kind || ':' || id AS k, {_WORDS.format(x='text')} AS w FROM t),
        c AS (SELECT *, min(k) OVER (PARTITION BY w) AS c, count(*) OVER (PARTITION BY w) AS copies FROM w WHERE len(w) >= 20),
        s AS (SELECT DISTINCT c, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS g FROM c WHERE k = c),
        n AS (SELECT c, count(*) AS n FROM s GROUP BY ALL), b AS (SELECT x.c AS a, y.c AS b, count(*) AS b2 FROM s x JOIN s y ON x.g = y.g AND x.c != y.c GROUP BY ALL),
        e AS (SELECT a, b FROM b JOIN n x ON x.c = a JOIN n y ON y.c = b WHERE 2 * b2 >= x.n + y.n - b2),
        r(a, b) AS (SELECT c, c FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a AS c, min(b) AS group_id FROM r GROUP BY ALL),
        l AS (SELECT a AS c, count(*) AS links FROM e GROUP BY ALL)
        SELECT record_kind, id AS record_id, group_id, copies, coalesce(links, 0) AS links FROM c JOIN g USING (c) LEFT JOIN l USING (c)""",
    "p3_found": rf"WITH {_TEXTS} SELECT record_kind, id AS record_id FROM t WHERE len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}]')) > 550",
    "p6_found": f"""WITH i AS (SELECT id AS item_id, {_WORDS.format(x='context')} AS c, {_WORDS.format(x='original_question')} AS q FROM sufficiency_benchmark),
        k AS (SELECT item_id, 13 AS n, unnest(list_transform(range(1, len(c) - 11), lambda j: array_to_string(c[j : j + 12], ' '))) AS g FROM i UNION ALL SELECT item_id, len(q), array_to_string(q, ' ') FROM i WHERE len(q) > 0),
        d AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents), l AS (SELECT DISTINCT n FROM k),
        v AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j : j + n - 1], ' '))) AS g FROM d, l WHERE len(w) >= n)
        SELECT DISTINCT doc_id, item_id FROM v JOIN k USING (n, g)""",
}
