"""Queries on pages and documents: cleaning, counting, cutting, indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, index
from lodestone.plans import sql as S
from lodestone.tables import table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "document_pages").dropDuplicates(["page_id"])


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", "document_id", "text").dropDuplicates(["chunk_id"])


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", T.token_count(F.col("text")).alias("tokens"))


def clean_pages(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", T.clean_page(F.col("text")).alias("text"))


def section_headings(spark: SparkSession, folder: str) -> DataFrame:
    return _pages(spark, folder).select("page_id", T.heading(F.col("text")).alias("heading"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("i", "sentence"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), "sentence")


def stemmed_terms(spark: SparkSession, folder: str) -> DataFrame:
    """In how many documents each stem occurs."""
    return table(spark, folder, "documents").select(F.explode(T.stems(F.col("text"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("documents"))


def word_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.word_chunks(table(spark, folder, "document_pages")).select("chunk_id", "page_id", "section", "words", F.md5("text").alias("text_md5"))


def char_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.character_chunks(table(spark, folder, "documents")).select("doc_id", "chunk_number", F.md5("text").alias("text_md5"))


def corpus_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A description of each document from its name and its beginning."""
    rows = table(spark, folder, "documents").dropDuplicates(["doc_id"])
    stem = F.regexp_replace(F.coalesce("document_name", F.lit("")), r"\.[^.]*$", "")
    return rows.select("doc_id", "corpus_id", stem.alias("name"), F.concat_ws(" ", stem, F.substring("text", 1, 500)).alias("description"))


def term_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_frequencies(chunks(spark, folder))


def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    return index.term_statistics(chunks(spark, folder)).select("term", "df", F.round("idf", 6).alias("idf"))


def hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of the chunks' vectors that are not zero."""
    cells = index.embedded(chunks(spark, folder)).select("chunk_id", F.posexplode("vector").alias("i", "x"))
    return cells.select("chunk_id", F.col("i").cast("long").alias("cell"), F.round(F.col("x").cast("double"), 5).alias("value")).where("abs(value) > 0.0001")


def source_names(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters by properly spelled source and language."""
    name = F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_")
    return table(spark, folder, "documents").groupBy(name.alias("source"), F.lower("lang").alias("lang")).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"))


QUERIES = {f.__name__: f for f in (token_counts, clean_pages, section_headings, sentences, stemmed_terms, word_chunks, char_chunks, corpus_catalog, term_frequencies, term_idf, hash_embedding, source_names)}

_LINES = r"list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"
_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '')"
_HEADING = r"regexp_full_match({x}, '#{{1,4}}\s+.+')"
_CAPITALS = r"regexp_matches({x}, '^[A-Z0-9\s_-]{{3,40}}(:|$)') AND len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')) <= 6"


def _first_heading(lines: str) -> str:
    x = "x"
    return f"list_filter({lines}, lambda x: {_HEADING.format(x=x)} OR ({_CAPITALS.format(x=x)}))[1]"


def _heading_of(h: str) -> str:
    return rf"CASE WHEN {_HEADING.format(x=h)} THEN regexp_replace(regexp_extract({h}, '^#{{1,4}}\s+(.+)$', 1), '^\s+|\s+$', '', 'g') ELSE regexp_replace({h}, ':+$', '') END"


SQL = {
    "token_counts": f"WITH {S.PAGES} SELECT page_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{S.TOKEN}')) AS BIGINT) AS tokens FROM p",
    "clean_pages": rf"WITH {S.PAGES} SELECT page_id, coalesce(array_to_string(list_filter({_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:page\s+)?\d+(\s*(?i:of|/)\s*\d+)?$') AND NOT regexp_matches(x, '^(?i:copyright|all rights reserved|\(c\))\b')), chr(10)), '') AS text FROM p",
    "section_headings": f"WITH {S.PAGES}, h AS (SELECT page_id, {_first_heading(_LINES)} AS h FROM p) SELECT page_id, {_heading_of('h')} AS heading FROM h",
    "sentences": f"WITH s AS (SELECT doc_id, {S.sentences('text')} AS l FROM documents) SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS sentence FROM s",
    "stemmed_terms": f"WITH s AS (SELECT DISTINCT doc_id, {S.stem('t')} AS stem FROM (SELECT doc_id, unnest({S.ascii_tokens('text')}) AS t FROM documents)) SELECT stem, count(*) AS documents FROM s GROUP BY stem",
    "word_chunks": rf"""
        WITH {S.PAGES}, w AS (SELECT page_id, document_id, text, {_WORDS} AS w FROM p WHERE trim(text) <> ''),
        v AS (SELECT *, CASE WHEN len(w) <= 550 THEN [0] ELSE list_filter(range(0, len(w), 470), lambda s: s = 0 OR s - 470 + 550 < len(w)) END AS starts FROM w WHERE len(w) > 0),
        n AS (SELECT *, coalesce(sum(len(starts)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM v),
        e AS (SELECT page_id, document_id, text, w, before, unnest(range(0, len(starts))) AS i, unnest(starts) AS s FROM n),
        c AS (SELECT page_id, document_id, before, i, least(550, len(w) - s) AS words, CASE WHEN len(w) <= 550 THEN text ELSE array_to_string(w[s + 1 : s + 550], ' ') END AS text FROM e),
        h AS (SELECT *, {_first_heading(_LINES)} AS h FROM c)
        SELECT document_id || ':chunk-' || CAST(CAST(before + i AS BIGINT) AS VARCHAR) AS chunk_id, page_id,
               coalesce(last_value({_heading_of('h')} IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), document_id) AS section,
               CAST(words AS BIGINT) AS words, md5(text) AS text_md5 FROM h""",
    "char_chunks": rf"""
        WITH d AS (SELECT doc_id, {S.squashed('text')} AS t FROM documents), n AS (SELECT * FROM d WHERE t <> ''),
        s AS (SELECT doc_id, t, list_filter(range(0, length(t), 680), lambda s: s = 0 OR s - 680 + 800 < length(t)) AS starts FROM n),
        e AS (SELECT doc_id, t, unnest(range(1, len(starts) + 1)) AS chunk_number, unnest(starts) AS s FROM s)
        SELECT doc_id, chunk_number, md5(trim(substring(t, s + 1, 800))) AS text_md5 FROM e WHERE trim(substring(t, s + 1, 800)) <> ''""",
    "corpus_catalog": r"SELECT doc_id, corpus_id, regexp_replace(coalesce(document_name, ''), '\.[^.]*$', '') AS name, concat_ws(' ', regexp_replace(coalesce(document_name, ''), '\.[^.]*$', ''), substring(text, 1, 500)) AS description FROM documents",
    "term_frequencies": f"WITH {S.TF} SELECT chunk_id, term, tf FROM tf",
    "term_idf": f"WITH {S.INDEX} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "hash_embedding": f"WITH {S.CHUNKS}, {S.vectors('cv', 'u', 'chunk_id', 'text')} SELECT chunk_id, cell, round(x, 5) AS value FROM cv WHERE abs(round(x, 5)) > 0.0001",
    "source_names": r"SELECT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, lower(lang) AS lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY ALL",
}
