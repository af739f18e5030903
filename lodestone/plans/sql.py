"""Pieces of the SQL that gives the same rows as the queries."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"
PAGES = "p AS (SELECT page_id, any_value(document_id) AS document_id, any_value(text) AS text FROM document_pages GROUP BY page_id)"
CHUNKS = "u AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(text) AS text FROM chunks GROUP BY chunk_id)"


def ascii_tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def index_tokens(x: str) -> str:
    return f"list_filter({ascii_tokens(x)}, lambda t: length(t) > 1)"


def squashed(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({x}, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def stem(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) > {len(s) + 2} THEN left({x}, length({x}) - {len(s)})" for s in ("ing", "ed", "es", "s"))
    return f"CASE {cases} ELSE {x} END"


def words_in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def without(x: str, stops) -> str:
    return f"list_filter({ascii_tokens(x)}, lambda t: t NOT IN {words_in(stops)})"


def first_seen(x: str) -> str:
    """Distinct elements of a list in order of appearance."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


TF = f"{CHUNKS}, tf AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({index_tokens('text')}) AS term FROM u) GROUP BY ALL)"
INDEX = f"""{TF}, dl AS (SELECT chunk_id, len({index_tokens('text')}) AS dl FROM u), n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    idf AS (SELECT term, count(*) AS df, ln(1 + (any_value(n.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, n GROUP BY term)"""
QUESTIONS = "q AS (SELECT id AS qid, original_question AS question FROM sufficiency_benchmark)"


def bm25(out: str, queries: str, top: int) -> str:
    """CTEs of a ranked search of ``queries`` (qid, question) over INDEX."""
    return f"""{out}_t AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({index_tokens('question')}) AS term FROM {queries}) GROUP BY ALL),
    {out}_s AS (SELECT qid, chunk_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
        FROM {out}_t JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (chunk_id), n GROUP BY ALL),
    {out} AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {out}_s) WHERE rank <= {top})"""


def vectors(out: str, source: str, key: str, text: str) -> str:
    """CTEs of hashed vectors: (key, cell, x)."""
    return rf"""{out}_t AS (SELECT {key}, unnest(l) AS w, unnest(range(0, len(l))) AS pos FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{M}}\p{{N}}_]+') AS l FROM {source})),
    {out}_w AS (SELECT DISTINCT w FROM {out}_t),
    {out}_g AS (SELECT w, unnest(list_concat(list_transform(range(1, greatest(length(w) - 1, 1)), lambda i: substring(w, i, 3)), list_transform(range(1, greatest(length(w) - 2, 1)), lambda i: substring(w, i, 4)))) AS g FROM {out}_w),
    {out}_h AS (SELECT w, h % 384 AS cell, sum(CASE WHEN (h >> 8) & 1 = 1 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END) AS x FROM (SELECT w, CAST('0x' || left(md5(g), 8) AS BIGINT) AS h FROM {out}_g) GROUP BY ALL),
    {out}_v AS (SELECT w, CAST('0x' || left(sha256(w), 8) AS BIGINT) AS h FROM {out}_w),
    {out}_p AS (SELECT {key}, cell, x FROM {out}_t JOIN {out}_h USING (w) UNION ALL
        SELECT {key}, h % 384, CASE WHEN (h >> 8) & 1 = 1 THEN 1.5::DOUBLE ELSE -1.5::DOUBLE END / (1 + 0.05::DOUBLE * ln(pos + 1)) FROM {out}_t JOIN {out}_v USING (w)),
    {out}_r AS (SELECT {key}, cell, sum(x) AS x FROM {out}_p GROUP BY ALL),
    {out}_n AS (SELECT {key}, sqrt(sum(x * x)) AS norm FROM {out}_r GROUP BY ALL),
    {out} AS (SELECT {key}, CAST(cell AS BIGINT) AS cell, x / norm AS x FROM {out}_r JOIN {out}_n USING ({key}) WHERE norm > 0)"""


def dense(out: str, top: int) -> str:
    """CTEs of a ranked search of vectors ``qv`` (qid) over ``cv`` (chunk_id)."""
    return f"""{out}_s AS (SELECT qid, chunk_id, sum(qv.x * cv.x) AS score FROM qv JOIN cv USING (cell) GROUP BY ALL),
    {out} AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {out}_s) WHERE rank <= {top})"""
