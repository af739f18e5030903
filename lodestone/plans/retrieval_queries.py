"""Queries that plan questions and retrieve for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import planning, retrieval
from lodestone.plans import sql as S
from lodestone.plans.text_queries import chunks
from lodestone.tables import table


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Questions put to the chunks: those of the held-out items."""
    return table(spark, folder, "sufficiency_benchmark").select(F.col("id").alias("qid"), F.col("original_question").alias("question"))


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of the evaluation log."""
    return table(spark, folder, "per_question_comparison").dropDuplicates(["question_id"]).select(F.col("question_id").alias("qid"), "question")


def _scored(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", *more, F.round("score", 6).alias("score"), "rank")


def bm25_search(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.bm25(questions(spark, folder), chunks(spark, folder)), "chunk_id")


def dense_search(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.dense(questions(spark, folder), chunks(spark, folder)), "chunk_id")


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    q, c = questions(spark, folder), chunks(spark, folder)
    return _scored(retrieval.fuse(retrieval.dense(q, c), retrieval.bm25(q, c)), "chunk_id")


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.hybrid(questions(spark, folder), chunks(spark, folder)), "chunk_id")


def rerank(spark: SparkSession, folder: str) -> DataFrame:
    """Term search, reranked."""
    q, c = questions(spark, folder), chunks(spark, folder)
    return _scored(retrieval.rerank(retrieval.bm25(q, c, 15), q, c), "chunk_id")


def vector_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "vector")
    found = retrieval.nearest(queries, rows, key="vec_id", kind="long", k=11).where("qid != vec_id")
    return _scored(retrieval.best(found.drop("rank"), 10, "vec_id"), "vec_id")


def plan_facts(spark: SparkSession, folder: str) -> DataFrame:
    return planning.plan_facts(asked(spark, folder))


def keyword_plan(spark: SparkSession, folder: str) -> DataFrame:
    facts = planning.keyword_facts(asked(spark, folder))
    routed = planning.routes(facts, table(spark, folder, "corpora"), with_id=False, most=2)
    return routed.join(facts, ["qid", "fact_no"]).select("qid", "fact_no", "description", "corpus_id", "place", F.round("score", 6).alias("score"))


def route_corpora(spark: SparkSession, folder: str) -> DataFrame:
    routed = planning.routes(planning.plan_facts(asked(spark, folder)), table(spark, folder, "corpora"))
    return routed.select("qid", "fact_no", "corpus_id", "place", F.round("score", 6).alias("score"))


def rewrite_queries(spark: SparkSession, folder: str) -> DataFrame:
    """One query a fact, with the corpora it goes to."""
    facts = planning.plan_facts(asked(spark, folder))
    routed = planning.routes(facts, table(spark, folder, "corpora")).groupBy("qid", "fact_no").agg(F.array_join(F.array_sort(F.collect_list("corpus_id")), ",").alias("corpora"))
    return facts.join(routed, ["qid", "fact_no"]).select("qid", F.concat(F.lit("q"), F.col("fact_no").cast("string")).alias("query_id"), F.col("description").alias("query"), "corpora")


def plan_with_feedback(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the question, and one more for what its answer leaves open, unless it is one of them."""
    facts = planning.plan_facts(asked(spark, folder))
    log = table(spark, folder, "per_question_comparison").dropDuplicates(["question_id"]).where("coalesce(e1_status, '') != 'answered'")
    more = log.select(F.col("question_id").alias("qid"), F.lit(99).cast("long").alias("fact_no"), planning.feedback_query(F.col("question")).alias("description")).where("description != ''")
    known = facts.select("qid", planning.fact_key(F.col("description")).alias("key"))
    new = more.withColumn("key", planning.fact_key(F.col("description"))).join(known, ["qid", "key"], "left_anti").drop("key")
    return facts.unionByName(new)


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    q = questions(spark, folder)
    facts = q.select("qid", F.col("question").alias("description"))
    corpora = planning.routes(facts, table(spark, folder, "corpora")).groupBy("qid").agg(F.collect_list("corpus_id").alias("corpora"))
    return q.withColumnRenamed("question", "query").join(corpora, "qid")


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "corpus_id", "text").dropDuplicates(["doc_id"])


def lexical_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.lexical(_routed(spark, folder), _documents(spark, folder)), "corpus_id", "doc_id")


def inmemory_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.lexical(_routed(spark, folder), _documents(spark, folder), stemmed=False), "corpus_id", "doc_id")


def keyword_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(retrieval.lexical(_routed(spark, folder), _documents(spark, folder), stemmed=False, ratio=True, phrase=False, k=3), "corpus_id", "doc_id")


def lexical_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Where each hit of the lexical search matches its question."""
    queries, documents = _routed(spark, folder), _documents(spark, folder)
    return retrieval.spans(retrieval.lexical(queries, documents), queries, documents)


def masked_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """Term search without the file that holds most chunks; its statistics are those of the other files."""
    c = chunks(spark, folder)
    masked = c.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "document_id").limit(1)
    return _scored(retrieval.bm25(questions(spark, folder), c.join(F.broadcast(masked), "document_id", "left_anti"), 10), "chunk_id")


def retrieval_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and reciprocal rank of each mode: does a chunk's first sentence find the chunk?

    Queries are the chunks whose hashed id is divisible by 16.
    """
    c = chunks(spark, folder)
    first = F.try_element_at(T.sentences(F.col("text")), F.lit(1))
    q = c.where("substr(md5(chunk_id), 1, 1) = '0'").select(F.col("chunk_id").alias("qid"), F.coalesce(first, F.lit("")).alias("question"))
    truth = q.select("qid", F.col("qid").alias("item"))
    dense, terms = retrieval.dense(q, c), retrieval.bm25(q, c)
    fused = retrieval.fuse(dense, terms)
    modes = {"dense": dense, "terms": terms, "fused": fused, "reranked": retrieval.rerank(fused.where("rank <= 15"), q, c, 10)}
    out = None
    for name, found in modes.items():
        row = retrieval.relevance(found.withColumnRenamed("chunk_id", "item"), truth).select(F.lit(name).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_ALL = (bm25_search, dense_search, rrf_fusion, hybrid_search, rerank, vector_knn, plan_facts, keyword_plan, route_corpora, rewrite_queries, plan_with_feedback, lexical_retrieval, inmemory_retrieval, keyword_retrieval, lexical_spans, masked_retrieval, retrieval_ablation)
QUERIES = {f.__name__: f for f in _ALL}

_SEARCH = f"{S.INDEX}, {S.QUESTIONS}"
_VECTORS = f"{S.vectors('cv', 'u', 'chunk_id', 'text')}, {S.vectors('qv', 'q', 'qid', 'question')}"
_FUSED = """f_s AS (SELECT qid, chunk_id, max(ra) AS a_rank, max(rb) AS b_rank FROM (SELECT qid, chunk_id, rank AS ra, NULL AS rb FROM d UNION ALL SELECT qid, chunk_id, NULL, rank FROM b) GROUP BY ALL),
    f_w AS (SELECT *, coalesce(1.0::DOUBLE / (60 + a_rank), 0) + coalesce(1.0::DOUBLE / (60 + b_rank), 0) AS score FROM f_s),
    f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, a_rank NULLS LAST, b_rank NULLS LAST) AS rank FROM f_w)"""


def _reranked(candidates: str, k: int) -> str:
    return f"""r_c AS (SELECT c.qid, c.chunk_id, c.rank AS before, list_distinct({S.ascii_tokens('question')}) AS qt, {S.ascii_tokens('text')} AS ct, lower(coalesce(text, '')) AS t, lower(trim(question)) AS p
        FROM {candidates} c JOIN u USING (chunk_id) JOIN q USING (qid)),
    r_s AS (SELECT qid, chunk_id, before, coalesce(len(list_intersect(qt, ct)) / nullif(len(qt), 0)::DOUBLE, 0) * 3 + CASE WHEN contains(t, p) THEN 2.0::DOUBLE ELSE 0 END + len(list_filter(ct[1:100], lambda x: list_contains(qt, x))) * 0.05::DOUBLE AS score FROM r_c),
    r AS (SELECT * FROM (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, before) AS rank FROM r_s) WHERE rank <= {k})"""


_OUT = "SELECT qid, chunk_id, round(score, 6) AS score, rank FROM"
ASKED = "a AS (SELECT question_id AS qid, any_value(question) AS question FROM per_question_comparison GROUP BY question_id)"
_NAME = r"[A-Z][\p{L}\p{N}_]*(?:\s+[A-Z][\p{L}\p{N}_]*)*"
_SPLIT = r"(?i)\b(?:and|also|as well as)\b"


def fact_key(x: str) -> str:
    return f"array_to_string(list_sort(list_distinct({S.ascii_tokens(x)})), ' ')"


FACTS = rf"""f_a AS (SELECT qid, trim(regexp_replace(trim(question), '\?+$', '')) AS q FROM a WHERE trim(question) <> ''),
    f_b AS (SELECT qid, q, regexp_matches(q, '{_SPLIT}') AS two, regexp_replace(q, '{_SPLIT}', chr(1)) AS m FROM f_a),
    f_c AS (SELECT qid, q, two, trim(string_split(m, chr(1))[1]) AS x, trim(string_split(m, chr(1))[2]) AS y FROM f_b),
    f_d AS (SELECT *, list_filter(regexp_extract_all(x, '{_NAME}'), lambda n: n NOT IN {S.words_in("Who What When Where Why How Which Did Does Is Are Was Were".split())})[-1] AS s FROM f_c),
    f_e AS (SELECT qid, unnest([0, 1]) AS i, unnest(CASE WHEN two THEN [x, CASE WHEN s IS NOT NULL AND NOT contains(lower(y), lower(s)) THEN y || ' about ' || s ELSE y END] ELSE [q, ''] END) AS description FROM f_d),
    f_f AS (SELECT *, row_number() OVER (PARTITION BY qid, {fact_key('description')} ORDER BY i) AS n FROM f_e WHERE description <> ''),
    facts AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) AS fact_no, description FROM f_f WHERE n = 1)"""
_KEYWORDS = rf"""k_a AS (SELECT qid, list_filter(list_transform(string_split(regexp_replace(question, '(?i)\band\b|[,;]', chr(1), 'g'), chr(1)), lambda p: regexp_replace(p, '^[ ?.]+|[ ?.]+$', '', 'g')), lambda p: p <> '') AS l FROM a WHERE question IS NOT NULL),
    k_b AS (SELECT qid, unnest(range(0, len(l))) AS i, unnest(l) AS description FROM k_a),
    k_c AS (SELECT *, row_number() OVER (PARTITION BY qid, array_to_string({S.ascii_tokens('description')}, ' ') ORDER BY i) AS n FROM k_b),
    facts AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY i) AS fact_no, description FROM k_c WHERE n = 1)"""


def routed(out: str, facts: str, keys: str, text: str, most: int | None = None) -> str:
    on = " AND ".join(f"h.{k} = x.{k}" for k in keys.split(", "))
    rest = "(SELECT min(id) AS id FROM corpora)" if most else "corpora"
    return f"""{out}_q AS (SELECT {keys}, list_distinct({S.ascii_tokens('description')}) AS l FROM {facts}),
    {out}_t AS (SELECT id, unnest(list_distinct({S.ascii_tokens(text)})) AS t FROM corpora),
    {out}_h AS (SELECT {keys}, id AS corpus_id, count(*) / n::DOUBLE AS score FROM (SELECT {keys}, len(l) AS n, unnest(l) AS t FROM {out}_q) JOIN {out}_t USING (t) GROUP BY {keys}, id, n),
    {out}_m AS (SELECT {', '.join('x.' + k for k in keys.split(', '))}, c.id AS corpus_id, 0.0::DOUBLE AS score FROM {facts} x, {rest} c WHERE NOT EXISTS (SELECT 1 FROM {out}_h h WHERE {on})),
    {out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY round(score, 9) DESC, corpus_id) AS place FROM (SELECT * FROM {out}_h UNION ALL SELECT * FROM {out}_m)) {f'WHERE place <= {most}' if most else ''})"""


def _lexical(stemmed: bool, ratio: bool, phrase: bool, k: int) -> str:
    cut = (lambda x: f"list_distinct(list_transform({S.ascii_tokens(x)}, lambda t: {S.stem('t')}))") if stemmed else (lambda x: f"list_distinct({S.ascii_tokens(x)})")
    base = "overlap / n::DOUBLE" if ratio else "overlap::DOUBLE"
    bonus = " + CASE WHEN contains(lower(text), lower(trim(query))) THEN 2.0::DOUBLE ELSE 0 END" if phrase else ""
    return f"""WITH {S.QUESTIONS}, f AS (SELECT qid, question AS description FROM q), {routed('g', 'f', 'qid', "concat_ws(' ', id, description)")},
    l_q AS (SELECT qid, question AS query, {cut('question')} AS l FROM q),
    l_d AS (SELECT doc_id, corpus_id, unnest({cut('text')}) AS t FROM documents),
    l_o AS (SELECT qid, doc_id, corpus_id, query, n, count(*) AS overlap FROM (SELECT qid, query, len(l) AS n, unnest(l) AS t FROM l_q) JOIN l_d USING (t) GROUP BY ALL),
    l_s AS (SELECT o.qid, o.corpus_id, o.doc_id, {base}{bonus} AS score FROM l_o o JOIN g USING (qid, corpus_id) JOIN documents d ON d.doc_id = o.doc_id)
    SELECT qid, corpus_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, corpus_id, doc_id) AS rank FROM l_s) WHERE rank <= {k}"""


_RELEVANT = """SELECT '{mode}' AS mode, count(*) AS queries, round(coalesce(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 0), 4) AS recall_5, round(coalesce(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 0), 4) AS recall_10,
    round(coalesce(avg(coalesce(1.0::DOUBLE / first, 0)), 0), 4) AS mrr FROM (SELECT q.qid, min(x.rank) AS first FROM q LEFT JOIN {rows} x ON x.qid = q.qid AND x.chunk_id = q.qid GROUP BY q.qid)"""

SQL = {
    "bm25_search": f"WITH {_SEARCH}, {S.bm25('b', 'q', 20)} {_OUT} b",
    "dense_search": f"WITH {S.CHUNKS}, {S.QUESTIONS}, {_VECTORS}, {S.dense('d', 20)} {_OUT} d",
    "rrf_fusion": f"WITH {_SEARCH}, {_VECTORS}, {S.dense('d', 20)}, {S.bm25('b', 'q', 20)}, {_FUSED} {_OUT} f",
    "hybrid_search": f"WITH {_SEARCH}, {_VECTORS}, {S.dense('d', 20)}, {S.bm25('b', 'q', 20)}, {_FUSED}, c15 AS (SELECT * FROM f WHERE rank <= 15), {_reranked('c15', 6)} {_OUT} r",
    "rerank": f"WITH {_SEARCH}, {S.bm25('b', 'q', 15)}, {_reranked('b', 6)} {_OUT} r",
    "vector_knn": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS qid, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id)
        SELECT qid, vec_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "plan_facts": f"WITH {ASKED}, {FACTS} SELECT qid, fact_no, description FROM facts",
    "keyword_plan": f"WITH {ASKED}, {_KEYWORDS}, {routed('g', 'facts', 'qid, fact_no', 'description', 2)} SELECT g.qid, g.fact_no, description, corpus_id, place, round(score, 6) AS score FROM g JOIN facts USING (qid, fact_no)",
    "route_corpora": "WITH " + ASKED + ", " + FACTS + ", " + routed("g", "facts", "qid, fact_no", "concat_ws(' ', id, description)") + " SELECT qid, fact_no, corpus_id, place, round(score, 6) AS score FROM g",
    "rewrite_queries": "WITH " + ASKED + ", " + FACTS + ", " + routed("g", "facts", "qid, fact_no", "concat_ws(' ', id, description)") + " SELECT qid, 'q' || fact_no AS query_id, description AS query, string_agg(corpus_id, ',' ORDER BY corpus_id) AS corpora FROM g JOIN facts USING (qid, fact_no) GROUP BY qid, fact_no, description",
    "plan_with_feedback": rf"""WITH {ASKED}, {FACTS}, l AS (SELECT question_id AS qid, any_value(question) AS question, any_value(e1_status) AS e1_status FROM per_question_comparison GROUP BY question_id),
        m AS (SELECT qid, array_to_string({S.first_seen("t")}, ' ') AS description FROM (SELECT qid, list_filter(regexp_extract_all(regexp_replace(lower(question), '''s', '', 'g'), '[a-z0-9]+'), lambda t: t NOT IN {S.words_in("what who when where why how does did is are was were the a an and or of to for in on by with".split())}) AS t FROM l WHERE coalesce(e1_status, '') <> 'answered'))
        SELECT qid, fact_no, description FROM facts UNION ALL SELECT qid, 99, description FROM m WHERE description <> '' AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.qid = m.qid AND {fact_key('f.description')} = {fact_key('m.description')})""",
    "lexical_retrieval": _lexical(True, False, True, 5),
    "inmemory_retrieval": _lexical(False, False, True, 5),
    "keyword_retrieval": _lexical(False, True, False, 3),
    "masked_retrieval": "WITH " + S.INDEX.replace(S.CHUNKS, S.CHUNKS.replace("u AS", "u_all AS") + ", u AS (SELECT * FROM u_all WHERE document_id IS DISTINCT FROM (SELECT document_id FROM u_all GROUP BY document_id ORDER BY count(*) DESC, document_id LIMIT 1))") + f", {S.QUESTIONS}, {S.bm25('b', 'q', 10)} {_OUT} b",
    "retrieval_ablation": f"WITH {S.INDEX}, q AS (SELECT chunk_id AS qid, coalesce({S.sentences('text')}[1], '') AS question FROM u WHERE substr(md5(chunk_id), 1, 1) = '0'), {_VECTORS}, {S.dense('d', 20)}, {S.bm25('b', 'q', 20)}, {_FUSED}, c15 AS (SELECT * FROM f WHERE rank <= 15), {_reranked('c15', 10)} "
    + " UNION ALL ".join(_RELEVANT.format(mode=m, rows=r) for m, r in (("dense", "d"), ("terms", "b"), ("fused", "f"), ("reranked", "r"))),
}
