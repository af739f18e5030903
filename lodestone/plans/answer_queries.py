"""Queries that judge by fact, guard and verify answers, and write queries for what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answering, judging, planning, retrieval, structured
from lodestone.plans import sql as S
from lodestone.plans.evidence_queries import _ASSESSED, _BASE, _CLAIMS, _CONFLICTS, _FEEDBACK, _HELD, _SNIPPETS, _SUPPORT, LOG, _evidence, _facts, _meaningful, _over_hybrid, _ranked, claims, log, snippets
from lodestone.plans.retrieval_queries import _NAME, _SEARCH, _VECTORS, FACTS, questions, routed
from lodestone.plans.text_queries import chunks
from lodestone.tables import table


def _contested(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the log's questions, supported by what names their subject, with the numbers of the evidence that the fact does not name as
    values that exclude each other."""
    numbers = lambda c: F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(r"\d+"), F.lit(0))
    terms = snippets(spark, folder).select("qid", F.explode(numbers("text")).alias("term")).groupBy("qid").agg(F.collect_set("term").alias("terms"))
    rows = _facts(spark, folder).join(terms, "qid", "left")
    named = planning.names(F.col("description"))
    wanted = F.when(F.size(named) > 0, F.array_distinct(T.ascii_tokens(F.array_join(named, " ")))).otherwise(T.meaningful(F.col("description")))
    return rows.select("qid", "fact_no", "description", wanted.alias("terms"), F.array_except(F.coalesce("terms", F.array().cast("array<string>")), numbers("description")).alias("conflict_terms"))


def fact_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers on which the snippets that support a fact differ."""
    return judging.fact_conflicts(_contested(spark, folder), snippets(spark, folder))


def _fact_judged(spark: SparkSession, folder: str) -> DataFrame:
    return judging.assess(_contested(spark, folder), snippets(spark, folder), claims(spark, folder), by_fact=True)


def fact_judge(spark: SparkSession, folder: str) -> DataFrame:
    """The sufficiency judgement with conflicts by fact."""
    return _fact_judged(spark, folder).withColumn("score", F.round("score", 6))


def guarded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """The last system's answers as far as the judgement and the citations allow them."""
    made = claims(spark, folder).groupBy("qid").agg(answering.in_order("claim_no", "sids").alias("claims"))
    none = F.array().cast("array<struct<claim_no:bigint,sids:array<string>>>")
    drafts = log(spark, folder).select("qid", F.coalesce("e1_answer", F.lit("")).alias("answer"), F.coalesce("e1_status", F.lit("unanswerable")).alias("answer_status")).join(made, "qid", "left").withColumn("claims", F.coalesce("claims", none))
    judged = _fact_judged(spark, folder).select("qid", "label", (F.col("facts") - F.col("covered")).alias("missing"))
    out = answering.guarded(drafts.join(judged, "qid"), snippets(spark, folder))
    cited = F.transform("claims", lambda c: F.concat(c["claim_no"].cast("string"), F.lit(":"), F.array_join(F.array_sort(c["sids"]), ",")))
    return out.select("qid", "status", "answer", F.array_join(cited, ";").alias("citations"), "dropped")


def verified_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Of every answer: are all its claims supported by what they cite? Abstentions and answers without claims have nothing to support."""
    held = judging.claim_support(claims(spark, folder), snippets(spark, folder))
    rows = held.groupBy("qid").agg(F.count("*").alias("claims"), F.count_if(F.col("support") >= judging.SUPPORT).alias("supported"), F.avg("support").alias("mean"))
    abstained = F.coalesce("e1_status", F.lit("unanswerable")) == "unanswerable"
    rows = log(spark, folder).select("qid", abstained.alias("abstained")).join(rows, "qid", "left")
    nothing = F.col("abstained") | F.col("claims").isNull()
    zero = F.lit(0).cast("long")
    every = nothing | (F.col("supported") == F.col("claims"))
    return rows.select(
        "qid", F.when(nothing, zero).otherwise(F.col("claims")).alias("claims"), F.when(nothing, zero).otherwise(F.col("supported")).alias("supported"), every.alias("all_supported"),
        F.round(F.when(nothing, 1.0).otherwise(F.col("mean")), 6).alias("mean_support"), F.when(every & ~nothing, "TRUSTED").otherwise("ABSTAIN").alias("decision"),
    )


def evaluated(facts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The judgement of each question's evidence, and its facts that are not held: facts go to those of the question's own documents that share a
    token with them, or to all.

    ``facts``: qid, fact_no, description. ``rows``: qid, chunk_id, document_id, text. Every chunk is a claim that cites itself.
    """
    found = rows.select("qid", F.col("chunk_id").alias("sid"), "text", F.coalesce("document_id", F.lit("")).alias("corpus_id"))
    own = found.groupBy("qid").agg(F.collect_set("corpus_id").alias("documents"))
    described = lambda d: T.ascii_tokens(F.concat_ws(" ", d, F.lit("Document"), d))
    hit = F.filter("documents", lambda d: F.arrays_overlap(T.ascii_tokens(F.col("description")), described(d)))
    facts = facts.join(own, "qid", "left").withColumn("hit", hit).select("qid", "fact_no", "description", F.when(F.size("hit") > 0, F.col("hit")).otherwise(F.col("documents")).alias("corpora"))
    judged = judging.assess(facts, found, found.select("qid", F.lit(1).cast("long").alias("claim_no"), F.array("sid").alias("sids")), by_fact=True)
    missing = facts.join(judging.support(facts, found).select("qid", "fact_no").distinct(), ["qid", "fact_no"], "left_anti")
    return judged, missing.select("qid", "fact_no", "description")


def context_evaluator(spark: SparkSession, folder: str) -> DataFrame:
    """Do the six chunks of hybrid search hold what the planner asks for?"""
    judged, _ = evaluated(planning.plan_facts(questions(spark, folder)), _evidence(spark, folder, search=retrieval.hybrid))
    return judged.select("qid", "facts", "covered", F.round("score", 6).alias("score"), "label", (F.col("label") == "sufficient").alias("sufficient"))


def _named_evidence(spark: SparkSession, folder: str) -> DataFrame:
    named = table(spark, folder, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", "document_name", "page")
    return _evidence(spark, folder, search=retrieval.hybrid).join(named, "chunk_id")


def citation_labels(spark: SparkSession, folder: str) -> DataFrame:
    """How each of the six chunks of hybrid search is cited."""
    return _named_evidence(spark, folder).select("qid", "rank", answering.citation_label(F.col("document_name"), F.col("page"), F.col("chunk_id")).alias("label"))


def evidence_with_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The evidence of each question as one text, with names and pages."""
    return answering.paged_context(_named_evidence(spark, folder)).select("qid", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("characters"))


def first_wins_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits of dense and then of term search, each id and each text of a document once."""
    q, c = questions(spark, folder), chunks(spark, folder)
    named = table(spark, folder, "chunks").dropDuplicates(["chunk_id"]).select("chunk_id", F.lower("document_name").alias("corpus_id"), "document_id", "text")
    hits = retrieval.dense(q, c).select("qid", "chunk_id", F.col("rank").alias("place")).unionByName(retrieval.bm25(q, c).select("qid", "chunk_id", (F.col("rank") + 1_000).alias("place")))
    return answering.first_wins(hits.join(named, "chunk_id").withColumnRenamed("chunk_id", "sid")).select("qid", "place", F.col("sid").alias("chunk_id"))


def _asked_again(spark: SparkSession, folder: str) -> DataFrame:
    """qid, i (from 1), fact_no, query, corpora: what is asked for each fact without support, in the order of facts."""
    from pyspark.sql.window import Window

    missing = judging.feedback(_facts(spark, folder), judging.support(_facts(spark, folder), snippets(spark, folder)))
    corpora = planning.routes(_facts(spark, folder), table(spark, folder, "corpora")).groupBy("qid", "fact_no").agg(F.array_join(F.array_sort(F.collect_list("corpus_id")), ",").alias("corpora"))
    order = Window.partitionBy("qid").orderBy("fact_no")
    return missing.join(corpora, ["qid", "fact_no"]).withColumn("i", F.row_number().over(order))


def recovery_queries(spark: SparkSession, folder: str, iteration: int = 1) -> DataFrame:
    """The queries of a recovery pass: one for each fact without support; none where nothing is missing."""
    name = F.concat(F.lit(f"recovery-{iteration}-"), F.col("i").cast("string"))
    return _asked_again(spark, folder).select("qid", name.alias("query_id"), "fact_no", "query", "corpora")


def template_queries(spark: SparkSession, folder: str) -> DataFrame:
    """What two other rewriters ask: for what is missing, where anything is, else for each fact."""
    from pyspark.sql.window import Window

    again = _asked_again(spark, folder).select("qid", "i", "fact_no", "query")
    order = Window.partitionBy("qid").orderBy("fact_no")
    first = _facts(spark, folder).join(again.select("qid").distinct(), "qid", "left_anti").select("qid", F.row_number().over(order).alias("i"), "fact_no", F.col("description").alias("query"))
    text = lambda prefix, i: F.concat(F.lit(prefix), i.cast("string"))
    out = None
    for rows, template, aware in ((again, "feedback-", "q1-"), (first, "q", "q0-")):
        two = F.explode(F.array(F.struct(F.lit("template").alias("rewriter"), text(template, F.col("i")).alias("query_id")), F.struct(F.lit("feedback_aware").alias("rewriter"), text(aware, F.col("i") - 1).alias("query_id")))).alias("x")
        made = rows.select("qid", two, "fact_no", "query").select("qid", "x.rewriter", "x.query_id", "fact_no", "query")
        out = made if out is None else out.unionByName(made)
    return out


def strict_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Properties of events read strictly: how many records are what they should be, and what the others fail, by type."""
    rows = table(spark, folder, "events").select("event_type", structured.strict(F.col("props"), {"k": "number"}).alias("error"))
    return rows.groupBy("event_type", "error").agg(F.count("*").alias("events"))


def json_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Packed answers that are JSON lists of strings, with the number of strings; what the others are."""
    rows = table(spark, folder, "popqa_raw_sample").dropDuplicates(["line_no"])
    return rows.select("line_no", structured.kind(F.col("possible_answers")).alias("kind"))


_ALL = (fact_conflicts, fact_judge, guarded_answers, verified_answers, context_evaluator, citation_labels, evidence_with_pages, first_wins_hits, recovery_queries, template_queries, strict_properties, json_answers)
QUERIES = {f.__name__: f for f in _ALL}

_BY_FACT = r"""x_t AS (SELECT DISTINCT qid, unnest(regexp_extract_all(text, '\d+')) AS term FROM s),
    x_f AS (SELECT f.qid, f.fact_no, x_t.term FROM facts f JOIN x_t USING (qid) WHERE NOT list_contains(regexp_extract_all(f.description, '\d+'), x_t.term)),
    x_g AS (SELECT x_f.qid, x_f.fact_no, x_f.term, string_agg(DISTINCT s.sid, ',' ORDER BY s.sid) AS sids FROM x_f JOIN h USING (qid, fact_no) JOIN s ON s.qid = h.qid AND s.sid = h.sid WHERE contains(lower(s.text), x_f.term) GROUP BY ALL),
    x_h AS (SELECT * FROM x_g WHERE (qid, fact_no) IN (SELECT (qid, fact_no) FROM x_g GROUP BY qid, fact_no HAVING count(*) > 1)),
    x AS (SELECT DISTINCT qid, fact_no FROM x_h)"""
_NAMES = f"list_filter(regexp_extract_all(f.description, '{_NAME}'), lambda n: n NOT IN {S.words_in(T.QUESTION_WORDS)})"
_HELD_BY_NAME = f"""h_a AS (SELECT f.qid, f.fact_no, CASE WHEN len({_NAMES}) > 0 THEN {S.ascii_tokens(f"array_to_string({_NAMES}, ' ')")} ELSE {_meaningful('f.description')} END AS terms FROM facts f),
    h AS (SELECT h_a.qid, h_a.fact_no, s.sid FROM h_a JOIN s USING (qid) WHERE len(list_filter(terms, lambda t: NOT contains(lower(s.text), t))) = 0)"""
_FACT_JUDGED = _ASSESSED.replace(_HELD, _HELD_BY_NAME).replace(_CONFLICTS, _BY_FACT)
_ROUTED = routed("g", "facts", "qid, fact_no", "concat_ws(' ', id, description)")
_AGAIN = f"{_BASE}, {_HELD}, {_FEEDBACK}, {_ROUTED}, ag AS (SELECT w.qid, w.fact_no, w.query, row_number() OVER (PARTITION BY w.qid ORDER BY w.fact_no) AS i, (SELECT string_agg(corpus_id, ',' ORDER BY corpus_id) FROM g WHERE g.qid = w.qid AND g.fact_no = w.fact_no) AS corpora FROM w)"
_NAMED = "cn AS (SELECT chunk_id, any_value(document_name) AS document_name, any_value(page) AS page, any_value(document_id) AS document_id, any_value(text) AS text FROM chunks GROUP BY chunk_id)"
_PAGE = "CASE WHEN page IS NOT NULL THEN 'Page ' || page END"
_QUESTION_FACTS = FACTS.replace("FROM a WHERE", "FROM q WHERE")


def _evaluated(rows: str, out: str) -> str:
    """CTEs from the evidence ``rows`` (qid, document_id, text) to the facts held, ``out``_h, and the judgement of each question, ``out``."""
    return f"""{out}_d AS (SELECT DISTINCT qid, coalesce(document_id, '') AS d FROM {rows}),
        {out}_r AS (SELECT facts.qid, fact_no, d, len(list_intersect({S.ascii_tokens('description')}, {S.ascii_tokens("d || ' Document ' || d")})) > 0 AS hit FROM facts JOIN {out}_d USING (qid)),
        {out}_o AS (SELECT qid, fact_no, d FROM (SELECT *, max(hit::INT) OVER (PARTITION BY qid, fact_no) AS hits FROM {out}_r) WHERE hit OR hits = 0),
        {out}_h AS (SELECT DISTINCT facts.qid, facts.fact_no FROM facts JOIN {out}_o o USING (qid, fact_no) JOIN {rows} x ON x.qid = facts.qid AND coalesce(x.document_id, '') = o.d WHERE len(list_filter({_meaningful('facts.description')}, lambda t: NOT contains(lower(coalesce(x.text, '')), t))) = 0),
        {out}_c AS (SELECT facts.qid, count(*) AS facts, count(h.fact_no) AS covered, (SELECT count(*) FROM {rows} x WHERE x.qid = facts.qid) AS n FROM facts LEFT JOIN {out}_h h USING (qid, fact_no) GROUP BY facts.qid),
        {out} AS (SELECT *, CASE WHEN covered = facts THEN 'sufficient' WHEN n = 0 THEN 'unanswerable' WHEN covered > 0 THEN 'useful_but_incomplete' ELSE 'insufficient' END AS label FROM {out}_c)"""


SQL = {
    "fact_conflicts": f"WITH {_BASE}, {_HELD_BY_NAME}, {_BY_FACT} SELECT qid, fact_no, term, sids FROM x_h",
    "fact_judge": f"WITH {_FACT_JUDGED} SELECT qid, facts, covered, conflicts, unsupported, round(score, 6) AS score, label FROM j",
    "guarded_answers": f"""WITH {_FACT_JUDGED}, k AS (SELECT c.qid, c.claim_no, string_agg(DISTINCT s.sid, ',' ORDER BY s.sid) AS sids FROM c JOIN s ON s.qid = c.qid AND list_contains(c.sids, s.sid) GROUP BY ALL),
        ka AS (SELECT j.qid, j.label, j.facts - j.covered AS missing, coalesce(l.e1_answer, '') AS answer, coalesce(l.e1_status, 'unanswerable') AS answer_status, j.label IN ('sufficient', 'useful_but_incomplete', 'conflicting') AS says,
            (SELECT count(*) FROM c WHERE c.qid = j.qid) AS given, (SELECT count(*) FROM k WHERE k.qid = j.qid) AS kept, coalesce((SELECT string_agg(claim_no || ':' || sids, ';' ORDER BY claim_no) FROM k WHERE k.qid = j.qid), '') AS citations FROM j JOIN l ON l.question_id = j.qid)
        SELECT qid, CASE WHEN says AND given > kept THEN 'partial' WHEN label = 'sufficient' THEN answer_status WHEN says THEN 'partial' ELSE 'unanswerable' END AS status,
            CASE WHEN label = 'sufficient' THEN answer WHEN label = 'conflicting' THEN '{answering.CONFLICTING}' WHEN says AND answer_status = 'partial' AND answer <> '' THEN answer WHEN says AND missing > 0 THEN '{answering.INCOMPLETE}' WHEN says THEN '{answering.INSUFFICIENT}' ELSE '{answering.NO_ANSWER}' END AS answer,
            CASE WHEN says THEN citations ELSE '' END AS citations, CASE WHEN says THEN given - kept ELSE 0 END AS dropped FROM ka""",
    "verified_answers": f"""WITH {LOG}, {_SNIPPETS}, {_CLAIMS}, {_SUPPORT}, k AS (SELECT question_id AS qid, coalesce(e1_status, 'unanswerable') = 'unanswerable' OR claims IS NULL AS nothing, claims, supported, mean_support FROM l LEFT JOIN v ON v.qid = question_id)
        SELECT qid, CASE WHEN nothing THEN 0 ELSE claims END AS claims, CASE WHEN nothing THEN 0 ELSE supported END AS supported, nothing OR supported = claims AS all_supported, CASE WHEN nothing THEN 1.0::DOUBLE ELSE mean_support END AS mean_support,
            CASE WHEN NOT nothing AND supported = claims THEN 'TRUSTED' ELSE 'ABSTAIN' END AS decision FROM k""",
    "context_evaluator": f"""WITH {_over_hybrid(_ranked(6))}, {_QUESTION_FACTS}, {_evaluated('e', 'k')} SELECT qid, facts, covered, round(covered / facts::DOUBLE, 6) AS score, label, label = 'sufficient' AS sufficient FROM k""",
    "citation_labels": f"WITH {_over_hybrid(_ranked(6))}, {_NAMED} SELECT qid, rank, '[' || concat_ws(', ', document_name, {_PAGE}, 'Chunk ' || chunk_id) || ']' AS label FROM b JOIN cn USING (chunk_id)",
    "evidence_with_pages": f"""WITH {_over_hybrid(_ranked(6))}, {_NAMED}, k AS (SELECT qid, string_agg('[' || concat_ws(', ', document_name, {_PAGE}) || ']: ' || coalesce(cn.text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM b JOIN cn USING (chunk_id) GROUP BY qid)
        SELECT qid, md5(context) AS context_md5, length(context) AS characters FROM k""",
    "first_wins_hits": f"""WITH {_SEARCH}, {_VECTORS}, {S.dense('d', 20)}, {S.bm25('b', 'q', 20)}, {_NAMED}, a AS (SELECT qid, chunk_id, rank AS place FROM d UNION ALL SELECT qid, chunk_id, rank + 1000 FROM b),
        k AS (SELECT qid, place, chunk_id, row_number() OVER (PARTITION BY qid, lower(document_name), document_id, {S.squashed('lower(cn.text)')} ORDER BY place) AS n FROM a JOIN cn USING (chunk_id)) SELECT qid, place, chunk_id FROM k WHERE n = 1""",
    "recovery_queries": f"WITH {_AGAIN} SELECT qid, 'recovery-1-' || i AS query_id, fact_no, query, corpora FROM ag",
    "template_queries": f"""WITH {_AGAIN}, fi AS (SELECT qid, fact_no, description AS query, row_number() OVER (PARTITION BY qid ORDER BY fact_no) AS i FROM facts WHERE qid NOT IN (SELECT qid FROM ag))
        SELECT qid, 'template' AS rewriter, 'feedback-' || i AS query_id, fact_no, query FROM ag UNION ALL SELECT qid, 'feedback_aware', 'q1-' || (i - 1), fact_no, query FROM ag UNION ALL SELECT qid, 'template', 'q' || i, fact_no, query FROM fi UNION ALL SELECT qid, 'feedback_aware', 'q0-' || (i - 1), fact_no, query FROM fi""",
    "strict_properties": """SELECT event_type, CASE WHEN props IS NULL OR NOT json_valid(props) THEN 'not JSON' WHEN json_type(props) <> 'OBJECT' THEN 'not an object' WHEN json_type(props, '$.k') IS NULL THEN 'missing required field(s): k'
        WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'k must be a number' ELSE '' END AS error, count(*) AS events FROM events GROUP BY ALL""",
    "json_answers": """WITH p AS (SELECT line_no, any_value(possible_answers) AS t FROM popqa_raw_sample GROUP BY line_no)
        SELECT line_no, CASE WHEN t IS NULL THEN 'null' WHEN NOT json_valid(t) OR regexp_matches(t, ',\\s*[\\]}]\\s*$') THEN 'not JSON' ELSE CASE json_type(t) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind FROM p""",
}
