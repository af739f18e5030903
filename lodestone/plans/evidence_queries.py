"""Queries that judge evidence and draft answers."""

from __future__ import annotations

import re
from functools import partial, update_wrapper

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import answering, judging, planning, retrieval
from lodestone.plans import sql as S
from lodestone.plans.retrieval_queries import _FUSED, ASKED, FACTS, _reranked, asked, questions
from lodestone.plans.text_queries import chunks
from lodestone.session import materialise
from lodestone.tables import table


def log(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "per_question_comparison").dropDuplicates(["question_id"]).withColumnRenamed("question_id", "qid")


def snippets(spark: SparkSession, folder: str) -> DataFrame:
    """The answers of the three systems, as evidence for their question."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("sid"), F.col(f"{s}_answer").alias("text")) for s in ("b0", "b1", "e1")])).alias("x")
    return log(spark, folder).select("qid", each).select("qid", "x.sid", "x.text", F.col("x.sid").alias("corpus_id")).where("text is not null and trim(text) != ''")


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of the last system's answer, citing the second system where that answered, and a fourth that is not there."""
    cited = F.when(F.col("b1_status") == "answered", F.array(F.lit("b1"))).when(F.col("b1_status") == "partial", F.array(F.lit("b1"), F.lit("b9"))).otherwise(F.array().cast("array<string>"))
    rows = log(spark, folder).select("qid", cited.alias("sids"), F.posexplode(T.sentences(F.col("e1_answer"))).alias("i", "text"))
    return rows.select("qid", (F.col("i") + 1).cast("long").alias("claim_no"), "text", "sids")


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return planning.plan_facts(asked(spark, folder))


def fact_coverage(spark: SparkSession, folder: str) -> DataFrame:
    found = judging.support(_facts(spark, folder), snippets(spark, folder)).groupBy("qid", "fact_no").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("sids"))
    return _facts(spark, folder).join(found, ["qid", "fact_no"], "left").select("qid", "fact_no", F.coalesce("sids", F.lit("")).alias("sids"))


def missing_facts(spark: SparkSession, folder: str) -> DataFrame:
    found = judging.support(_facts(spark, folder), snippets(spark, folder))
    return _facts(spark, folder).join(found.select("qid", "fact_no").distinct(), ["qid", "fact_no"], "left_anti")


def _assessed(spark: SparkSession, folder: str) -> DataFrame:
    return judging.assess(_facts(spark, folder), snippets(spark, folder), claims(spark, folder))


def sufficiency_judge(spark: SparkSession, folder: str) -> DataFrame:
    return _assessed(spark, folder).withColumn("score", F.round("score", 6))


def evidence_judge(spark: SparkSession, folder: str) -> DataFrame:
    """Sufficient where every fact is covered and every claim supported."""
    rows = _assessed(spark, folder)
    return rows.select("qid", F.round(F.col("covered") / F.col("facts"), 6).alias("score"), F.when((F.col("covered") == F.col("facts")) & (F.col("unsupported") == 0), "sufficient").otherwise("insufficient").alias("status"))


def coverage_judge(spark: SparkSession, folder: str) -> DataFrame:
    """Judged by whether any snippet shares a token with each fact."""
    facts = _facts(spark, folder).select("qid", "fact_no", F.explode(T.meaningful(F.col("description"))).alias("t"))
    tokens = snippets(spark, folder).select("qid", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("t")).distinct()
    hit = facts.join(tokens, ["qid", "t"], "left_semi").select("qid", "fact_no").distinct().groupBy("qid").agg(F.count("*").alias("covered"))
    rows = _facts(spark, folder).groupBy("qid").agg(F.count("*").alias("facts")).join(hit, "qid", "left").na.fill(0, ["covered"])
    status = F.when(F.col("covered") == 0, "irrelevant").when(F.col("covered") < F.col("facts"), "insufficient").otherwise("sufficient")
    return rows.select("qid", "facts", "covered", status.alias("status"), F.when(F.col("covered") == 0, 0.2).when(F.col("covered") < F.col("facts"), 0.45).otherwise(0.85).alias("score"))


def conflict_detection(spark: SparkSession, folder: str) -> DataFrame:
    return judging.conflicts(snippets(spark, folder))


def unsupported_claims(spark: SparkSession, folder: str) -> DataFrame:
    return judging.unsupported(claims(spark, folder), snippets(spark, folder))


def guard_citations(spark: SparkSession, folder: str) -> DataFrame:
    return judging.known_citations(claims(spark, folder), snippets(spark, folder))


def feedback_queries(spark: SparkSession, folder: str) -> DataFrame:
    return judging.feedback(_facts(spark, folder), judging.support(_facts(spark, folder), snippets(spark, folder)))


def feedback_fact_match(spark: SparkSession, folder: str) -> DataFrame:
    return judging.closest_fact(feedback_queries(spark, folder).select("qid", "query").distinct(), _facts(spark, folder))


def reformulate_query(spark: SparkSession, folder: str) -> DataFrame:
    """The question and what is missing, as one short query."""
    missing = missing_facts(spark, folder).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "description"))), lambda x: x["description"]), " ").alias("missing"))
    return asked(spark, folder).join(missing, "qid", "left").select("qid", planning.reformulated(F.col("question"), F.col("missing")).alias("query"))


def verify_claims(spark: SparkSession, folder: str) -> DataFrame:
    """Of each answer: its claims, how many the cited text supports, their mean support, and whether to trust it."""
    held = judging.claim_support(claims(spark, folder), snippets(spark, folder))
    rows = held.groupBy("qid").agg(F.count("*").alias("claims"), F.count_if(F.col("support") >= judging.SUPPORT).alias("supported"), F.round(F.avg("support"), 6).alias("mean_support"))
    return rows.withColumn("decision", F.when(F.col("supported") == F.col("claims"), "TRUSTED").otherwise("ABSTAIN"))


def final_decision(spark: SparkSession, folder: str) -> DataFrame:
    judged = _assessed(spark, folder).select("qid", judging.answer_status(F.col("label")).alias("status"))
    trusted = verify_claims(spark, folder).select("qid", "decision")
    answered = (F.col("status") == "answered") & (F.coalesce("decision", F.lit("ABSTAIN")) == "TRUSTED")
    return judged.join(trusted, "qid", "left").select("qid", "status", F.when(answered, "ANSWERED").otherwise("ABSTAINED").alias("decision"))


def abstention_policy(spark: SparkSession, folder: str) -> DataFrame:
    """What is said: the answer, the answer with a warning, or that there is none."""
    rows = _assessed(spark, folder).select("qid", judging.answer_status(F.col("label")).alias("status"), "label").join(log(spark, folder).select("qid", "e1_answer"), "qid")
    warning = F.when(F.col("label") == "conflicting", "The sources disagree: ").otherwise("Only part of this is supported: ")
    said = F.when(F.col("status") == "answered", F.col("e1_answer")).when(F.col("status") == "partial", F.concat(warning, F.coalesce("e1_answer", F.lit("")))).otherwise("The sources do not support an answer.")
    return rows.select("qid", "status", said.alias("answer"))


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """Everything that led to a decision, as one record a question."""
    plan = _facts(spark, folder).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "description"))), lambda x: x["description"]), " | ").alias("plan"))
    digests = snippets(spark, folder).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list(F.concat("sid", F.lit(":"), F.sha2(T.normalised(F.col("text")), 256)))), ",").alias("digests"))
    return _assessed(spark, folder).select("qid", "label").join(plan, "qid").join(digests, "qid", "left").select("qid", "plan", F.coalesce("digests", F.lit("")).alias("digests"), "label")


def _evidence(spark: SparkSession, folder: str, k: int = 6, search=retrieval.bm25) -> DataFrame:
    q, c = questions(spark, folder), chunks(spark, folder)
    return answering.evidence(search(q, c, k=k), c, q)


def evidence_context(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    return answering.context(_evidence(spark, folder, search=search)).select("qid", F.md5("context").alias("context_md5"), F.length("context").cast("long").alias("characters"))


def best_sentence(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    return answering.best_sentences(_evidence(spark, folder, search=search)).select("qid", "rank", "sentence", "overlap")


def grounded_answers(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    return answering.grounded(_evidence(spark, folder, search=search))


def draft_claims(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    return answering.claims(_evidence(spark, folder, search=search))


def extractive_answer(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    """The claims of a question with their sources, one a line."""
    rows = answering.claims(_evidence(spark, folder, 3, search)).select("qid", "claim_no", F.concat("claim", F.lit(" ["), "chunk_id", F.lit("]")).alias("line"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(answering.in_order("claim_no", "line"), lambda x: x["line"]), "\n").alias("answer"))


def synthesize_answer(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    """The best sentences of a question's snippets that share a term with it, each once, in order."""
    rows = answering.best_sentences(_evidence(spark, folder, search=search)).where("overlap > 0").groupBy("qid", "sentence").agg(F.min("rank").alias("rank"))
    return rows.groupBy("qid").agg(F.array_join(F.transform(answering.in_order("rank", "sentence"), lambda x: x["sentence"]), " ").alias("answer"), F.count("*").alias("sentences"))


def _context_facts(spark: SparkSession, folder: str, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the retrieval questions (a term of six letters or more each), and which the evidence holds."""
    q = questions(spark, folder)
    terms = F.filter(T.meaningful(F.col("question")), lambda t: F.length(t) > 5)
    facts = q.select("qid", F.posexplode(terms).alias("i", "description")).select("qid", (F.col("i") + 1).cast("long").alias("fact_no"), "description", F.array("description").alias("terms"))
    found = judging.support(facts, rows.select("qid", F.col("chunk_id").alias("sid"), "text", F.col("document_id").alias("corpus_id")))
    return facts, found


def context_sufficiency(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    """Of each retrieval question: its facts, how many the best chunks hold, and whether that suffices."""
    facts, found = _context_facts(spark, folder, _evidence(spark, folder, search=search))
    held = found.select("qid", "fact_no").distinct().groupBy("qid").agg(F.count("*").alias("covered"))
    rows = facts.groupBy("qid").agg(F.count("*").alias("facts")).join(held, "qid", "left").na.fill(0, ["covered"])
    return rows.select("qid", "facts", "covered", F.round(F.col("covered") / F.col("facts"), 6).alias("score"), (F.col("covered") == F.col("facts")).alias("sufficient"))


def _recovered(spark: SparkSession, folder: str, k: int = 6, search=retrieval.bm25) -> DataFrame:
    """One more pass for the questions that are not covered, with what they miss."""
    q, c = questions(spark, folder), chunks(spark, folder)
    first = materialise(search(q, c, k=k), "first")
    facts, found = _context_facts(spark, folder, answering.evidence(first, c, q))
    missing = facts.join(found.select("qid", "fact_no").distinct(), ["qid", "fact_no"], "left_anti")
    missing = missing.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "description"))), lambda x: x["description"]), " ").alias("missing"))
    again = q.join(missing, "qid").select("qid", planning.reformulated(F.col("question"), F.col("missing")).alias("question"))
    return answering.merged(first, search(again, c, k=k))


def adaptive_recovery(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    return _recovered(spark, folder, search=search)


def recovery_merge(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    """How many chunks each pass brought to a question."""
    return _recovered(spark, folder, search=search).groupBy("qid").agg(F.count_if(F.col("pass") == 1).alias("first_pass"), F.count_if(F.col("pass") == 2).alias("second_pass"))


def iterative_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """What each question holds after recovery, within a budget of eight chunks in the order they came."""
    return _recovered(spark, folder).where("place <= 8").select("qid", "place", "chunk_id")


def baseline_b0(spark: SparkSession, folder: str, search=retrieval.bm25) -> DataFrame:
    """The plain system: the best chunk as it is, whatever the question."""
    return _evidence(spark, folder, 1, search).select("qid", "chunk_id", F.md5(F.coalesce("text", F.lit(""))).alias("answer_md5"))


def _answered(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Grounded answers of the questions whose evidence suffices; the others abstain."""
    said = answering.grounded(rows.join(judged.where("sufficient").select("qid"), "qid", "left_semi")).select("qid", "answer", "confidence")
    return judged.select("qid").join(said, "qid", "left").select("qid", F.when(F.col("answer").isNotNull(), "answered").otherwise("abstained").alias("status"), F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def _judged(facts: DataFrame, found: DataFrame, share: float = 0.5) -> DataFrame:
    """qid, sufficient: whether the evidence holds at least ``share`` of a question's facts."""
    held = found.select("qid", "fact_no").distinct().groupBy("qid").agg(F.count("*").alias("covered"))
    rows = facts.groupBy("qid").agg(F.count("*").alias("facts")).join(held, "qid", "left")
    return rows.select("qid", (F.coalesce("covered", F.lit(0)) >= share * F.col("facts")).alias("sufficient"))


def baseline_b1(spark: SparkSession, folder: str) -> DataFrame:
    """The judging system: answers where the best chunks hold half of the question's facts."""
    rows = materialise(_evidence(spark, folder), "evidence")
    return _answered(_judged(*_context_facts(spark, folder, rows)), rows)


def baseline_e1(spark: SparkSession, folder: str) -> DataFrame:
    """The recovering system: judged again after one more pass."""
    merged = _recovered(spark, folder).select("qid", "chunk_id", F.col("place").alias("rank"))
    rows = materialise(answering.evidence(merged, chunks(spark, folder), questions(spark, folder)), "evidence")
    return _answered(_judged(*_context_facts(spark, folder, rows)), rows)


def _assessed_context(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """qid, sufficient: whether the evidence holds all of a question's facts and no two numbers of it differ."""
    facts, _ = _context_facts(spark, folder, rows)
    snippets = rows.select("qid", F.col("chunk_id").alias("sid"), "text", F.col("document_id").alias("corpus_id"))
    cited = snippets.select("qid", F.lit(1).alias("claim_no"), F.array("sid").alias("sids"))  # each chunk is a claim that cites itself
    return judging.assess(facts, snippets, cited).select("qid", (F.col("label") == "sufficient").alias("sufficient"))


def hybrid_baseline_b1(spark: SparkSession, folder: str) -> DataFrame:
    """The judging system over dense and term search, fused and reranked: answers where all facts are held without conflict."""
    rows = materialise(_evidence(spark, folder, search=retrieval.hybrid), "evidence")
    return _answered(_assessed_context(spark, folder, rows), rows)


def hybrid_baseline_e1(spark: SparkSession, folder: str) -> DataFrame:
    """The recovering system, with hybrid search in both passes, judged as ``hybrid_baseline_b1``."""
    merged = _recovered(spark, folder, search=retrieval.hybrid).select("qid", "chunk_id", F.col("place").alias("rank"))
    rows = materialise(answering.evidence(merged, chunks(spark, folder), questions(spark, folder)), "evidence")
    return _answered(_assessed_context(spark, folder, rows), rows)


def hybrid_iterative_retrieval(spark: SparkSession, folder: str, passes: int = 3, budget: int = 100) -> DataFrame:
    """What each question holds after up to ``passes`` of hybrid search, each for what is still missing, in the order it came."""
    q, c = questions(spark, folder), chunks(spark, folder)
    hits = lambda asked, n: retrieval.hybrid(asked, c, k=6).select("qid", "chunk_id", F.lit(n).cast("long").alias("pass"), "rank")
    held = materialise(hits(q, 1), "held")
    for n in range(2, passes + 1):
        facts, found = _context_facts(spark, folder, answering.evidence(held, c, q))
        missing = facts.join(found.select("qid", "fact_no").distinct(), ["qid", "fact_no"], "left_anti")
        missing = missing.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_no", "description"))), lambda x: x["description"]), " ").alias("missing"))
        again = materialise(q.join(missing, "qid").select("qid", planning.reformulated(F.col("question"), F.col("missing")).alias("question")), "again")
        if again.isEmpty():
            break
        more = hits(again, n).join(held.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        held = materialise(held.unionByName(more), "held")
    order = Window.partitionBy("qid").orderBy("pass", "rank")
    return held.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= budget).select("qid", "place", "chunk_id")


def dedupe_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of like text within a corpus: the first id, and how many there are."""
    rows = table(spark, folder, "documents").dropDuplicates(["doc_id"])
    return rows.groupBy("corpus_id", F.sha2(T.normalised(F.col("text")), 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "corpus_id", "copies")


_ALL = (
    fact_coverage, missing_facts, sufficiency_judge, evidence_judge, coverage_judge, conflict_detection, unsupported_claims, guard_citations, feedback_queries, feedback_fact_match, reformulate_query, verify_claims,
    final_decision, abstention_policy, audit_trail, evidence_context, best_sentence, grounded_answers, draft_claims, extractive_answer, synthesize_answer, context_sufficiency, adaptive_recovery, recovery_merge, iterative_retrieval, baseline_b0, baseline_b1, baseline_e1, dedupe_hits,
)
QUERIES = {f.__name__: f for f in _ALL}

#: Also over hybrid search, as the reference's pipeline takes it.
_ALSO_HYBRID = (evidence_context, best_sentence, grounded_answers, draft_claims, extractive_answer, synthesize_answer, context_sufficiency, adaptive_recovery, recovery_merge, baseline_b0)
QUERIES |= {f"hybrid_{f.__name__}": update_wrapper(partial(f, search=retrieval.hybrid), f) for f in _ALSO_HYBRID}
QUERIES |= {f.__name__: f for f in (hybrid_baseline_b1, hybrid_baseline_e1, hybrid_iterative_retrieval)}

LOG = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id) AS copy FROM per_question_comparison) WHERE copy = 1)"
_SNIPPETS = "s AS (SELECT * FROM (SELECT question_id AS qid, 'b0' AS sid, b0_answer AS text FROM l UNION ALL SELECT question_id, 'b1', b1_answer FROM l UNION ALL SELECT question_id, 'e1', e1_answer FROM l) WHERE text IS NOT NULL AND trim(text) <> '')"
_CLAIMS = f"""c_a AS (SELECT question_id AS qid, CASE b1_status WHEN 'answered' THEN ['b1'] WHEN 'partial' THEN ['b1', 'b9'] ELSE [] END AS sids, {S.sentences('e1_answer')} AS t FROM l),
    c AS (SELECT qid, sids, unnest(range(1, len(t) + 1)) AS claim_no, unnest(t) AS text FROM c_a)"""
_STOPS = {"plan": T.PLAN_STOPS, "feedback": T.FEEDBACK_STOPS, "recovery": T.RECOVERY_STOPS, "answer": T.ANSWER_STOPS, "sentence": T.SENTENCE_STOPS}


def _meaningful(x: str, stops: str = "plan") -> str:
    return f"list_distinct({S.without(x, _STOPS[stops])})"


_BASE = f"{ASKED}, {FACTS}, {LOG}, {_SNIPPETS}"
_HELD = f"""h AS (SELECT f.qid, f.fact_no, s.sid FROM facts f JOIN s USING (qid) WHERE len(list_filter({_meaningful('f.description')}, lambda t: NOT contains(lower(s.text), t))) = 0)"""
_CONFLICTS = r"""x_g AS (SELECT qid, term, string_agg(DISTINCT sid, ',' ORDER BY sid) AS sids FROM (SELECT qid, sid, unnest(list_distinct(regexp_extract_all(text, '\d+'))) AS term FROM s) GROUP BY ALL),
    x AS (SELECT * FROM x_g WHERE qid IN (SELECT qid FROM x_g GROUP BY qid HAVING count(*) > 1))"""
_LOOSE = """o AS (SELECT DISTINCT qid, claim_no FROM (SELECT qid, claim_no, unnest(CASE WHEN len(sids) = 0 THEN [NULL] ELSE sids END) AS sid FROM c) k WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.qid = k.qid AND s.sid = k.sid))"""
_ASSESSED = f"""{_BASE}, {_HELD}, {_CLAIMS}, {_CONFLICTS}, {_LOOSE},
    j_a AS (SELECT f.qid, count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no)) AS covered FROM facts f GROUP BY f.qid),
    j_b AS (SELECT j_a.*, (SELECT count(*) FROM x WHERE x.qid = j_a.qid) AS conflicts, (SELECT count(*) FROM o WHERE o.qid = j_a.qid) AS unsupported, (SELECT count(*) FROM s WHERE s.qid = j_a.qid) AS snippets FROM j_a),
    j_c AS (SELECT *, CASE WHEN conflicts > 0 THEN 'conflicting' WHEN covered = facts AND unsupported = 0 THEN 'sufficient' WHEN covered < facts AND snippets = 0 THEN 'unanswerable'
        WHEN covered < facts AND covered > 0 AND unsupported = 0 THEN 'useful_but_incomplete' ELSE 'insufficient' END AS label FROM j_b),
    j AS (SELECT qid, facts, covered, conflicts, unsupported, CASE WHEN label IN ('sufficient', 'useful_but_incomplete') THEN least(covered / facts::DOUBLE, 1) WHEN label = 'unanswerable' THEN 0 ELSE least(covered / facts::DOUBLE, 0.5::DOUBLE) END AS score, label,
        CASE WHEN label = 'sufficient' THEN 'answered' WHEN label IN ('useful_but_incomplete', 'conflicting') THEN 'partial' ELSE 'unanswerable' END AS status FROM j_c)"""
_FEEDBACK = rf"""w_a AS (SELECT f.qid, f.fact_no, list_filter(regexp_extract_all(regexp_replace(lower(f.description), '''s', '', 'g'), '[a-z0-9]+'), lambda t: t NOT IN {S.words_in(T.FEEDBACK_STOPS)}) AS t FROM facts f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no)),
    w AS (SELECT qid, fact_no, array_to_string({S.first_seen('t')}, ' ') AS query FROM w_a)"""


def _recovery(source: str, out: str) -> str:
    """CTEs from ``source`` (qid, question, missing) to ``out`` (qid, question): reformulated queries."""
    q, m = S.without("question", T.RECOVERY_STOPS), S.without("coalesce(missing, '')", T.RECOVERY_STOPS)
    return f"""{out}_a AS (SELECT qid, question, missing, ({q})[1:3] AS q3, {m} AS m0 FROM {source}),
    {out}_b AS (SELECT *, list_concat(q3, ({S.first_seen('m0')})[1:4]) AS l FROM {out}_a),
    {out} AS (SELECT qid, CASE WHEN trim(coalesce(missing, '')) = '' OR len(l) = 0 THEN question ELSE array_to_string({S.first_seen('l')}, ' ') END AS question FROM {out}_b)"""


_SUPPORT = """v_a AS (SELECT c.qid, c.claim_no, list_filter(regexp_extract_all(lower(c.text), '[a-z0-9]+'), lambda t: length(t) > 2) AS tokens,
        (SELECT string_agg(lower(s.text), ' ' ORDER BY s.sid) FROM s WHERE s.qid = c.qid AND list_contains(c.sids, s.sid)) AS cited FROM c),
    v_b AS (SELECT qid, claim_no, CASE WHEN cited IS NULL THEN 0.0::DOUBLE WHEN len(tokens) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(tokens, lambda t: contains(cited, t))) / len(tokens)::DOUBLE END AS support FROM v_a),
    v AS (SELECT qid, count(*) AS claims, count(*) FILTER (support >= 0.6::DOUBLE) AS supported, round(avg(support), 6) AS mean_support, CASE WHEN count(*) FILTER (support >= 0.6::DOUBLE) = count(*) THEN 'TRUSTED' ELSE 'ABSTAIN' END AS decision FROM v_b GROUP BY qid)"""


def _ranked(k: int) -> str:
    return f"{S.INDEX}, {S.QUESTIONS}, {S.bm25('b', 'q', k)}, e AS (SELECT b.qid, q.question, b.rank, b.chunk_id, u.document_id, u.text FROM b JOIN u USING (chunk_id) JOIN q USING (qid))"


_STEMS = lambda x: f"list_distinct(list_transform({x}, lambda t: {S.stem('t')}))"


def _sentences(terms: str) -> str:
    return f"""z_a AS (SELECT qid, rank, chunk_id, {terms} AS qs, {S.sentences('text')} AS l FROM e),
    z_b AS (SELECT qid, rank, chunk_id, qs, unnest(range(0, len(l))) AS pos, unnest(l) AS sentence FROM z_a),
    z AS (SELECT qid, rank, chunk_id, pos, sentence, len(list_intersect(qs, {_STEMS(S.ascii_tokens('sentence'))})) AS overlap FROM z_b)"""


_BEST = f"{_ranked(6)}, {_sentences(_STEMS('list_filter(' + S.ascii_tokens('question') + ', lambda t: length(t) > 2 AND t NOT IN ' + S.words_in(T.SENTENCE_STOPS) + ')'))}, bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY overlap DESC, pos) AS n FROM z) WHERE n = 1)"


def _drafted(k: int) -> str:
    flat = S.squashed("text")
    return f"""{_ranked(k)}, d_a AS (SELECT *, {flat} AS flat, row_number() OVER (PARTITION BY qid, lower({flat}) ORDER BY rank) AS n FROM e WHERE {flat} <> ''),
    d AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS claim_no, chunk_id, CASE WHEN length(flat) > 180 THEN left(flat, 177) || '...' ELSE flat END AS claim FROM d_a WHERE n = 1)"""


_CONTEXT_FACTS = f"""cf_a AS (SELECT qid, list_filter({S.without('question', T.PLAN_STOPS)}, lambda t: length(t) > 5) AS l FROM q), cf_b AS (SELECT qid, {S.first_seen('l')} AS l FROM cf_a),
    cf AS (SELECT qid, unnest(range(1, len(l) + 1)) AS fact_no, unnest(l) AS description FROM cf_b),
    ch AS (SELECT DISTINCT cf.qid, cf.fact_no FROM cf JOIN e USING (qid) WHERE contains(lower(coalesce(e.text, '')), cf.description))"""
_RECOVERED = f"""{_ranked(6)}, {_CONTEXT_FACTS},
    mi AS (SELECT q.qid, q.question, string_agg(cf.description, ' ' ORDER BY cf.fact_no) AS missing FROM cf JOIN q USING (qid) WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.qid = cf.qid AND ch.fact_no = cf.fact_no) GROUP BY ALL),
    {_recovery('mi', 'q2')}, {S.bm25('b2', 'q2', 6)},
    r_a AS (SELECT qid, chunk_id, 1 AS pass, rank FROM b UNION ALL SELECT qid, chunk_id, 2, rank FROM b2),
    r_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pass, rank) AS n FROM r_a) WHERE n = 1),
    r AS (SELECT qid, chunk_id, CAST(pass AS BIGINT) AS pass, rank, row_number() OVER (PARTITION BY qid ORDER BY pass, rank) AS place FROM r_b)"""

def _grounded(rows: str) -> str:
    """CTEs from ``rows`` (qid, question, rank, chunk_id, text) to g: grounded answers."""
    return f"""{_sentences(_STEMS(S.without('question', T.ANSWER_STOPS))).replace('FROM e)', f'FROM {rows})')},
    g_a AS (SELECT *, row_number() OVER (PARTITION BY qid, sentence ORDER BY rank, pos) AS n FROM z WHERE overlap > 0 AND len(regexp_split_to_array(sentence, '\\s+')) >= 3),
    g_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS place FROM g_a WHERE n = 1) WHERE place <= 3),
    g_c AS (SELECT qid, place, sentence, chunk_id FROM g_b UNION ALL SELECT qid, 1, sentence, chunk_id FROM z WHERE rank = 1 AND pos = 0 AND qid NOT IN (SELECT qid FROM g_b)),
    g AS (SELECT qid, string_agg(sentence, ' ' ORDER BY place) AS answer, round(least(0.98::DOUBLE, greatest(0.5::DOUBLE, 0.9::DOUBLE + count(*) * 0.02::DOUBLE)), 6) AS confidence FROM g_c GROUP BY qid)"""


def _judged_answers(rows: str) -> str:
    return f"""held AS (SELECT DISTINCT cf.qid, cf.fact_no FROM cf JOIN {rows} x USING (qid) WHERE contains(lower(coalesce(x.text, '')), cf.description)),
    ju AS (SELECT cf.qid, count(*) FILTER (EXISTS (SELECT 1 FROM held WHERE held.qid = cf.qid AND held.fact_no = cf.fact_no)) >= 0.5::DOUBLE * count(*) AS sufficient FROM cf GROUP BY cf.qid), {_grounded(rows)}
    SELECT ju.qid, CASE WHEN sufficient AND answer IS NOT NULL THEN 'answered' ELSE 'abstained' END AS status, CASE WHEN sufficient THEN coalesce(answer, '') ELSE '' END AS answer, CASE WHEN sufficient THEN coalesce(confidence, 0) ELSE 0 END AS confidence FROM ju LEFT JOIN g USING (qid)"""


SQL = {
    "baseline_b0": f"WITH {_ranked(1)} SELECT qid, chunk_id, md5(coalesce(text, '')) AS answer_md5 FROM e",
    "baseline_b1": f"WITH {_ranked(6)}, {_CONTEXT_FACTS}, {_judged_answers('e')}",
    "baseline_e1": f"WITH {_RECOVERED}, e1 AS (SELECT r.qid, q.question, r.place AS rank, r.chunk_id, u.text FROM r JOIN u USING (chunk_id) JOIN q USING (qid)), {_judged_answers('e1')}",
    "fact_coverage": f"WITH {_BASE}, {_HELD} SELECT f.qid, f.fact_no, coalesce((SELECT string_agg(DISTINCT sid, ',' ORDER BY sid) FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no), '') AS sids FROM facts f",
    "missing_facts": f"WITH {_BASE}, {_HELD} SELECT f.qid, f.fact_no, f.description FROM facts f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no)",
    "sufficiency_judge": f"WITH {_ASSESSED} SELECT qid, facts, covered, conflicts, unsupported, round(score, 6) AS score, label FROM j",
    "evidence_judge": f"WITH {_ASSESSED} SELECT qid, round(covered / facts::DOUBLE, 6) AS score, CASE WHEN covered = facts AND unsupported = 0 THEN 'sufficient' ELSE 'insufficient' END AS status FROM j",
    "coverage_judge": f"""WITH {_BASE}, t AS (SELECT DISTINCT qid, unnest({S.ascii_tokens('text')}) AS t FROM s), m AS (SELECT qid, fact_no, unnest({_meaningful('description')}) AS t FROM facts),
        n AS (SELECT qid, count(DISTINCT fact_no) AS covered FROM m JOIN t USING (qid, t) GROUP BY qid), k AS (SELECT qid, count(*) AS facts FROM facts GROUP BY qid), r AS (SELECT qid, facts, coalesce(covered, 0) AS covered FROM k LEFT JOIN n USING (qid))
        SELECT qid, facts, covered, CASE WHEN covered = 0 THEN 'irrelevant' WHEN covered < facts THEN 'insufficient' ELSE 'sufficient' END AS status, CASE WHEN covered = 0 THEN 0.2::DOUBLE WHEN covered < facts THEN 0.45::DOUBLE ELSE 0.85::DOUBLE END AS score FROM r""",
    "conflict_detection": f"WITH {LOG}, {_SNIPPETS}, {_CONFLICTS} SELECT qid, term, sids FROM x",
    "unsupported_claims": f"WITH {LOG}, {_SNIPPETS}, {_CLAIMS}, {_LOOSE} SELECT qid, claim_no FROM o",
    "guard_citations": f"""WITH {LOG}, {_SNIPPETS}, {_CLAIMS}, k AS (SELECT c.qid, c.claim_no, string_agg(DISTINCT s.sid, ',' ORDER BY s.sid) AS sids FROM c JOIN s ON s.qid = c.qid AND list_contains(c.sids, s.sid) GROUP BY ALL)
        SELECT qid, claim_no, sids, (SELECT count(*) FROM c WHERE c.qid = k.qid) - count(*) OVER (PARTITION BY qid) AS dropped FROM k""",
    "feedback_queries": f"WITH {_BASE}, {_HELD}, {_FEEDBACK} SELECT qid, fact_no, query FROM w",
    "feedback_fact_match": f"""WITH {_BASE}, {_HELD}, {_FEEDBACK}, p AS (SELECT DISTINCT qid, query FROM w), r AS (SELECT p.qid, p.query, f.fact_no, coalesce(len(list_intersect(list_distinct({S.ascii_tokens('p.query')}), {S.ascii_tokens('f.description')})) / nullif(len(list_distinct({S.ascii_tokens('p.query')})), 0)::DOUBLE, 0) AS score FROM p JOIN facts f USING (qid))
        SELECT qid, query, fact_no FROM (SELECT *, row_number() OVER (PARTITION BY qid, query ORDER BY round(score, 9) DESC, fact_no) AS n FROM r) WHERE n = 1""",
    "reformulate_query": f"""WITH {_BASE}, {_HELD}, mi AS (SELECT a.qid, a.question, (SELECT string_agg(f.description, ' ' ORDER BY f.fact_no) FROM facts f WHERE f.qid = a.qid AND NOT EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no)) AS missing FROM a),
        {_recovery('mi', 'q2')} SELECT qid, question AS query FROM q2""",
    "verify_claims": f"WITH {LOG}, {_SNIPPETS}, {_CLAIMS}, {_SUPPORT} SELECT qid, claims, supported, mean_support, decision FROM v",
    "final_decision": f"WITH {_ASSESSED}, {_SUPPORT} SELECT j.qid, status, CASE WHEN status = 'answered' AND coalesce(v.decision, 'ABSTAIN') = 'TRUSTED' THEN 'ANSWERED' ELSE 'ABSTAINED' END AS decision FROM j LEFT JOIN v USING (qid)",
    "abstention_policy": f"""WITH {_ASSESSED} SELECT j.qid, status, CASE WHEN status = 'answered' THEN e1_answer WHEN status = 'partial' THEN CASE WHEN label = 'conflicting' THEN 'The sources disagree: ' ELSE 'Only part of this is supported: ' END || coalesce(e1_answer, '')
        ELSE 'The sources do not support an answer.' END AS answer FROM j JOIN l ON l.question_id = j.qid""",
    "audit_trail": f"""WITH {_ASSESSED} SELECT qid, (SELECT string_agg(description, ' | ' ORDER BY fact_no) FROM facts f WHERE f.qid = j.qid) AS plan, coalesce((SELECT string_agg(sid || ':' || sha256({S.squashed('lower(text)')}), ',' ORDER BY sid) FROM s WHERE s.qid = j.qid), '') AS digests, label FROM j""",
    "evidence_context": f"WITH {_ranked(6)}, k AS (SELECT qid, string_agg('[' || document_id || ']: ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context FROM e GROUP BY qid) SELECT qid, md5(context) AS context_md5, length(context) AS characters FROM k",
    "best_sentence": f"WITH {_BEST} SELECT qid, rank, sentence, overlap FROM bs",
    "grounded_answers": f"""WITH {_ranked(6)}, {_sentences(_STEMS(S.without('question', T.ANSWER_STOPS)))},
        g_a AS (SELECT *, row_number() OVER (PARTITION BY qid, sentence ORDER BY rank, pos) AS n FROM z WHERE overlap > 0 AND len(regexp_split_to_array(sentence, '\\s+')) >= 3),
        g_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, rank, pos) AS place FROM g_a WHERE n = 1) WHERE place <= 3),
        g_c AS (SELECT qid, place, sentence, chunk_id FROM g_b UNION ALL SELECT qid, 1, sentence, chunk_id FROM z WHERE rank = 1 AND pos = 0 AND qid NOT IN (SELECT qid FROM g_b))
        SELECT qid, string_agg(sentence, ' ' ORDER BY place) AS answer, string_agg(chunk_id, ',' ORDER BY place) AS chunk_ids, count(*) AS claims, round(least(0.98::DOUBLE, greatest(0.5::DOUBLE, 0.9::DOUBLE + count(*) * 0.02::DOUBLE)), 6) AS confidence FROM g_c GROUP BY qid""",
    "draft_claims": f"WITH {_drafted(6)} SELECT qid, claim_no, chunk_id, claim FROM d",
    "extractive_answer": f"WITH {_drafted(3)} SELECT qid, string_agg(claim || ' [' || chunk_id || ']', chr(10) ORDER BY claim_no) AS answer FROM d GROUP BY qid",
    "synthesize_answer": f"WITH {_BEST}, y AS (SELECT qid, sentence, min(rank) AS rank FROM bs WHERE overlap > 0 GROUP BY ALL) SELECT qid, string_agg(sentence, ' ' ORDER BY rank, sentence) AS answer, count(*) AS sentences FROM y GROUP BY qid",
    "context_sufficiency": f"WITH {_ranked(6)}, {_CONTEXT_FACTS}, k AS (SELECT cf.qid, count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM ch WHERE ch.qid = cf.qid AND ch.fact_no = cf.fact_no)) AS covered FROM cf GROUP BY cf.qid) SELECT qid, facts, covered, round(covered / facts::DOUBLE, 6) AS score, covered = facts AS sufficient FROM k",
    "adaptive_recovery": f"WITH {_RECOVERED} SELECT qid, chunk_id, pass, rank, place FROM r",
    "recovery_merge": f"WITH {_RECOVERED} SELECT qid, count(*) FILTER (pass = 1) AS first_pass, count(*) FILTER (pass = 2) AS second_pass FROM r GROUP BY qid",
    "iterative_retrieval": f"WITH {_RECOVERED} SELECT qid, place, chunk_id FROM r WHERE place <= 8",
    "dedupe_hits": f"SELECT min(doc_id) AS doc_id, corpus_id, count(*) AS copies FROM documents GROUP BY corpus_id, sha256({S.squashed('lower(text)')})",
}


def _hybrid(out: str, queries: str, k: int) -> str:
    """CTEs of dense and term search of ``queries`` (qid, question), fused and reranked, over INDEX and the vectors ``cv``."""
    body = f"{S.vectors('qv', 'q', 'qid', 'question')}, {S.dense('d', 20)}, {S.bm25('b', 'q', 20)}, {_FUSED}, c15 AS (SELECT * FROM f WHERE rank <= 15), {_reranked('c15', k)}"
    own = re.sub(r"\b(qv\w*|d|d_s|b|b_[ts]|f|f_[sw]|c15|r|r_[cs])\b", rf"{out}_\1", re.sub(r"\bq\b", queries, body))
    return f"{own}, {out} AS (SELECT * FROM {out}_r)"


def _over_hybrid(sql: str, k: int = 6) -> str:
    """The SQL of a query over term search, over hybrid search in each pass."""
    first, again = S.bm25("b", "q", k), S.bm25("b2", "q2", 6)
    return sql.replace(first, f"{S.vectors('cv', 'u', 'chunk_id', 'text')}, {_hybrid('b', 'q', k)}").replace(again, _hybrid("b2", "q2", 6))


def _by_all_facts(sql: str, rows: str) -> str:
    """The SQL of answers by half of the facts, by all of them and without conflict."""
    clash = f"SELECT qid FROM (SELECT qid, unnest(regexp_extract_all(coalesce(text, ''), '\\d+')) AS term FROM {rows}) GROUP BY qid HAVING count(DISTINCT term) > 1"
    return sql.replace(">= 0.5::DOUBLE * count(*)", f"= count(*) AND cf.qid NOT IN ({clash})")


SQL |= {f"hybrid_{f.__name__}": _over_hybrid(SQL[f.__name__], {"baseline_b0": 1, "extractive_answer": 3}.get(f.__name__, 6)) for f in _ALSO_HYBRID}
SQL |= {f"hybrid_baseline_{x}": _by_all_facts(_over_hybrid(SQL[f"baseline_{x}"]), rows) for x, rows in (("b1", "e"), ("e1", "e1"))}
