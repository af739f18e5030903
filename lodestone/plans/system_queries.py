"""The three systems run over the benchmark's questions: plain, judging, and recovering."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import answering, planning, retrieval
from lodestone.plans import sql as S
from lodestone.plans.answer_queries import _QUESTION_FACTS, _evaluated, evaluated
from lodestone.plans.evidence_queries import _grounded, _hybrid, _over_hybrid, _ranked, _recovery
from lodestone.plans.retrieval_queries import questions
from lodestone.plans.text_queries import chunks
from lodestone.session import materialise
from lodestone.tables import table


def _expected(spark: SparkSession, folder: str) -> DataFrame:
    """qid, answerable, terms: what a right answer must contain."""
    rows = table(spark, folder, "sufficiency_benchmark").where("id is not null").dropDuplicates(["id"])
    return rows.select(F.col("id").alias("qid"), (F.coalesce("candidate_label", F.lit("")) == "SUFFICIENT").alias("answerable"), T.ascii_tokens(F.col("source_qa_answer")).alias("terms"))


def _outcome(system: str, expected: DataFrame, said: DataFrame, tried: DataFrame | None = None) -> DataFrame:
    """Of each question: is the system's answer (``said``: qid, answer; no row where it abstains) right, and does it answer what cannot be answered?"""
    rows = expected.join(said.select("qid", "answer"), "qid", "left")
    rows = rows.join(tried.select("qid", F.lit(2).cast("long").alias("iterations")), "qid", "left") if tried is not None else rows.withColumn("iterations", F.lit(1).cast("long"))
    answered = F.col("answer").isNotNull()
    held = F.forall("terms", lambda t: F.contains(F.lower("answer"), t))
    right = F.when(F.col("answerable"), answered & F.coalesce(held, F.lit(False))).otherwise(~answered)
    return rows.select(F.lit(system).alias("system"), "qid", answered.alias("answered"), right.alias("correct"), (answered & ~F.col("answerable")).alias("unsupported"), F.coalesce("iterations", F.lit(1).cast("long")).alias("iterations"))


def system_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What the three systems make of each question of the benchmark.

    b0 gives the best chunk of hybrid search as it is. b1 answers where the best six hold all that the planner asks for. e1 searches once more for
    what is missing, judges all that it then holds, and answers by it; its answers are sentences of the chunks they cite, so their claims are
    supported. A right answer to a question that can be answered contains all words of the expected one; to another it is none.
    """
    q, c = questions(spark, folder), chunks(spark, folder)
    expected, facts = _expected(spark, folder), planning.plan_facts(q)
    first = materialise(retrieval.hybrid(q, c, k=6), "first")
    rows = materialise(answering.evidence(first, c, q), "evidence")
    judged, missing = evaluated(facts, rows)
    enough = judged.where("label = 'sufficient'").select("qid")
    b0 = rows.where("rank = 1").select("qid", F.coalesce("text", F.lit("")).alias("answer"))
    b1 = answering.grounded(rows.join(enough, "qid", "left_semi"))
    missing = missing.groupBy("qid").agg(F.array_join(F.transform(answering.in_order("fact_no", "description"), lambda x: x["description"]), " ").alias("missing"))
    again = materialise(q.join(missing, "qid").select("qid", planning.reformulated(F.col("question"), F.col("missing")).alias("question")), "again")
    merged = answering.merged(first, retrieval.hybrid(again, c, k=6)).select("qid", "chunk_id", F.col("place").alias("rank"))
    more = materialise(answering.evidence(merged, c, q), "evidence")
    enough = evaluated(facts, more)[0].where("label = 'sufficient'").select("qid")
    e1 = answering.grounded(more.join(enough, "qid", "left_semi"))
    return _outcome("b0", expected, b0).unionByName(_outcome("b1", expected, b1)).unionByName(_outcome("e1", expected, e1, again))


def system_runs_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of the three systems."""
    n = F.count("*")
    rate = lambda c, name: F.round(F.count_if(c) / n, 6).alias(name)
    return system_runs(spark, folder).groupBy("system").agg(
        n.alias("questions"), F.count_if("correct").alias("correct"), rate(F.col("correct"), "accuracy"), rate(F.col("unsupported"), "unsupported_rate"), rate(~F.col("answered"), "abstention_rate"), F.round(F.avg("iterations"), 6).alias("mean_iterations")
    )


QUERIES = {f.__name__: f for f in (system_runs, system_runs_summary)}


def _said(rows: str, judged: str, out: str) -> str:
    """CTEs from the evidence ``rows`` and the judgement to ``out`` (qid, answer): grounded answers where all is held."""
    # not the flags of regular expressions
    own = re.sub(r"(?<!')\b(z_a|z_b|z|g_a|g_b|g_c|g)\b(?!')", rf"{out}_\1", _grounded("ROWS")).replace("ROWS", rows)
    return f"{own}, {out} AS (SELECT qid, answer FROM {out}_g WHERE qid IN (SELECT qid FROM {judged} WHERE label = 'sufficient'))"


_RUNS = f"""WITH {_over_hybrid(_ranked(6))}, {_QUESTION_FACTS}, {_evaluated('e', 'k1')}, {_said('e', 'k1', 's1')},
    mi AS (SELECT q.qid, q.question, string_agg(facts.description, ' ' ORDER BY facts.fact_no) AS missing FROM facts JOIN q USING (qid) WHERE NOT EXISTS (SELECT 1 FROM k1_h h WHERE h.qid = facts.qid AND h.fact_no = facts.fact_no) GROUP BY ALL),
    {_recovery('mi', 'q2')}, {_hybrid('b2', 'q2', 6)},
    m_a AS (SELECT qid, chunk_id, 1 AS pass, rank FROM b UNION ALL SELECT qid, chunk_id, 2, rank FROM b2), m_b AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pass, rank) AS n FROM m_a),
    e2 AS (SELECT m.qid, q.question, row_number() OVER (PARTITION BY m.qid ORDER BY pass, rank) AS rank, m.chunk_id, u.document_id, u.text FROM m_b m JOIN u USING (chunk_id) JOIN q ON q.qid = m.qid WHERE m.n = 1),
    {_evaluated('e2', 'k2')}, {_said('e2', 'k2', 's2')},
    x AS (SELECT id AS qid, coalesce(candidate_label, '') = 'SUFFICIENT' AS answerable, {S.ascii_tokens('source_qa_answer')} AS terms FROM (SELECT *, row_number() OVER (PARTITION BY id) AS copy FROM sufficiency_benchmark WHERE id IS NOT NULL) WHERE copy = 1),
    y AS (SELECT 'b0' AS system, x.*, (SELECT coalesce(text, '') FROM e WHERE e.qid = x.qid AND e.rank = 1) AS answer, 1 AS iterations FROM x
        UNION ALL SELECT 'b1', x.*, (SELECT answer FROM s1 WHERE s1.qid = x.qid), 1 FROM x UNION ALL SELECT 'e1', x.*, (SELECT answer FROM s2 WHERE s2.qid = x.qid), CASE WHEN x.qid IN (SELECT qid FROM q2) THEN 2 ELSE 1 END FROM x),
    ru AS (SELECT system, qid, answer IS NOT NULL AS answered, CASE WHEN answerable THEN answer IS NOT NULL AND coalesce(len(list_filter(terms, lambda t: NOT contains(lower(answer), t))) = 0, FALSE) ELSE answer IS NULL END AS correct, answer IS NOT NULL AND NOT answerable AS unsupported, iterations FROM y)"""
SQL = {
    "system_runs": f"{_RUNS} SELECT * FROM ru",
    "system_runs_summary": f"""{_RUNS} SELECT system, count(*) AS questions, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (unsupported) / count(*)::DOUBLE, 6) AS unsupported_rate,
        round(count(*) FILTER (NOT answered) / count(*)::DOUBLE, 6) AS abstention_rate, round(avg(iterations), 6) AS mean_iterations FROM ru GROUP BY system""",
}
