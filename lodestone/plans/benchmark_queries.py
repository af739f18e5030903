"""Queries that judge the held-out benchmark, with checks of its records and of judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import contracts, judging, planning
from lodestone.plans import sql as S
from lodestone.plans.evidence_queries import _HELD, LOG, _meaningful, log, snippets
from lodestone.plans.retrieval_queries import FACTS, _lexical, asked, lexical_retrieval
from lodestone.tables import table

#: Words that are no required terms of a given fact, and the values that records may hold.
FACT_STOPS = "who what when where why how the a an and or of to in is was".split()
SOURCES = ("PopQA", "FreshQA", "Natural Questions", "EntityQuestions")
WITH_IDS, WITHOUT_IDS = SOURCES[:2], SOURCES[2:]
LABELS, GOLD_LABELS = ("SUFFICIENT", "INSUFFICIENT"), ("PENDING", "SUFFICIENT", "INSUFFICIENT")
CONTEXT_TYPE = "constructed_controlled_context"


def benchmark(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sufficiency_benchmark").where("id is not null").dropDuplicates(["id"])


def _planned(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each item as the planner finds them in its question."""
    return planning.plan_facts(benchmark(spark, folder).select(F.col("id").alias("qid"), F.col("original_question").alias("question")))


def _given(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each item as its record gives them (its question, where it gives none), with their terms of three letters or more."""
    facts = F.coalesce("required_facts", F.array("original_question"))
    rows = benchmark(spark, folder).select(F.col("id").alias("qid"), F.posexplode(facts).alias("i", "description"))
    terms = F.filter(T.ascii_tokens(F.col("description")), lambda t: (F.length(t) > 2) & ~t.isin(*FACT_STOPS))
    every = F.array_distinct(T.ascii_tokens(F.col("description")))
    return rows.select("qid", (F.col("i") + 1).cast("long").alias("fact_no"), "description", F.when(F.size(terms) > 0, terms).otherwise(every).alias("terms"))


def _judged(spark: SparkSession, folder: str, facts: DataFrame) -> DataFrame:
    """Each item judged by its context as the only snippet, which the only claim cites. Items without facts are sufficient."""
    rows = benchmark(spark, folder)
    held = rows.select(F.col("id").alias("qid"), F.lit("snip").alias("sid"), F.col("context").alias("text"), F.lit("eval_corpus").alias("corpus_id"))
    claims = held.select("qid", F.lit(1).cast("long").alias("claim_no"), F.array("sid").alias("sids"))
    found = judging.assess(facts, held, claims, by_fact=True).select(F.col("qid").alias("id"), "facts", "covered", "score", "label")
    rows = rows.select("id", "source_dataset", "reasoning_type", "candidate_label").join(found, "id", "left")
    predicted = F.when(F.coalesce("label", F.lit("sufficient")) == "sufficient", "SUFFICIENT").otherwise("INSUFFICIENT")
    zero = F.lit(0).cast("long")
    return rows.select("id", "source_dataset", "reasoning_type", "candidate_label", predicted.alias("predicted_label"), F.coalesce("facts", zero).alias("facts"), F.coalesce("covered", zero).alias("covered"), F.round(F.coalesce("score", F.lit(1.0)), 6).alias("score"))


def benchmark_judge(spark: SparkSession, folder: str) -> DataFrame:
    """Is each item's context sufficient, by the facts that the planner finds in the question?"""
    return _judged(spark, folder, _planned(spark, folder))


def benchmark_judge_by_given_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Is each item's context sufficient, by the facts of its record?"""
    return _judged(spark, folder, _given(spark, folder))


def _both(spark: SparkSession, folder: str) -> DataFrame:
    planner = benchmark_judge(spark, folder).withColumn("mode", F.lit("planner"))
    return planner.unionByName(benchmark_judge_by_given_facts(spark, folder).withColumn("mode", F.lit("fact_grounded")))


def benchmark_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Judgements in both modes against the candidate labels."""
    from lodestone.operators import metrics

    rows = _both(spark, folder).select("mode", (F.col("predicted_label") == "SUFFICIENT").alias("predicted"), (F.col("candidate_label") == "SUFFICIENT").alias("actual"))
    return metrics.binary(rows, "mode")


def benchmark_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Agreement with the candidate labels by source and by type of reasoning, in both modes."""
    rows = _both(spark, folder)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).alias("name")) for c in ("source_dataset", "reasoning_type")])).alias("x")
    rows = rows.select("mode", each, "predicted_label", "candidate_label").select("mode", "x.by", "x.name", "predicted_label", "candidate_label")
    n = lambda c, label: F.count_if(F.col(c) == label)
    return rows.groupBy("mode", "by", "name").agg(
        F.count("*").alias("total"), F.round(F.count_if(F.col("predicted_label") == F.col("candidate_label")) / F.count("*"), 6).alias("agreement"), n("predicted_label", "SUFFICIENT").alias("predicted_sufficient"),
        n("predicted_label", "INSUFFICIENT").alias("predicted_insufficient"), n("candidate_label", "SUFFICIENT").alias("candidate_sufficient"), n("candidate_label", "INSUFFICIENT").alias("candidate_insufficient"),
    )


def benchmark_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What each record of the benchmark fails to promise."""
    rows = table(spark, folder, "sufficiency_benchmark").where("id is not null")
    filled = lambda c: F.trim(c) != ""
    source = F.col("source_dataset")
    checks = {
        "bad_source": source.isin(*SOURCES), "no_locator": filled("source_locator"), "no_record_id": ~source.isin(*WITH_IDS) | F.coalesce(filled("source_record_id"), F.lit(False)), "record_id_of_source_without": ~source.isin(*WITHOUT_IDS) | F.col("source_record_id").isNull(),
        "bad_context_type": F.col("context_source_type") == CONTEXT_TYPE, "bad_candidate_label": F.col("candidate_label").isin(*LABELS), "bad_gold_label": F.col("gold_label").isin(*GOLD_LABELS),
        "empty_original_question": filled("original_question"), "empty_context": filled("context"), "empty_rationale": filled("rationale"), "empty_source_qa_answer": filled("source_qa_answer"),
        "no_required_facts": F.size("required_facts") > 0, "empty_required_fact": F.forall("required_facts", lambda f: F.coalesce(F.trim(f) != "", F.lit(False))),
    }
    failed = contracts.errors(rows.dropDuplicates(["id"]), "id", checks)
    return failed.unionByName(contracts.repeated(rows, "id").select("id", F.lit("duplicate_id").alias("error")))


def contract_checks(spark: SparkSession, folder: str) -> DataFrame:
    """How often plans, corpora, judgements and feedback of the log's questions break what they promise, a row a promise."""
    corpora = table(spark, folder, "corpora")
    questions = asked(spark, folder)
    facts = planning.plan_facts(questions)
    found = snippets(spark, folder)
    supported = judging.support(facts, found)
    judged = judging.assess(facts, found, found.select("qid", F.lit(1).cast("long").alias("claim_no"), F.array("sid").alias("sids")))
    routed = planning.routes(facts, corpora)
    checks = {
        "corpus_without_id": corpora.where("id is null or trim(id) = ''"), "duplicate_corpus": contracts.repeated(corpora, "id"), "corpus_without_description": corpora.where(F.size(T.words(F.col("description"))) < 3),
        "plan_without_facts": questions.join(facts.select("qid").distinct(), "qid", "left_anti"), "duplicate_fact": contracts.repeated(facts, "qid", "fact_no"), "route_to_unknown_corpus": contracts.unknown(routed, "corpus_id", corpora, "id"),
        "score_out_of_range": judged.where("not score between 0 and 1"), "sufficient_with_missing_facts": judged.where("label = 'sufficient' and covered < facts"),
        "insufficient_without_reason": judged.where("label != 'sufficient' and covered = facts and unsupported = 0"), "covered_by_unknown_snippet": supported.join(found, ["qid", "sid"], "left_anti"),
        "snippet_without_text": found.where("sid is null or text is null or trim(text) = ''"), "feedback_without_query": judging.feedback(facts, supported).where("trim(query) = ''"),
    }
    counts = [rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, rows in checks.items()]
    out = counts[0]
    for rows in counts[1:]:
        out = out.unionByName(rows)
    return out


def answer_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of the log as records: what each fails to promise. One row an answer and failure."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(f"{s}_answer").alias("answer"), F.col(f"{s}_status").alias("status"), F.col(f"{s}_latency_ms").alias("latency")) for s in ("b0", "b1", "e1")])).alias("x")
    rows = log(spark, folder).select("qid", each).select("qid", "x.*").withColumn("key", F.concat_ws(":", "qid", "system"))
    checks = {
        "no_text": F.col("answer").isNotNull(), "bad_status": F.col("status").isin("answered", "partial", "unanswerable"), "answered_without_words": (F.col("status") != "answered") | F.coalesce(F.col("answer").rlike(r"[\p{L}\p{N}]"), F.lit(False)),
        "no_latency": F.col("latency") >= 0,
    }
    return contracts.errors(rows, "key", checks).select(F.substring_index("key", ":", 1).alias("qid"), F.substring_index("key", ":", -1).alias("system"), "error")


def distractor_snippets(spark: SparkSession, folder: str) -> DataFrame:
    """Of each question's hits of lexical search: how many come from corpora that are kept to distract (those of tier C or without one)."""
    corpora = table(spark, folder, "corpora").where("id is not null").dropDuplicates(["id"])
    decoys = corpora.where(F.coalesce(F.try_element_at("metadata", F.lit("tier")), F.lit("C")) == "C").select(F.col("id").alias("corpus_id"), F.lit(True).alias("decoy"))
    hits = lexical_retrieval(spark, folder).join(decoys, "corpus_id", "left")
    return hits.groupBy("qid").agg(F.count("*").alias("hits"), F.count("decoy").alias("distracting"))


QUERIES = {f.__name__: f for f in (distractor_snippets, benchmark_judge, benchmark_judge_by_given_facts, benchmark_metrics, benchmark_breakdown, benchmark_checks, contract_checks, answer_checks)}

_BENCH = "bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS copy FROM sufficiency_benchmark WHERE id IS NOT NULL) WHERE copy = 1)"
_PLANNED = f"{_BENCH}, {FACTS.replace('FROM a WHERE', 'FROM (SELECT id AS qid, original_question AS question FROM bm) WHERE')}, pf AS (SELECT qid, fact_no, {_meaningful('description')} AS terms FROM facts)"
_GIVEN = f"""{_BENCH}, gf_a AS (SELECT id AS qid, unnest(range(1, len(coalesce(required_facts, [original_question])) + 1)) AS fact_no, unnest(coalesce(required_facts, [original_question])) AS description FROM bm),
    gf_b AS (SELECT qid, fact_no, description, list_filter({S.ascii_tokens('description')}, lambda t: length(t) > 2 AND t NOT IN {S.words_in(FACT_STOPS)}) AS l FROM gf_a),
    gf AS (SELECT qid, fact_no, CASE WHEN len(l) > 0 THEN l ELSE {S.ascii_tokens('description')} END AS terms FROM gf_b)"""


def _judge(facts: str, out: str) -> str:
    return f"""{out}_a AS (SELECT qid, count(*) AS facts, count(*) FILTER (len(list_filter(terms, lambda t: NOT contains(lower(coalesce(context, '')), t))) = 0) AS covered FROM {facts} f JOIN bm ON bm.id = f.qid GROUP BY qid),
    {out} AS (SELECT id, source_dataset, reasoning_type, candidate_label, CASE WHEN coalesce(covered = facts, TRUE) THEN 'SUFFICIENT' ELSE 'INSUFFICIENT' END AS predicted_label, coalesce(facts, 0) AS facts, coalesce(covered, 0) AS covered,
        round(coalesce(covered / facts::DOUBLE, 1), 6) AS score FROM bm LEFT JOIN {out}_a ON qid = id)"""


_MODES = f"{_PLANNED}, {_judge('pf', 'jp')}, {_GIVEN.removeprefix(_BENCH + ', ')}, {_judge('gf', 'jg')}, jb AS (SELECT 'planner' AS mode, * FROM jp UNION ALL SELECT 'fact_grounded', * FROM jg)"
_CHECKED = {
    "bad_source": f"source_dataset IN {S.words_in(SOURCES)}", "no_locator": "trim(source_locator) <> ''", "no_record_id": f"source_dataset NOT IN {S.words_in(WITH_IDS)} OR coalesce(trim(source_record_id) <> '', FALSE)", "record_id_of_source_without": f"source_dataset NOT IN {S.words_in(WITHOUT_IDS)} OR source_record_id IS NULL",
    "bad_context_type": f"context_source_type = '{CONTEXT_TYPE}'", "bad_candidate_label": f"candidate_label IN {S.words_in(LABELS)}", "bad_gold_label": f"gold_label IN {S.words_in(GOLD_LABELS)}", "empty_original_question": "trim(original_question) <> ''", "empty_context": "trim(context) <> ''",
    "empty_rationale": "trim(rationale) <> ''", "empty_source_qa_answer": "trim(source_qa_answer) <> ''", "no_required_facts": "len(required_facts) > 0", "empty_required_fact": "len(list_filter(required_facts, lambda f: NOT coalesce(trim(f) <> '', FALSE))) = 0",
}

SQL = {
    "distractor_snippets": f"SELECT qid, count(*) AS hits, count(*) FILTER (corpus_id IN (SELECT id FROM corpora WHERE coalesce(map_extract(metadata, 'tier')[1], 'C') = 'C')) AS distracting FROM ({_lexical(True, False, True, 5)}) GROUP BY qid",
    "benchmark_judge": f"WITH {_PLANNED}, {_judge('pf', 'jp')} SELECT * FROM jp",
    "benchmark_judge_by_given_facts": f"WITH {_GIVEN}, {_judge('gf', 'jg')} SELECT * FROM jg",
    "benchmark_metrics": f"""WITH {_MODES}, m AS (SELECT mode, count(*) FILTER (p AND a) AS tp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM (SELECT mode, predicted_label = 'SUFFICIENT' AS p, candidate_label = 'SUFFICIENT' AS a FROM jb) GROUP BY mode),
        m2 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM m)
        SELECT mode, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m2""",
    "benchmark_breakdown": f"""WITH {_MODES}, x AS (SELECT mode, 'source_dataset' AS "by", source_dataset AS name, predicted_label AS p, candidate_label AS c FROM jb UNION ALL SELECT mode, 'reasoning_type', reasoning_type, predicted_label, candidate_label FROM jb)
        SELECT mode, "by", name, count(*) AS total, round(count(*) FILTER (p = c) / count(*)::DOUBLE, 6) AS agreement, count(*) FILTER (p = 'SUFFICIENT') AS predicted_sufficient, count(*) FILTER (p = 'INSUFFICIENT') AS predicted_insufficient,
        count(*) FILTER (c = 'SUFFICIENT') AS candidate_sufficient, count(*) FILTER (c = 'INSUFFICIENT') AS candidate_insufficient FROM x GROUP BY ALL""",
    "benchmark_checks": f"WITH {_BENCH}, e AS (SELECT id, unnest([{', '.join(f'CASE WHEN NOT coalesce({ok}, FALSE) THEN {chr(39)}{name}{chr(39)} END' for name, ok in _CHECKED.items())}]) AS error FROM bm) SELECT id, error FROM e WHERE error IS NOT NULL UNION ALL SELECT id, 'duplicate_id' FROM sufficiency_benchmark WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "answer_checks": f"""WITH {LOG}, r AS (SELECT question_id AS qid, unnest(['b0', 'b1', 'e1']) AS system, unnest([b0_answer, b1_answer, e1_answer]) AS answer, unnest([b0_status, b1_status, e1_status]) AS status, unnest([b0_latency_ms, b1_latency_ms, e1_latency_ms]) AS latency FROM l),
        e AS (SELECT qid, system, unnest([CASE WHEN answer IS NULL THEN 'no_text' END, CASE WHEN NOT coalesce(status IN ('answered', 'partial', 'unanswerable'), FALSE) THEN 'bad_status' END, CASE WHEN NOT coalesce(status <> 'answered' OR coalesce(regexp_matches(answer, '[\\p{{L}}\\p{{N}}]'), FALSE), FALSE) THEN 'answered_without_words' END,
            CASE WHEN NOT coalesce(latency >= 0, FALSE) THEN 'no_latency' END]) AS error FROM r) SELECT qid, system, error FROM e WHERE error IS NOT NULL""",
}
