"""Queries that measure systems and check records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import contracts, judging, metrics, planning, retrieval, structured
from lodestone.plans import sql as S
from lodestone.plans.evidence_queries import LOG, _BASE, _HELD, _ranked, log, snippets
from lodestone.plans.retrieval_queries import asked, questions
from lodestone.plans.text_queries import chunks
from lodestone.tables import table

SYSTEMS = ("b0", "b1", "e1")


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row a question and system."""
    rows = log(spark, folder)
    each = [F.struct(F.lit(s).alias("system"), *[F.col(f"{s}_{c}").alias(c) for c in ("status", "correct", "unsupported", "latency_ms")], (F.col("e1_iterations") if s == "e1" else F.lit(1)).alias("iterations")) for s in SYSTEMS]
    return rows.select("qid", "expected_label", F.explode(F.array(*each)).alias("x")).select("qid", "expected_label", "x.*")


def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Did the judged system answer exactly the questions that can be answered?"""
    rows = log(spark, folder).select((F.col("b1_status") == "answered").alias("predicted"), (F.col("expected_label") == "sufficient").alias("actual"))
    return metrics.binary(rows)


def metrics_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """The same for each system."""
    rows = runs(spark, folder).select("system", (F.col("status") == "answered").alias("predicted"), (F.col("expected_label") == "sufficient").alias("actual"))
    return metrics.binary(rows, "system")


def system_summary(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summary(runs(spark, folder))


def system_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by system and label, by system, and over all."""
    rows = runs(spark, folder)
    sets = rows.groupingSets([[F.col("system"), F.col("expected_label")], [F.col("system")], []], "system", "expected_label")
    return sets.agg(F.count("*").alias("runs"), F.count_if("correct").alias("correct"), F.count_if("unsupported").alias("unsupported"))


def recovery_gain(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that the recovering system newly answers rightly, less those it newly answers without support."""
    newly = F.count_if(F.col("e1_correct") & ~F.col("b1_correct"))
    loose = F.count_if(F.col("e1_unsupported") & ~F.col("b1_unsupported"))
    return log(spark, folder).agg(newly.alias("newly_correct"), loose.alias("newly_unsupported"), (newly - loose).alias("gain"))


def baseline_runs(spark: SparkSession, folder: str) -> DataFrame:
    """What each system did with each question, and how recovery changed it."""
    rows = log(spark, folder)
    outcome = F.when(F.col("b1_correct") & F.col("e1_correct"), "both_correct").when(F.col("e1_correct"), "recovered_correctly").when(F.col("b1_correct"), "regressed").otherwise("both_wrong")
    return rows.select("qid", "b0_status", "b1_status", "e1_status", outcome.alias("outcome"), F.coalesce(F.col("recovery_outcome") == outcome, F.lit(False)).alias("as_logged"))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    sufficiency = F.when(F.col("b1_status") == "answered", 1.0).when(F.col("b1_status") == "partial", 0.5).otherwise(0.0)
    confidence = F.when(F.coalesce("e1_iterations", F.lit(1)) == 1, 0.9).otherwise(0.4)
    return log(spark, folder).select(sufficiency.alias("sufficiency"), confidence.alias("confidence"), F.coalesce("e1_correct", F.lit(False)).alias("correct")).withColumn("p", metrics.probability(F.col("sufficiency"), F.col("confidence")))


def selective_answering(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions are attempted at a threshold of one half, and how many of them rightly."""
    return _records(spark, folder).groupBy((F.col("p") >= 0.5).alias("attempted")).agg(F.count("*").alias("questions"), F.count_if("correct").alias("correct"))


def accuracy_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy_coverage(_records(spark, folder)).select("tau", "attempted", "correct", F.round("coverage", 6).alias("coverage"), F.round("accuracy", 6).alias("accuracy"))


def auacc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.area(metrics.accuracy_coverage(_records(spark, folder)))


def selective_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Weights fitted to the log, and the area they reach."""
    rows = _records(spark, folder)
    w1, w2, b = metrics.fit_selective(rows)
    area = metrics.area(metrics.accuracy_coverage(rows.withColumn("p", metrics.probability(F.col("sufficiency"), F.col("confidence"), w1, w2, b))))
    return area.select(F.lit(round(w1, 6)).alias("w1"), F.lit(round(w2, 6)).alias("w2"), F.lit(round(b, 6)).alias("b"), "auacc")


def label_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return log(spark, folder).groupBy("expected_label", "recovery_outcome").agg(F.count("*").alias("questions"))


def frames_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """By label: mean share of facts that a snippet supports, mean iterations, and questions with all facts covered."""
    facts = planning.plan_facts(asked(spark, folder))
    found = judging.support(facts, snippets(spark, folder)).select("qid", "fact_no").distinct().groupBy("qid").agg(F.count("*").alias("covered"))
    share = facts.groupBy("qid").agg(F.count("*").alias("facts")).join(found, "qid", "left").select("qid", (F.coalesce("covered", F.lit(0)) / F.col("facts")).alias("coverage"))
    rows = log(spark, folder).select("qid", "expected_label", "e1_iterations").join(share, "qid", "left").withColumn("coverage", F.coalesce("coverage", F.lit(1.0)))
    return rows.groupBy("expected_label").agg(F.count("*").alias("questions"), F.round(F.avg("coverage"), 6).alias("fact_coverage"), F.round(F.avg("e1_iterations"), 6).alias("iterations"), F.count_if(F.col("coverage") == 1).alias("passed"))


def fetch_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of each file: how many of the chunks found are its own, and for how many questions."""
    hits = retrieval.bm25(questions(spark, folder), chunks(spark, folder), 6).join(chunks(spark, folder).select("chunk_id", "document_id"), "chunk_id")
    return hits.groupBy("document_id").agg(F.count("*").alias("hits"), F.count_distinct("qid").alias("questions"))


def distractor_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits in corpora of no tier or the lowest, by corpus; corpora without a hit too."""
    corpora = table(spark, folder, "corpora").where("coalesce(metadata['tier'], 'C') = 'C'").select(F.col("id").alias("corpus_id"))
    words = questions(spark, folder).select("qid", F.explode(T.meaningful(F.col("question"))).alias("t")).where("length(t) > 5")
    documents = table(spark, folder, "documents").join(F.broadcast(corpora), "corpus_id", "left_semi")  # a catalogue
    hits = documents.select("corpus_id", "doc_id", F.explode(F.array_distinct(T.ascii_tokens(F.col("text")))).alias("t")).join(words, "t").groupBy("corpus_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("qid").alias("questions"))
    return corpora.join(hits, "corpus_id", "left").na.fill(0)


def validate_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Violations by check over pages, chunks and their references."""
    pages, parts = table(spark, folder, "document_pages"), table(spark, folder, "chunks")
    counts = [
        ("page_delivered_twice", contracts.repeated(pages, "page_id")), ("chunk_delivered_twice", contracts.repeated(parts, "chunk_id")),
        ("chunk_of_unknown_document", contracts.unknown(parts, "document_id", pages, "document_id")), ("empty_page", pages.where("coalesce(trim(text), '') = ''")),
        ("chunk_without_count", parts.where("coalesce(token_count, 0) = 0")), ("chunk_characters_differ", parts.where("char_count is not null and char_count != length(text)")),
        ("document_of_unknown_corpus", contracts.unknown(table(spark, folder, "documents"), "corpus_id", table(spark, folder, "corpora"), "id")),
    ]
    out = None
    for name, rows in counts:
        row = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = row if out is None else out.unionByName(row)
    return out


def validate_records(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each record of the question source."""
    filled = lambda c: F.trim(c) != ""
    checks = {
        "no_question": filled("question"), "no_mark": F.trim("question").endswith("?"), "no_subject": filled("subj"), "no_object": filled("obj"), "no_title": filled("s_wiki_title"),
        "no_answers": filled("possible_answers"), "bad_popularity": (F.col("s_pop") >= 0) & (F.col("o_pop") >= 0), "subject_not_asked": F.contains(F.lower("question"), F.lower("subj")),
    }
    return contracts.errors(table(spark, folder, "popqa_raw_sample").dropDuplicates(["line_no"]), "line_no", checks)


def annotation_template(spark: SparkSession, folder: str) -> DataFrame:
    """Questions to be annotated: the curator's label under its own name, the annotator's fields blank."""
    return log(spark, folder).select("qid", "question", F.col("expected_label").alias("curator_candidate_label"), F.lit("PENDING").alias("gold_label"), F.lit("").alias("annotator_id"), F.lit("").alias("annotation_notes"))


def blinded_subset(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed sample without labels: of each wording the first, second, fifth, seventh and tenth question of every ten."""
    order = Window.partitionBy("question").orderBy("qid")
    rows = log(spark, folder).select("qid", "question", (F.row_number().over(order) - 1).alias("i"))
    return rows.where((F.col("i") % 10).isin(0, 1, 4, 6, 9)).select("qid", "question", F.lit("").alias("human_decision"))


def blinded_benchmark_subset(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed sample of the benchmark without labels, by source: five of every ten questions by first id, with all their variants."""
    rows = table(spark, folder, "sufficiency_benchmark").where("id is not null and source_dataset is not null and original_question is not null").dropDuplicates(["id"])
    firsts = rows.groupBy("source_dataset", "original_question").agg(F.min("id").alias("first"))
    order = Window.partitionBy("source_dataset").orderBy("first")  # the held-out questions, a bounded set
    taken = firsts.withColumn("i", F.row_number().over(order) - 1).where((F.col("i") % 10).isin(0, 1, 4, 6, 9))
    rows = rows.join(taken, ["source_dataset", "original_question"], "left_semi")
    return rows.select("id", "source_dataset", "original_question", "context", F.lit("").alias("human_decision"), F.lit("").alias("human_rationale"))


def parse_structured(spark: SparkSession, folder: str) -> DataFrame:
    """The typed property of each event, by type."""
    rows = table(spark, folder, "events").select("event_type", structured.parsed(F.col("props"), "k long")["k"].alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("parsed"), F.sum("k").alias("total"))


def repair_sufficiency_json(spark: SparkSession, folder: str) -> DataFrame:
    """Records that the log's judgements would give as model output of several qualities, parsed back."""
    rows = log(spark, folder).select("qid", (F.col("b1_status") == "answered").alias("s"), F.pmod(F.xxhash64("qid"), F.lit(4)).alias("kind"))
    s = F.col("s").cast("string")
    raw = (
        F.when(F.col("kind") == 0, F.concat(F.lit('{"sufficient": '), s, F.lit(', "probability": 0.75, "missing_information": [], "rationale": "r"}')))
        .when(F.col("kind") == 1, F.concat(F.lit('Here:\n```json\n{"sufficient": '), s, F.lit(', "probability": 0.75,}\n```')))
        .when(F.col("kind") == 2, F.concat(F.lit("{'sufficient': "), F.initcap(s), F.lit(", 'probability': 0.75}")))
        .otherwise(F.concat(F.lit("sufficient: "), s, F.lit(", probability: 0.75, and so on")))
    )
    got = rows.select("qid", structured.sufficiency(raw).alias("x"))
    return got.select("qid", "x.sufficient", "x.probability")


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Events and values by hour and type."""
    rows = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events", "total")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of each user: events no more than half an hour apart."""
    rows = table(spark, folder, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"), F.max("events").alias("longest"))


_ALL = (
    binary_metrics, metrics_breakdown, system_summary, system_comparison, recovery_gain, baseline_runs, selective_answering, accuracy_coverage, auacc, selective_fit, label_distribution, frames_metrics,
    fetch_coverage, distractor_hits, validate_contracts, validate_records, annotation_template, blinded_subset, blinded_benchmark_subset, parse_structured, repair_sufficiency_json, event_windows, sessions,
)
QUERIES = {f.__name__: f for f in _ALL}

_RUNS = "runs AS (" + " UNION ALL ".join(
    f"SELECT question_id AS qid, expected_label, '{s}' AS system, {s}_status AS status, {s}_correct AS correct, {s}_unsupported AS unsupported, {s}_latency_ms AS latency_ms, {'e1_iterations' if s == 'e1' else '1'} AS iterations FROM l" for s in SYSTEMS
) + ")"


def _binary(rows: str, by: str = "") -> str:
    group, pick = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""m AS (SELECT {pick}count(*) FILTER (p AND a) AS tp, count(*) FILTER (NOT p AND NOT a) AS tn, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn FROM {rows} {group}),
    m2 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS pr, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS re FROM m)
    SELECT {pick}tp, tn, fp, fn, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m2"""


_RECORDS = f"""{LOG}, r AS (SELECT CASE b1_status WHEN 'answered' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0 END AS s, CASE WHEN coalesce(e1_iterations, 1) = 1 THEN 0.9::DOUBLE ELSE 0.4::DOUBLE END AS c, coalesce(e1_correct, FALSE) AS correct FROM l),
    rp AS (SELECT *, 1 / (1 + exp(-(2.5::DOUBLE * s + 1.5::DOUBLE * c - 2.0::DOUBLE))) AS p FROM r)"""
_CURVE = f"""{_RECORDS}, g AS (SELECT unnest(range(0, 51)) / 50.0::DOUBLE AS tau), t AS (SELECT count(*) AS total FROM rp),
    k AS (SELECT tau, count(*) FILTER (p >= tau) AS attempted, count(*) FILTER (p >= tau AND correct) AS correct, any_value(total) AS total FROM g, rp, t GROUP BY tau),
    cu AS (SELECT tau, attempted, correct, attempted / total::DOUBLE AS coverage, coalesce(correct / nullif(attempted, 0)::DOUBLE, 1) AS accuracy FROM k)"""

SQL = {
    "binary_metrics": f"WITH {LOG}, b AS (SELECT b1_status = 'answered' AS p, expected_label = 'sufficient' AS a FROM l), {_binary('b')}",
    "metrics_breakdown": f"WITH {LOG}, {_RUNS}, b AS (SELECT system, status = 'answered' AS p, expected_label = 'sufficient' AS a FROM runs), {_binary('b', 'system')}",
    "system_summary": f"""WITH {LOG}, {_RUNS} SELECT system, count(*) AS questions, count(*) FILTER (correct) AS correct, round(count(*) FILTER (correct) / count(*)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (unsupported) / count(*)::DOUBLE, 6) AS unsupported_rate,
        round(count(*) FILTER (status = 'unanswerable') / count(*)::DOUBLE, 6) AS abstention_rate, round(avg(iterations), 6) AS mean_iterations, round(avg(latency_ms), 6) AS mean_latency, round(quantile_cont(latency_ms, 0.5), 6) AS median_latency FROM runs GROUP BY system""",
    "system_comparison": f"WITH {LOG}, {_RUNS} SELECT system, expected_label, count(*) AS runs, count(*) FILTER (correct) AS correct, count(*) FILTER (unsupported) AS unsupported FROM runs GROUP BY GROUPING SETS ((system, expected_label), (system), ())",
    "recovery_gain": f"WITH {LOG}, k AS (SELECT count(*) FILTER (e1_correct AND NOT b1_correct) AS newly_correct, count(*) FILTER (e1_unsupported AND NOT b1_unsupported) AS newly_unsupported FROM l) SELECT *, newly_correct - newly_unsupported AS gain FROM k",
    "baseline_runs": f"""WITH {LOG}, k AS (SELECT question_id AS qid, b0_status, b1_status, e1_status, recovery_outcome, CASE WHEN b1_correct AND e1_correct THEN 'both_correct' WHEN e1_correct THEN 'recovered_correctly' WHEN b1_correct THEN 'regressed' ELSE 'both_wrong' END AS outcome FROM l)
        SELECT qid, b0_status, b1_status, e1_status, outcome, coalesce(recovery_outcome = outcome, FALSE) AS as_logged FROM k""",
    "selective_answering": f"WITH {_RECORDS} SELECT p >= 0.5::DOUBLE AS attempted, count(*) AS questions, count(*) FILTER (correct) AS correct FROM rp GROUP BY ALL",
    "accuracy_coverage": f"WITH {_CURVE} SELECT tau, attempted, correct, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM cu",
    "auacc": f"""WITH {_CURVE}, st AS (SELECT *, lead(coverage) OVER (ORDER BY coverage, tau) AS nc, lead(accuracy) OVER (ORDER BY coverage, tau) AS na FROM cu)
        SELECT round(coalesce(sum((accuracy + na) / 2 * (nc - coverage)), 0), 6) AS auacc, round(coalesce(max(CASE WHEN accuracy >= 0.9::DOUBLE THEN coverage END), 0), 6) AS coverage_90, round(coalesce(max(CASE WHEN accuracy >= 0.95::DOUBLE THEN coverage END), 0), 6) AS coverage_95,
        round(max(CASE WHEN tau = 0.5::DOUBLE THEN accuracy END) - max(CASE WHEN tau = 0 THEN accuracy END), 6) AS rejection_quality FROM st""",
    "label_distribution": f"WITH {LOG} SELECT expected_label, recovery_outcome, count(*) AS questions FROM l GROUP BY ALL",
    "frames_metrics": f"""WITH {_BASE}, {_HELD}, k AS (SELECT f.qid, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.qid = f.qid AND h.fact_no = f.fact_no)) / count(*)::DOUBLE AS coverage FROM facts f GROUP BY f.qid),
        r AS (SELECT expected_label, e1_iterations, coalesce(coverage, 1) AS coverage FROM l LEFT JOIN k ON k.qid = l.question_id) SELECT expected_label, count(*) AS questions, round(avg(coverage), 6) AS fact_coverage, round(avg(e1_iterations), 6) AS iterations, count(*) FILTER (coverage = 1) AS passed FROM r GROUP BY expected_label""",
    "fetch_coverage": f"WITH {_ranked(6)} SELECT document_id, count(*) AS hits, count(DISTINCT qid) AS questions FROM e GROUP BY document_id",
    "distractor_hits": f"""WITH k AS (SELECT id AS corpus_id FROM corpora WHERE coalesce(map_extract(metadata, 'tier')[1], 'C') = 'C'), w AS (SELECT DISTINCT id AS qid, unnest({S.without('original_question', T.PLAN_STOPS)}) AS t FROM sufficiency_benchmark),
        d AS (SELECT DISTINCT corpus_id, doc_id, unnest({S.ascii_tokens('text')}) AS t FROM documents WHERE corpus_id IN (SELECT corpus_id FROM k)), h AS (SELECT corpus_id, count(DISTINCT doc_id) AS documents, count(DISTINCT qid) AS questions FROM d JOIN w USING (t) WHERE length(t) > 5 GROUP BY corpus_id)
        SELECT corpus_id, coalesce(documents, 0) AS documents, coalesce(questions, 0) AS questions FROM k LEFT JOIN h USING (corpus_id)""",
    "validate_contracts": """SELECT 'page_delivered_twice' AS "check", count(*) AS violations FROM (SELECT page_id FROM document_pages GROUP BY page_id HAVING count(*) > 1) UNION ALL SELECT 'chunk_delivered_twice', count(*) FROM (SELECT chunk_id FROM chunks GROUP BY chunk_id HAVING count(*) > 1)
        UNION ALL SELECT 'chunk_of_unknown_document', count(*) FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT document_id FROM document_pages WHERE document_id IS NOT NULL) UNION ALL SELECT 'empty_page', count(*) FROM document_pages WHERE coalesce(trim(text), '') = ''
        UNION ALL SELECT 'chunk_without_count', count(*) FROM chunks WHERE coalesce(token_count, 0) = 0 UNION ALL SELECT 'chunk_characters_differ', count(*) FROM chunks WHERE char_count IS NOT NULL AND char_count <> length(text)
        UNION ALL SELECT 'document_of_unknown_corpus', count(*) FROM documents WHERE corpus_id IS NOT NULL AND corpus_id NOT IN (SELECT id FROM corpora)""",
    "validate_records": """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY line_no) AS copy FROM popqa_raw_sample) WHERE copy = 1), e AS (SELECT line_no, unnest([
        CASE WHEN NOT coalesce(trim(question) <> '', FALSE) THEN 'no_question' END, CASE WHEN NOT coalesce(ends_with(trim(question), '?'), FALSE) THEN 'no_mark' END, CASE WHEN NOT coalesce(trim(subj) <> '', FALSE) THEN 'no_subject' END, CASE WHEN NOT coalesce(trim(obj) <> '', FALSE) THEN 'no_object' END,
        CASE WHEN NOT coalesce(trim(s_wiki_title) <> '', FALSE) THEN 'no_title' END, CASE WHEN NOT coalesce(trim(possible_answers) <> '', FALSE) THEN 'no_answers' END, CASE WHEN NOT coalesce(s_pop >= 0 AND o_pop >= 0, FALSE) THEN 'bad_popularity' END,
        CASE WHEN NOT coalesce(contains(lower(question), lower(subj)), FALSE) THEN 'subject_not_asked' END]) AS error FROM p) SELECT line_no, error FROM e WHERE error IS NOT NULL""",
    "annotation_template": f"WITH {LOG} SELECT question_id AS qid, question, expected_label AS curator_candidate_label, 'PENDING' AS gold_label, '' AS annotator_id, '' AS annotation_notes FROM l",
    "blinded_subset": f"WITH {LOG}, k AS (SELECT question_id AS qid, question, row_number() OVER (PARTITION BY question ORDER BY question_id) - 1 AS i FROM l) SELECT qid, question, '' AS human_decision FROM k WHERE i % 10 IN (0, 1, 4, 6, 9)",
    "blinded_benchmark_subset": """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id) AS copy FROM sufficiency_benchmark WHERE id IS NOT NULL AND source_dataset IS NOT NULL AND original_question IS NOT NULL) WHERE copy = 1),
        k AS (SELECT source_dataset, original_question, row_number() OVER (PARTITION BY source_dataset ORDER BY min(id)) - 1 AS i FROM r GROUP BY source_dataset, original_question)
        SELECT id, source_dataset, original_question, context, '' AS human_decision, '' AS human_rationale FROM r JOIN (SELECT source_dataset, original_question FROM k WHERE i % 10 IN (0, 1, 4, 6, 9)) USING (source_dataset, original_question)""",
    "parse_structured": "SELECT event_type, count(*) AS events, count(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS parsed, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "repair_sufficiency_json": f"WITH {LOG} SELECT question_id AS qid, b1_status = 'answered' AS sufficient, 0.75::DOUBLE AS probability FROM l",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g),
        k AS (SELECT user_id, n, count(*) AS events FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, CAST(sum(events) AS BIGINT) AS events, max(events) AS longest FROM k GROUP BY user_id""",
}
