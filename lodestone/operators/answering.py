"""Answers from ranked evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T


def evidence(ranked: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, question, rank, chunk_id, document_id, text."""
    return ranked.select("qid", "chunk_id", "rank").join(chunks.select("chunk_id", "document_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")


def in_order(*columns: str):
    """The collected rows of a group, in the order of the first columns."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def context(rows: DataFrame) -> DataFrame:
    """qid, context: the evidence of a question as one text with its sources."""
    line = F.concat(F.lit("["), F.col("document_id"), F.lit("]: "), F.coalesce("text", F.lit("")))
    return rows.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_join(F.transform(in_order("rank", "line"), lambda x: x["line"]), "\n\n").alias("context"))


def scored_sentences(rows: DataFrame, question_terms, sentence_terms) -> DataFrame:
    """qid, rank, chunk_id, pos, sentence, overlap for each sentence of the evidence."""
    long = rows.select("qid", "rank", "chunk_id", question_terms(F.col("question")).alias("q"), F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    return long.select("qid", "rank", "chunk_id", "pos", "sentence", F.size(F.array_intersect("q", sentence_terms(F.col("sentence")))).alias("overlap"))


def best_sentences(rows: DataFrame) -> DataFrame:
    """qid, rank, chunk_id, sentence, overlap: of each snippet the sentence with most of the question's stems, the first of several."""
    stops = T.SENTENCE_STOPS
    terms = lambda q: F.array_distinct(F.transform(F.filter(T.ascii_tokens(q), lambda t: (F.length(t) > 2) & ~t.isin(*stops)), T.stem))
    scored = scored_sentences(rows, terms, T.stems)
    order = Window.partitionBy("qid", "chunk_id").orderBy(F.desc("overlap"), "pos")
    return scored.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "rank", "chunk_id", "sentence", F.col("overlap").cast("long").alias("overlap"))


def grounded(rows: DataFrame, sentences: int = 3, confidence: float = 0.9) -> DataFrame:
    """qid, answer, chunk_ids, claims, confidence: the best sentences of the evidence, each with its source.

    Sentences of three words or more, each wording once; where none shares a stem with the question, the first sentence of the
    best chunk. Questions without a sentence have no row.
    """
    terms = lambda q: F.array_distinct(F.transform(F.filter(T.ascii_tokens(q), lambda t: ~t.isin(*T.ANSWER_STOPS)), T.stem))
    scored = scored_sentences(rows, terms, T.stems)
    fit = scored.where((F.size(F.split("sentence", r"\s+")) >= 3) & (F.col("overlap") > 0))
    once = Window.partitionBy("qid", "sentence").orderBy("rank", "pos")
    fit = fit.withColumn("seen", F.row_number().over(once)).where("seen = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("overlap"), "rank", "pos")
    fit = fit.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sentences).select("qid", "place", "sentence", "chunk_id")
    first = scored.where("rank = 1 and pos = 0").join(fit.select("qid").distinct(), "qid", "left_anti").select("qid", F.lit(1).alias("place"), "sentence", "chunk_id")
    out = fit.unionByName(first).groupBy("qid").agg(in_order("place", "sentence", "chunk_id").alias("l"))
    n = F.size("l")
    return out.select(
        "qid", F.array_join(F.transform("l", lambda x: x["sentence"]), " ").alias("answer"), F.array_join(F.transform("l", lambda x: x["chunk_id"]), ",").alias("chunk_ids"),
        n.cast("long").alias("claims"), F.round(F.least(F.lit(0.98), F.greatest(F.lit(0.5), F.lit(confidence) + n * F.lit(0.02))), 6).alias("confidence"),
    )


def claims(rows: DataFrame, longest: int = 180) -> DataFrame:
    """qid, claim_no, chunk_id, claim: one claim a snippet, cut to ``longest`` characters, each wording once."""
    flat = T.squashed(F.col("text"))
    cut = F.when(F.length(flat) > longest, F.concat(F.substring(flat, 1, longest - 3), F.lit("..."))).otherwise(flat)
    once = Window.partitionBy("qid", T.normalised(F.col("text"))).orderBy("rank")
    kept = rows.where(flat != "").withColumn("n", F.row_number().over(once)).where("n = 1")
    order = Window.partitionBy("qid").orderBy("rank")
    return kept.select("qid", F.row_number().over(order).cast("long").alias("claim_no"), "chunk_id", cut.alias("claim"))


def merged(first: DataFrame, more: DataFrame) -> DataFrame:
    """qid, chunk_id, pass, rank, place: both passes' hits, each chunk once, first come first kept."""
    both = first.select("qid", "chunk_id", F.lit(1).cast("long").alias("pass"), "rank").unionByName(more.select("qid", "chunk_id", F.lit(2).cast("long").alias("pass"), "rank"))
    kept = both.groupBy("qid", "chunk_id").agg(F.min(F.struct("pass", "rank")).alias("x")).select("qid", "chunk_id", "x.pass", "x.rank")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("pass", "rank")).cast("long"))


def citation_label(name, page, chunk):
    """``[name, Page p, Chunk id]``; what is null is left out."""
    return F.concat(F.lit("["), F.concat_ws(", ", name, F.concat(F.lit("Page "), page.cast("string")), F.concat(F.lit("Chunk "), chunk)), F.lit("]"))


def paged_context(rows: DataFrame) -> DataFrame:
    """qid, context: the evidence of a question as one text, each piece after ``[name, Page p]: `` (the page is left out where it is null)."""
    source = F.concat_ws(", ", "document_name", F.concat(F.lit("Page "), F.col("page").cast("string")))
    line = F.concat(F.lit("["), source, F.lit("]: "), F.coalesce("text", F.lit("")))
    return rows.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.array_join(F.transform(in_order("rank", "line"), lambda x: x["line"]), "\n\n").alias("context"))


def first_wins(hits: DataFrame) -> DataFrame:
    """``hits`` (qid, place, sid, corpus_id, document_id, text) without repeats, in the order of place.

    A hit is dropped where its id, or its corpus, document and text (in lower case, white space collapsed), were kept before; one that was
    dropped bars nothing after it. So the order decides, and a question's hits (bounded by the search) are gone through as one array.
    """
    digest = F.sha2(T.normalised(F.col("text")), 256)
    key = F.concat_ws("\x1f", F.coalesce("corpus_id", F.lit("")), F.coalesce("document_id", F.lit("")), digest)
    rows = hits.select("qid", "place", "sid", "corpus_id", "document_id", key.alias("key")).groupBy("qid").agg(in_order("place", "sid", "key", "corpus_id", "document_id").alias("l"))
    none = F.slice("l", 1, 0)
    fresh = lambda kept, x: ~F.exists(kept, lambda k: (k["sid"] == x["sid"]) | (k["key"] == x["key"]))
    kept = F.aggregate("l", none, lambda kept, x: F.when(fresh(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return rows.select("qid", F.explode(kept).alias("x")).select("qid", "x.place", "x.sid", "x.corpus_id", "x.document_id")


#: What is said where the evidence does not bear an answer.
NO_ANSWER = "No grounded answer is available from the retrieved context."
CONFLICTING = "Conflicting evidence prevents a definitive grounded answer."
INCOMPLETE = "Partial evidence found; missing facts remain."
INSUFFICIENT = "Insufficient context for a definitive grounded answer."


def guarded(answers: DataFrame, snippets: DataFrame) -> DataFrame:
    """qid, status, answer, claims, dropped: an answer as its evidence allows it.

    ``answers``: qid, answer, answer_status (of the draft), label (as judged), missing (number of facts without support), claims
    (array of struct of claim_no and sids). A sufficient label leaves the answer as it is, with ``answer_status``; a useful
    or conflicting one makes it partial; any other takes answer and citations away. Citations of snippets that are not there
    are left out, and claims without one are dropped; an answer that loses a claim is partial. ``claims``: claim_no and sids of the claims
    left, ``dropped``: how many were lost.
    """
    known = snippets.groupBy("qid").agg(F.collect_set("sid").alias("known"))
    partial = F.col("label").isin("useful_but_incomplete", "conflicting")
    said = (
        F.when(F.col("label") == "sufficient", F.col("answer")).when(F.col("label") == "conflicting", CONFLICTING)
        .when(partial & (F.col("answer_status") == "partial") & (F.col("answer") != ""), F.col("answer")).when(partial & (F.col("missing") > 0), INCOMPLETE).when(partial, INSUFFICIENT).otherwise(NO_ANSWER)
    )
    rows = answers.join(known, "qid", "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))
    rows = rows.withColumn("given", F.when((F.col("label") == "sufficient") | partial, F.col("claims")).otherwise(F.slice("claims", 1, 0)))
    left = F.filter(F.transform("given", lambda c: F.struct(c["claim_no"].alias("claim_no"), F.array_intersect(c["sids"], F.col("known")).alias("sids"))), lambda c: F.size(c["sids"]) > 0)
    rows = rows.withColumn("left", left).withColumn("dropped", (F.size("given") - F.size("left")).cast("long"))
    status = F.when(F.col("dropped") > 0, "partial").when(F.col("label") == "sufficient", F.col("answer_status")).when(partial, "partial").otherwise("unanswerable")
    return rows.select("qid", status.alias("status"), F.coalesce(said, F.lit("")).alias("answer"), F.col("left").alias("claims"), "dropped")
