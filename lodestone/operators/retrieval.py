"""Ranked retrieval for whole batches of questions.

Questions are a DataFrame (qid, question). Ties go to the smaller id, on scores rounded to nine digits. Texts are joined on
terms, scores pre-aggregated, and cuts to the best k are windows by question, which Spark limits before the shuffle.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import index
from lodestone.operators.batches import slices
from lodestone.session import materialise, small_enough

K1, B, RRF = 1.5, 0.75, 60
#: Query terms up to this number of rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Query vectors compared in one pass.
BLOCK = 8_192
#: A block of questions that goes to every task has about so many different wordings, or terms, at most.
BATCH_QUESTIONS, BATCH_TERMS = 2_048, 8_192
_TOKEN = re.compile(T.ASCII)


def best(rows: DataFrame, k: int, *ties: str, by: str = "qid", score: str = "score") -> DataFrame:
    """The ``k`` best rows of each ``by`` with their rank from 1."""
    order = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), *ties)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _query_side(terms: DataFrame) -> DataFrame:
    return F.broadcast(terms) if small_enough(terms, BROADCAST_ROWS) else terms


def _best_of_batches(batches, shared, avgdl: float, k: int):
    """The ``k`` best chunks of each slice for every question; those of all slices hold the best of all."""
    place, weights = shared.value  # term -> row, (terms, questions)
    for batch in slices(batches):
        keys = np.array(batch.column("chunk_id").to_pylist(), dtype=object)
        order = np.argsort(keys, kind="stable")
        tokens = [[t for t in _TOKEN.findall((x or "").lower()) if len(t) > 1] for x in batch.column("text").to_pylist()]
        tf = np.zeros((len(keys), len(place)))
        for row, i in enumerate(order.tolist()):
            at = [place[t] for t in tokens[i] if t in place]
            np.add.at(tf[row], at, 1)
        damp = K1 * (1 - B + B * np.array([len(tokens[i]) for i in order]) / avgdl)
        scores = (tf * (K1 + 1) / (tf + damp[:, None])) @ weights
        top = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k]
        who, flat = np.tile(np.arange(weights.shape[1]), len(top)), top.ravel()
        hit = scores[flat, who] > 0
        who, flat = who[hit], flat[hit]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(keys[order][flat].tolist(), pa.string()), pa.array(scores[flat, who])], ["query", "chunk_id", "score"])


def bm25(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """qid, chunk_id, score, rank of the ``k`` best chunks; a repeated query token counts each time.

    ``chunks``: chunk_id (once each), text. Questions that share no term with any chunk have no row; null texts are empty.
    Questions are taken in blocks, which are scored within each batch of chunks, so that nearly all (question, chunk) pairs,
    which common words make, never leave their task. Statistics of the terms are computed once.
    """
    questions, chunks = questions.select("qid", "question"), chunks.select("chunk_id", "text")
    # each distinct wording is scored once
    wordings = questions.groupBy("question").agg(F.min("qid").alias("first"))
    query = wordings.select("first", F.explode(T.index_tokens(F.col("question"))).alias("term")).groupBy("first", "term").agg(F.count("*").alias("qtf"))
    n, avgdl = index.collection(chunks).first()
    df = chunks.select(F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).join(_query_side(query.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    weighted = query.join(df, "term").select("first", "term", (F.col("qtf") * idf).alias("weight"))
    kind = questions.schema["qid"].dataType.simpleString()

    def scored(part, number):
        rows = part.collect()  # of bounded size
        if not rows:
            return None
        terms, names = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}, sorted({r["first"] for r in rows})
        at, weights = {q: i for i, q in enumerate(names)}, np.zeros((len(terms), len(names)))
        for r in rows:
            weights[terms[r.term], at[r["first"]]] = r.weight
        shared = chunks.sparkSession.sparkContext.broadcast((terms, weights))
        found = chunks.mapInArrow(partial(_best_of_batches, shared=shared, avgdl=float(avgdl or 1), k=k), "query long, chunk_id string, score double")
        return _named(best(found, k, "chunk_id", by="query"), at, kind)

    ranked = _in_blocks(weighted, scored)
    if ranked is None:
        ranked = chunks.sparkSession.createDataFrame([], f"first {kind}, chunk_id string, score double, rank long")
    return questions.join(wordings, "question").select("qid", "first").join(ranked, "first").select("qid", "chunk_id", "score", "rank")


def _named(ranked: DataFrame, at: dict, kind: str) -> DataFrame:
    named = ranked.sparkSession.createDataFrame([(i, q) for q, i in at.items()], f"query long, first {kind}")
    return ranked.join(F.broadcast(named), "query").drop("query")  # a row a question of the block


def _in_blocks(rows: DataFrame, scored) -> DataFrame | None:
    """All that ``scored`` makes of the blocks of ``rows`` (first, term, ...), each of whole questions; none where there are no rows.

    Results of several blocks are written one after another, so that only one block is on its way at a time.
    """
    rows = materialise(rows, "terms")
    terms, wordings = rows.agg(F.count("*"), F.count_distinct("first")).first()
    blocks = max(-(-terms // max(1, BATCH_TERMS)), -(-wordings // max(1, BATCH_QUESTIONS)))
    if blocks <= 1:
        return scored(rows, 0)
    found = None
    for b in range(min(blocks, wordings)):
        block = scored(rows.where(F.pmod(F.xxhash64("first"), F.lit(min(blocks, wordings))) == b), b)
        if block is not None:
            block = materialise(block, "ranked")
            found = block if found is None else found.unionByName(block)
    return found


def _nearest(batches, queries, key: str, k: int):
    """The ``k`` best rows of a batch for each query; those of all batches hold the best of all."""
    ids, matrix = queries.value
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.array(batch.column(key).to_pylist(), dtype=object)
        order = np.argsort(keys, kind="stable")
        rows = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)[order]).astype(np.float64)
        keys = keys[order]
        scores = np.round(matrix @ rows.T, 12)
        top = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
        who = np.repeat(np.arange(len(ids)), top.shape[1])
        flat = top.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(who, pa.int64()), pa.array(keys[flat].tolist(), batch.column(key).type), pa.array(scores[who, flat])], ["query", key, "score"]
        )


def nearest(queries: DataFrame, rows: DataFrame, key: str = "chunk_id", kind: str = "string", k: int = 20, block: int = BLOCK) -> DataFrame:
    """qid, key, score, rank by inner product of ``vector``: each query against all rows, in blocks of queries.

    A block of at most ``block`` query vectors goes to every task; blocks are taken one after another, and each row batch
    passes on its best ``k`` only. Exact. Zero vectors score nothing against all.
    """
    spark, found = rows.sparkSession, None
    numbered = materialise(queries.select("qid", "vector").withColumn("slot", F.monotonically_increasing_id()), "queries")
    total = numbered.count()
    blocks = max(1, -(-total // block))
    rows = rows.select(key, "vector")
    for b in range(blocks):
        part = numbered.where(F.pmod(F.xxhash64("slot"), F.lit(blocks)) == b).select("qid", "vector").collect() if blocks > 1 else numbered.select("qid", "vector").collect()
        if not part:
            continue
        ids = [r.qid for r in part]
        shared = spark.sparkContext.broadcast((ids, np.array([r.vector for r in part], dtype=np.float64)))
        names = spark.createDataFrame([(i, q) for i, q in enumerate(ids)], f"query long, qid {queries.schema['qid'].dataType.simpleString()}")
        hits = rows.mapInArrow(lambda batches, s=shared: _nearest(batches, s, key, k), f"query long, {key} {kind}, score double")
        ranked = best(hits, k, key, by="query").join(F.broadcast(names), "query").select("qid", key, "score", "rank")
        found = ranked if found is None else found.unionByName(ranked)
    return found if found is not None else spark.createDataFrame([], f"qid {queries.schema['qid'].dataType.simpleString()}, {key} {kind}, score double, rank long")


def dense(questions: DataFrame, chunks: DataFrame, k: int = 20) -> DataFrame:
    """qid, chunk_id, score, rank by the hashed vectors of questions and chunks."""
    queries = index.embedded(questions.select(F.col("qid").cast("string").alias("qid"), F.col("question").alias("text")), "qid")
    return nearest(queries, index.embedded(chunks), k=k)


def fuse(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reciprocal rank fusion: qid, chunk_id, score, a_rank, b_rank, rank. Ties go by the first list's rank, then the second's."""
    empty = F.lit(None).cast("long")
    both = first.select("qid", "chunk_id", F.col("rank").alias("a_rank"), empty.alias("b_rank")).unionByName(second.select("qid", "chunk_id", empty.alias("a_rank"), F.col("rank").alias("b_rank")))
    merged = both.groupBy("qid", "chunk_id").agg(F.max("a_rank").alias("a_rank"), F.max("b_rank").alias("b_rank"))
    part = lambda c: F.coalesce(1 / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    merged = merged.withColumn("score", part("a_rank") + part("b_rank"))
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("a_rank").asc_nulls_last(), F.col("b_rank").asc_nulls_last())
    return merged.withColumn("rank", F.row_number().over(order).cast("long"))


def rerank(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 6) -> DataFrame:
    """qid, chunk_id, score, rank: share of the question's tokens, the whole question as a phrase, and tokens early in the text.

    ``candidates``: qid, chunk_id, rank. Ties keep the candidates' order; chunks that are not known are left out.
    """
    rows = candidates.select("qid", "chunk_id", F.col("rank").alias("before")).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions.select("qid", "question"), "qid")
    q, c = T.ascii_tokens(F.col("question")), T.ascii_tokens(F.col("text"))
    rows = rows.select("qid", "chunk_id", "before", F.array_distinct(q).alias("q"), c.alias("c"), F.lower(F.coalesce("text", F.lit(""))).alias("t"), F.lower(F.trim(F.coalesce("question", F.lit("")))).alias("p"))
    share = F.when(F.size("q") > 0, F.size(F.array_intersect("q", "c")) / F.size("q")).otherwise(0.0)
    early = F.size(F.filter(F.slice("c", 1, 100), lambda t: F.array_contains("q", t))) * F.lit(0.05)
    scored = rows.select("qid", "chunk_id", "before", (share * 3 + F.when(F.contains("t", "p"), 2.0).otherwise(0.0) + early).alias("score"))
    return best(scored, k, "before").select("qid", "chunk_id", "score", "rank")


def hybrid(questions: DataFrame, chunks: DataFrame, first: int = 20, candidates: int = 15, k: int = 6) -> DataFrame:
    """The ``k`` best chunks after dense and term search, fusion and reranking."""
    fused = fuse(dense(questions, chunks, first), bm25(questions, chunks, first)).where(F.col("rank") <= candidates)
    return rerank(fused, questions, chunks, k)


def _stem(word: str) -> str:
    return next((word[: -len(x)] for x in T.SUFFIXES if word.endswith(x) and len(word) > len(x) + 2), word)


def _lexical_batches(batches, shared, stemmed: bool, ratio: bool, phrase: bool, k: int):
    """The ``k`` best documents of each slice for every query."""
    place, weights, sizes, wordings, corpora, allowed = shared.value
    for batch in slices(batches):
        docs, homes, texts = (batch.column(c).to_pylist() for c in ("doc_id", "corpus_id", "text"))
        order = sorted((i for i in range(len(docs)) if homes[i] in corpora), key=lambda i: (homes[i], docs[i]))
        if not order:
            continue
        held = np.zeros((len(order), len(place)))
        for row, i in enumerate(order):
            tokens = set(_TOKEN.findall((texts[i] or "").lower()))
            held[row, [place[t] for t in ({_stem(t) for t in tokens} if stemmed else tokens) if t in place]] = 1
        overlap = held @ weights
        overlap[~allowed[[corpora[homes[i]] for i in order]]] = 0
        scores = overlap / sizes if ratio else overlap.copy()
        if phrase:
            # a text with the whole query has all its tokens but perhaps the outer two
            for row, q in zip(*np.nonzero((overlap > 0) & (overlap >= sizes - 2))):
                if wordings[q] in (texts[order[row]] or "").lower():
                    scores[row, q] += 2
        top = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k]
        who, flat = np.tile(np.arange(weights.shape[1]), len(top)), top.ravel()
        hit = overlap[flat, who] > 0
        who, flat = who[hit], flat[hit]
        rows = [order[i] for i in flat.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([homes[i] for i in rows], pa.string()), pa.array([docs[i] for i in rows], pa.int64()), pa.array(scores[flat, who])], ["query", "corpus_id", "doc_id", "score"])


def lexical(queries: DataFrame, documents: DataFrame, stemmed: bool = True, ratio: bool = False, phrase: bool = True, k: int = 5) -> DataFrame:
    """qid, corpus_id, doc_id, score, rank of documents in the corpora to which a query is routed.

    ``queries``: qid, query, corpora array<string>. ``documents``: doc_id, corpus_id, text (ids once each). The score is the number of query
    tokens (or their stems) in the document, as a share with ``ratio``; with ``phrase``, two more where the whole query stands
    in the text. Ties go by corpus and document. Queries without tokens and documents without a common token have no row.
    """
    queries, documents = queries.select("qid", "query", "corpora"), documents.select("doc_id", "corpus_id", "text")
    cut = T.stems if stemmed else (lambda x: F.array_distinct(T.ascii_tokens(x)))
    wordings = queries.groupBy("query", F.array_sort("corpora").alias("corpora")).agg(F.min("qid").alias("first"))
    terms = wordings.select("first", "corpora", "query", F.explode(cut(F.col("query"))).alias("term"))
    kind, schema = queries.schema["qid"].dataType.simpleString(), "query long, corpus_id string, doc_id long, score double"

    def scored(part, number):
        rows = part.groupBy("first", "corpora", "query").agg(F.collect_set("term").alias("terms")).collect()  # of bounded size
        if not rows:
            return None
        words = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
        homes = {c: i for i, c in enumerate(sorted({c for r in rows for c in r.corpora or ()}))}
        weights, allowed = np.zeros((len(words), len(rows))), np.zeros((len(homes), len(rows)), bool)
        for j, r in enumerate(rows):
            weights[[words[t] for t in r.terms], j] = 1
            allowed[[homes[c] for c in r.corpora or ()], j] = True
        shared = documents.sparkSession.sparkContext.broadcast((words, weights, np.array([float(len(r.terms)) for r in rows]), [(r["query"] or "").strip().lower() for r in rows], homes, allowed))
        found = documents.where("corpus_id is not null").mapInArrow(partial(_lexical_batches, shared=shared, stemmed=stemmed, ratio=ratio, phrase=phrase, k=k), schema)
        return _named(best(found, k, "corpus_id", "doc_id", by="query"), {r["first"]: j for j, r in enumerate(rows)}, kind)

    ranked = _in_blocks(terms, scored)
    if ranked is None:
        ranked = documents.sparkSession.createDataFrame([], f"first {kind}, corpus_id string, doc_id long, score double, rank long")
    back = queries.select("qid", "query", F.array_sort("corpora").alias("corpora")).join(wordings, ["query", "corpora"]).select("qid", "first")
    return back.join(ranked, "first").select("qid", "corpus_id", "doc_id", "score", "rank")


def _span(text: str, query: str, terms: set[str]) -> tuple[int, int] | None:
    """Where the whole query stands in a text, else from the first to the last token that shares a stem with it."""
    at = text.lower().find(query) if query else -1
    if at >= 0:
        return at, at + len(query)
    places = [m.span() for m in _TOKEN.finditer(text.lower()) if _stem(m.group()) in terms]
    return (places[0][0], places[-1][1]) if places else None


def _spans(batches):
    for batch in slices(batches):
        start, end = [], []
        for text, query in zip(batch.column("text").to_pylist(), batch.column("query").to_pylist()):
            found = _span(text or "", (query or "").strip().lower(), {_stem(t) for t in _TOKEN.findall((query or "").lower())})
            start.append(found[0] if found else None)
            end.append(found[1] if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("doc_id"), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["qid", "doc_id", "start", "end"])


def spans(hits: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """qid, doc_id, start, end (characters, end excluded) of what each hit matched; null where nothing does.

    ``hits``: qid string, doc_id long; ``queries``: qid, query; ``documents``: doc_id, text. Hits of unknown queries or documents are left out.
    """
    rows = hits.select("qid", "doc_id").join(queries.select("qid", "query"), "qid").join(documents.select("doc_id", "text"), "doc_id")
    return rows.select("qid", "doc_id", "query", "text").mapInArrow(_spans, "qid string, doc_id long, start long, end long")


def relevance(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: queries, recall_5, recall_10 and mrr of ``ranked`` (qid, item, rank) against ``targets`` (qid, item).

    A query with no target among its items counts as zero; without queries all are zero.
    """
    hits = targets.select("qid", "item").distinct().join(ranked.select("qid", "item", "rank"), ["qid", "item"], "left")
    each = hits.groupBy("qid").agg(F.count("*").alias("all"), F.count_if(F.col("rank") <= 5).alias("five"), F.count_if(F.col("rank") <= 10).alias("ten"), F.min("rank").alias("first"))
    mean = lambda x, name: F.round(F.coalesce(F.avg(x), F.lit(0.0)), 4).alias(name)
    return each.agg(F.count("*").alias("queries"), mean(F.col("five") / F.col("all"), "recall_5"), mean(F.col("ten") / F.col("all"), "recall_10"), mean(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"))
