"""Is the evidence sufficient? Facts, snippets, claims and citations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators import planning

SUPPORT = 0.6


def support(facts: DataFrame, snippets: DataFrame) -> DataFrame:
    """(qid, fact_no, sid) of each snippet that holds all required terms of a fact.

    ``facts``: qid, fact_no, description, and perhaps terms array<string> and corpora array<string> (null: anywhere); without terms the tokens of the
    description are required. ``snippets``: qid, sid, text, corpus_id. Terms are sought as parts of the text in lower case; a
    fact without terms is supported by every snippet.
    """
    terms = F.col("terms") if "terms" in facts.columns else T.meaningful(F.col("description"))
    corpora = F.col("corpora") if "corpora" in facts.columns else F.lit(None).cast("array<string>")
    f = facts.select("qid", "fact_no", terms.alias("terms"), corpora.alias("corpora"))
    s = snippets.select("qid", "sid", F.lower(F.coalesce("text", F.lit(""))).alias("t"), "corpus_id")
    held = F.forall("terms", lambda x: F.contains(F.col("t"), F.lower(x)))
    return f.join(s, "qid").where((F.col("corpora").isNull() | F.array_contains("corpora", F.col("corpus_id"))) & held).select("qid", "fact_no", "sid")


def conflicts(snippets: DataFrame) -> DataFrame:
    """qid, term, sids: numbers on which the snippets of a question differ (two or more different ones)."""
    rows = snippets.select("qid", "sid", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), F.lit(0)))).alias("term"))
    groups = rows.groupBy("qid", "term").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("sids"))
    several = groups.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
    return groups.join(several, "qid", "left_semi")


def fact_conflicts(facts: DataFrame, snippets: DataFrame) -> DataFrame:
    """qid, fact_no, term, sids: values of a fact on which the snippets that support it differ (two or more values are found).

    ``facts``: as for ``support``, with ``conflict_terms`` array<string>, values that exclude each other; null or empty ones
    conflict with nothing. A value is found where its text occurs, in lower case.
    """
    held = support(facts, snippets).join(snippets.select("qid", "sid", F.lower(F.coalesce("text", F.lit(""))).alias("t")), ["qid", "sid"])
    terms = facts.select("qid", "fact_no", F.explode(F.array_distinct(F.transform("conflict_terms", F.lower))).alias("term"))
    groups = held.join(terms, ["qid", "fact_no"]).where(F.contains("t", "term")).groupBy("qid", "fact_no", "term").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("sids"))
    several = groups.groupBy("qid", "fact_no").agg(F.count("*").alias("n")).where("n > 1").select("qid", "fact_no")
    return groups.join(several, ["qid", "fact_no"], "left_semi")


def unsupported(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """(qid, claim_no) of claims that cite nothing or a snippet that is not there. ``claims``: qid, claim_no, sids array<string>."""
    cited = claims.select("qid", "claim_no", F.explode_outer("sids").alias("sid"))
    return cited.join(snippets.select("qid", "sid").distinct(), ["qid", "sid"], "left_anti").select("qid", "claim_no").distinct()


def known_citations(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """Claims with the citations that exist; those left with none are dropped. ``dropped``: how many of a question's claims were."""
    cited = claims.select("qid", "claim_no", F.explode_outer("sids").alias("sid"))
    kept = cited.join(snippets.select("qid", "sid").distinct(), ["qid", "sid"], "left_semi").groupBy("qid", "claim_no").agg(F.array_join(F.array_sort(F.collect_set("sid")), ",").alias("sids"))
    all_claims = claims.groupBy("qid").agg(F.count("*").alias("all"))
    held = kept.groupBy("qid").agg(F.count("*").alias("held"))
    return kept.join(all_claims.join(held, "qid").select("qid", (F.col("all") - F.col("held")).alias("dropped")), "qid")


def assess(facts: DataFrame, snippets: DataFrame, claims: DataFrame, by_fact: bool = False) -> DataFrame:
    """qid, facts, covered, conflicts, unsupported, score, label: one row a question with facts.

    Conflicts are numbers on which any snippets of the question differ, or with ``by_fact`` the facts whose ``conflict_terms`` the
    snippets that support them differ on (see ``fact_conflicts``; without such a column there are none).
    The first that holds: conflicting; sufficient (no fact open and no claim unsupported); unanswerable (facts open and no
    snippet); useful_but_incomplete (some fact covered, none of the claims unsupported); insufficient.
    """
    total = facts.groupBy("qid").agg(F.count("*").alias("facts"))
    covered = support(facts, snippets).select("qid", "fact_no").distinct().groupBy("qid").agg(F.count("*").alias("covered"))
    if not by_fact:
        clash = conflicts(snippets).groupBy("qid").agg(F.count("*").alias("conflicts"))
    elif "conflict_terms" in facts.columns:
        clash = fact_conflicts(facts, snippets).groupBy("qid").agg(F.count_distinct("fact_no").alias("conflicts"))
    else:
        clash = total.select("qid", F.lit(0).cast("long").alias("conflicts"))
    loose = unsupported(claims, snippets).groupBy("qid").agg(F.count("*").alias("unsupported"))
    seen = snippets.groupBy("qid").agg(F.count("*").alias("snippets"))
    rows = total.join(covered, "qid", "left").join(clash, "qid", "left").join(loose, "qid", "left").join(seen, "qid", "left").na.fill(0, ["covered", "conflicts", "unsupported", "snippets"])
    open_facts, share = F.col("covered") < F.col("facts"), F.least(F.col("covered") / F.col("facts"), F.lit(1.0))
    label = (
        F.when(F.col("conflicts") > 0, "conflicting")
        .when(~open_facts & (F.col("unsupported") == 0), "sufficient")
        .when(open_facts & (F.col("snippets") == 0), "unanswerable")
        .when(open_facts & (F.col("covered") > 0) & (F.col("unsupported") == 0), "useful_but_incomplete")
        .otherwise("insufficient")
    )
    rows = rows.withColumn("label", label)
    score = F.when(F.col("label").isin("sufficient", "useful_but_incomplete"), share).when(F.col("label") == "unanswerable", 0.0).otherwise(F.least(share, F.lit(0.5)))
    return rows.select("qid", "facts", "covered", "conflicts", "unsupported", score.alias("score"), "label")


def answer_status(label: Column) -> Column:
    return F.when(label == "sufficient", "answered").when(label.isin("useful_but_incomplete", "conflicting"), "partial").otherwise("unanswerable")


def claim_support(claims: DataFrame, snippets: DataFrame) -> DataFrame:
    """qid, claim_no, support: the share of a claim's tokens of three characters or more that the texts it cites contain.

    ``claims``: qid, claim_no, text, sids. Repeated tokens count each time; a claim without such tokens has 1, one whose citations
    do not exist 0.
    """
    cited = claims.select("qid", "claim_no", F.explode("sids").alias("sid")).join(snippets.select("qid", "sid", "text"), ["qid", "sid"])
    texts = cited.groupBy("qid", "claim_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sid", "text"))), lambda x: F.lower(x["text"])), " ").alias("cited"))
    tokens = F.filter(T.ascii_tokens(F.col("text")), lambda t: F.length(t) > 2)
    rows = claims.select("qid", "claim_no", tokens.alias("tokens")).join(texts, ["qid", "claim_no"], "left")
    share = F.size(F.filter("tokens", lambda t: F.contains(F.col("cited"), t))) / F.size("tokens")
    return rows.select("qid", "claim_no", F.when(F.col("cited").isNull(), 0.0).when(F.size("tokens") == 0, 1.0).otherwise(share).alias("support"))


def feedback(facts: DataFrame, supported: DataFrame) -> DataFrame:
    """qid, fact_no, query: what to ask for each fact without support."""
    return facts.join(supported.select("qid", "fact_no").distinct(), ["qid", "fact_no"], "left_anti").select("qid", "fact_no", planning.feedback_query(F.col("description")).alias("query"))


def closest_fact(queries: DataFrame, facts: DataFrame) -> DataFrame:
    """qid, query, fact_no: the fact of the question that shares most of a query's tokens, the first of several."""
    rows = queries.select("qid", "query").join(facts, "qid")
    q = F.array_distinct(T.ascii_tokens(F.col("query")))
    score = F.when(F.size(q) > 0, F.size(F.array_intersect(q, F.array_distinct(T.ascii_tokens(F.col("description"))))) / F.size(q)).otherwise(0.0)
    order = Window.partitionBy("qid", "query").orderBy(F.round(score, 9).desc(), "fact_no")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select("qid", "query", "fact_no")
