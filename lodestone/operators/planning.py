"""Questions into facts, routes and queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T

_AND = r"(?i)\b(?:and|also|as well as)\b"
_NAME = r"[A-Z][\p{L}\p{N}_]*(?:\s+[A-Z][\p{L}\p{N}_]*)*"


def fact_key(description: Column) -> Column:
    """Facts with the same set of tokens are one."""
    return F.array_join(F.array_sort(F.array_distinct(T.ascii_tokens(description))), " ")


def names(text: Column) -> Column:
    """Runs of capitalised words, but for question words alone."""
    return F.filter(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda n: ~n.isin(*T.QUESTION_WORDS))


def _subject(clause: Column) -> Column:
    return F.try_element_at(names(clause), F.lit(-1))


def plan_facts(questions: DataFrame) -> DataFrame:
    """qid, fact_no (from 1), description: what a question asks for. ``questions``: qid, question.

    A question in two parts gives two facts, the second about the subject of the first where it does not name it. Null and
    blank questions have no facts.
    """
    q = F.trim(F.regexp_replace(F.trim("question"), r"\?+$", ""))
    rows = questions.where("trim(question) != ''").select("qid", q.alias("q"))
    rows = rows.withColumn("parts", F.split("q", _AND, 2))
    first, second = F.trim(F.col("parts")[0]), F.trim(F.try_element_at("parts", F.lit(2)))
    subject = _subject(first)
    named = F.when(subject.isNotNull() & ~F.contains(F.lower(second), F.lower(subject)), F.concat(second, F.lit(" about "), subject)).otherwise(second)
    facts = F.when(F.size("parts") > 1, F.array(first, named)).otherwise(F.array(F.col("q")))
    long = rows.select("qid", F.posexplode(facts).alias("i", "description")).where("description != ''")
    once = Window.partitionBy("qid", fact_key(F.col("description"))).orderBy("i")
    long = long.withColumn("n", F.row_number().over(once)).where("n = 1")
    return long.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("i")).cast("long").alias("fact_no"), "description")


def keyword_facts(questions: DataFrame) -> DataFrame:
    """qid, fact_no, description: the parts of a question between "and", commas and semicolons."""
    parts = F.filter(F.transform(F.split("question", r"(?i)\band\b|[,;]"), lambda p: F.regexp_replace(p, r"^[ ?.]+|[ ?.]+$", "")), lambda p: p != "")
    rows = questions.where("question is not null").select("qid", F.posexplode(parts).alias("i", "description"))
    once = Window.partitionBy("qid", F.array_join(T.ascii_tokens(F.col("description")), " ")).orderBy("i")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1")
    return rows.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("i")).cast("long").alias("fact_no"), "description")


def routes(facts: DataFrame, corpora: DataFrame, with_id: bool = True, most: int | None = None) -> DataFrame:
    """``facts`` rows with corpus_id, score and place: corpora in order of the share of the fact's tokens they describe.

    All that share a token; where none does, all corpora (the best one only, where ``most`` is given). ``corpora``: id, description;
    a catalogue of at most some thousand rows, joined on tokens.
    """
    keys = [c for c in ("qid", "fact_no") if c in facts.columns]
    text = F.concat_ws(" ", "id", "description") if with_id else F.col("description")
    tokens = corpora.select("id", F.explode(F.array_distinct(T.ascii_tokens(text))).alias("t"))
    asked = facts.select(*keys, F.array_distinct(T.ascii_tokens(F.col("description"))).alias("q"))
    hit = asked.select(*keys, F.size("q").alias("n"), F.explode("q").alias("t")).join(tokens, "t").groupBy(*keys, "n", "id").agg(F.count("*").alias("c"))
    hit = hit.select(*keys, F.col("id").alias("corpus_id"), (F.col("c") / F.col("n")).alias("score"))
    all_ids = corpora.agg(F.array_sort(F.collect_set("id")).alias("ids"))  # one row
    missed = facts.select(*keys).join(hit.select(*keys).distinct(), keys, "left_anti").join(F.broadcast(all_ids)).select(*keys, F.explode(F.slice("ids", 1, 1) if most else F.col("ids")).alias("corpus_id"), F.lit(0.0).alias("score"))
    place = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "corpus_id")
    out = hit.unionByName(missed).withColumn("place", F.row_number().over(place).cast("long"))
    return out.where(F.col("place") <= most) if most else out


def feedback_query(description: Column) -> Column:
    """The meaningful tokens of a missing fact."""
    return F.array_join(F.array_distinct(F.filter(T.ascii_tokens(F.regexp_replace(F.lower(description), "'s", "")), lambda t: ~t.isin(*T.FEEDBACK_STOPS))), " ")


def reformulated(question: Column, missing: Column) -> Column:
    """The first three tokens of a question and the first four of what is missing; the question where nothing is."""
    q = F.slice(F.filter(T.ascii_tokens(question), lambda t: ~t.isin(*T.RECOVERY_STOPS)), 1, 3)
    m = F.slice(F.array_distinct(F.filter(T.ascii_tokens(missing), lambda t: ~t.isin(*T.RECOVERY_STOPS))), 1, 4)
    both = F.array_join(F.array_distinct(F.concat(q, m)), " ")
    return F.when((F.coalesce(F.trim(missing), F.lit("")) == "") | (both == ""), question).otherwise(both)
