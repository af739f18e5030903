"""Text functions as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning of a question, by the operator that leaves them out.
PLAN_STOPS = "who what when where why how which did does do is are was were will can could would should the a an and or it its about of to for in on by with".split()
FEEDBACK_STOPS = "what who when where why how does did is are was were the a an and or of to for in on by with".split()
RECOVERY_STOPS = "what who when where why how is are was were the a an and or of to for in on by with missing context fact required evidence".split()
ANSWER_STOPS = "what who when where why how does did is are the a an in on of to for".split()
SENTENCE_STOPS = "what who when where why how does did was were the and about from for with".split()
QUESTION_WORDS = "Who What When Where Why How Which Did Does Is Are Was Were".split()
SUFFIXES = ("ing", "ed", "es", "s")

WORD = r"[\p{L}\p{M}\p{N}_]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s\p{Z}]"
ASCII = "[a-z0-9]+"


def literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def squashed(text: Column) -> Column:
    """White space collapsed and trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalised(text: Column) -> Column:
    return squashed(F.lower(text))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, in order; accents split words."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(ASCII), F.lit(0))


def index_tokens(text: Column) -> Column:
    """ASCII tokens of two characters or more, in order and with repeats."""
    return F.filter(ascii_tokens(text), lambda t: F.length(t) > 1)


def token_count(text: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def stem(word: Column) -> Column:
    """The word without the first of the known suffixes that leaves more than two characters."""
    out = word
    for suffix in reversed(SUFFIXES):
        out = F.when(word.endswith(suffix) & (F.length(word) > len(suffix) + 2), F.substring(word, F.lit(1), F.length(word) - len(suffix))).otherwise(out)
    return out


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(ascii_tokens(text), stem))


def meaningful(text: Column, stops=PLAN_STOPS) -> Column:
    """Distinct tokens in order of appearance without the stop words."""
    return F.array_distinct(F.filter(ascii_tokens(text), lambda t: ~t.isin(*stops)))


def clean_page(text: Column) -> Column:
    """Lines without blank ones, page numbers and copyright lines."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    keep = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(?i:page\s+)?\d+(\s*(?i:of|/)\s*\d+)?$") & ~x.rlike(r"^(?i:copyright|all rights reserved|\(c\))\b"))
    return F.array_join(keep, "\n")


def heading(text: Column) -> Column:
    """The first Markdown heading or short line in capitals; null where there is none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    capitals = lambda x: x.rlike(r"^[A-Z0-9\s_-]{3,40}(:|$)") & (F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) <= 6)
    first = F.try_element_at(F.filter(lines, lambda x: x.rlike(r"^#{1,4}\s+.+$") | capitals(x)), F.lit(1))
    return F.when(first.rlike(r"^#{1,4}\s+.+$"), F.regexp_replace(F.regexp_extract(first, r"^#{1,4}\s+(.+)$", 1), r"^\s+|\s+$", "")).otherwise(F.regexp_replace(first, r":+$", ""))
