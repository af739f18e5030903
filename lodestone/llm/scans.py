"""Noise of scanned pages: page furniture, words broken at line ends, wrongly read characters.

Method. Lines at the edges of pages are compared by file with their digits masked and their glyphs reduced to a skeleton,
which finds running lines although they too are misread. Words of the body are grouped by the skeleton of their
confusable glyphs; a rare form that a known confusion explains from a frequent form of its group is a misread, and
among several such forms the one that the word before supports is chosen. Broken words are told from compounds by the
counts of the joined and the hyphenated form. Body lines are put together again with SQL windows.

All counts are over all pages. Windows run within one page; files are only grouped with pre-aggregation, and the next page
of a file is found by a join on file and page number, so a file may hold any share of all pages.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.running import total_before
from lodestone.session import materialise, prefer_hash_joins, release

#: What scanning makes of a glyph or of two.
CONFUSIONS = {
    "o": ("0",), "a": ("@",), "t": ("+",), "b": ("6", "8"), "s": ("5", "$"), "i": ("!", "1", "l", "|"), "l": ("1", "!", "i", "|"), "c": ("(", "e"), "e": ("c",),
    "h": ("li",), "m": ("rn", "in", "nn"), "rn": ("m",), "in": ("m",), "ri": ("n",), "li": ("h",), "u": ("ii",), "ii": ("u",), "w": ("vv",), "vv": ("w",), "d": ("cl",), "cl": ("d",),
    "g": ("9", "q"), "q": ("g",), "z": ("2",), "n": ("ri",), "1": ("l", "i"), "0": ("o",), "5": ("s",), "6": ("b",), "8": ("b",), "2": ("z",), "9": ("g",),
}
#: Glyphs with the same strokes, then glyphs written as their strokes.
SAME = ("ir1!|e(0@+68$59q2", "lllllccoatbbssggz")
STROKES = (("d", "cl"), ("w", "vv"), ("n", "ll"), ("h", "ll"), ("u", "ll"), ("m", "lll"))
HYPHENS = "-‐¬­"
STRAY = r"(?:^|\s)[\\~_•^·|¦`´°¨]+(?=\s|$)"
_TABLE = r"^\s*\|.*\|\s*$"
_BREAK = r"\p{L}[-‐¬­]\s*$"
_NUMBER = r"^\W{0,4}(?:(?i:page|p)\s?\.?\s*)?([0-9lIOoSB]{1,5})(?:\s*(?i:of|/)\s*[0-9lIOoSB]{1,5})?\W{0,4}$"


def skeleton(text: Column) -> Column:
    """Strokes of a text in lower case: forms that differ in confusable glyphs only have the same."""
    out = F.translate(F.lower(text), *SAME)
    for glyph, strokes in STROKES:
        out = F.replace(out, F.lit(glyph), F.lit(strokes))
    return out


def explained(form: str, word: str, most: int = 2) -> bool:
    """Whether ``form`` can be a misreading of ``word``, with at most ``most`` confusions."""
    states = {(0, 0, 0)}  # places in both, confusions so far
    seen = set(states)
    while states:
        step = set()
        for i, j, k in states:
            if i == len(form) and j == len(word):
                return k > 0
            if i < len(form) and j < len(word) and form[i] == word[j]:
                step.add((i + 1, j + 1, k))
            if k < most:
                for size in (1, 2):
                    for wrong in CONFUSIONS.get(word[j : j + size], ()) if j + size <= len(word) else ():
                        if form.startswith(wrong, i):
                            step.add((i + len(wrong), j + size, k + 1))
        states = step - seen
        seen |= states
    return False


def _explained(batches, most: int):
    for batch in batches:
        keep = [explained(f, w, most) for f, w in zip(batch.column("form").to_pylist(), batch.column("word").to_pylist())]
        yield batch.filter(pa.array(keep, pa.bool_()))


def lines_of(pages: DataFrame) -> DataFrame:
    """page_id, file, page, line_no (from 1, blank ones too), line, top and bottom (rank among the page's lines that are not blank)."""
    file = F.lower(F.coalesce(F.trim("document_name"), F.regexp_extract("source_path", r"[^/]*$", 0), F.regexp_replace("document_id", r"-p\d+$", "")))
    one = pages.where("page_id is not null and text is not null").select("page_id", file.alias("file"), "page", "text").dropDuplicates(["page_id"])
    lines = one.select("page_id", "file", "page", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("page_id", "file", "page", (F.col("at") + 1).alias("line_no"), "line")
    full = F.when(F.trim(F.regexp_replace("line", r"\s+", " ")) != "", 1).otherwise(0)
    down = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("page_id")
    lines = lines.withColumn("full", full).withColumn("top", F.sum("full").over(down))
    return lines.withColumn("bottom", F.sum("full").over(whole) - F.col("top") + F.col("full"))


def furniture(lines: DataFrame, edge: int = 3, least_pages: int = 2) -> DataFrame:
    """page_id, line_no, kind of the running lines and page numbers among the ``edge`` first and last lines of pages.

    A running line stands, but for numbers and misread glyphs, at the edges of at least ``least_pages`` pages of its file (of three
    where it has one or two words and is no title). A bare number is a page number where its distance to the page is usual in its file.
    """
    edges = lines.where((F.col("full") == 1) & (F.least("top", "bottom") <= edge))
    plain = F.trim(F.regexp_replace("line", r"[\s ]+", " "))
    # numbers, also misread ones, and what names them
    masked = F.regexp_replace(F.lower(plain), r"(?<![\p{L}\p{N}/])(?:(?:page|p\.?) ?)?(?:[0-9lio]*[0-9][0-9lio]*|l)(?![\p{L}\p{N}/])", "#")
    roman = F.regexp_extract(F.lower("plain"), r"^\W{0,4}(?:page|p\.?)?\s?(?=[ivxlc])(c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3}))\W{0,4}$", 1)
    bare = F.regexp_replace(masked, r"[#\W_]|\bof\b|\bpage\b|\bp\b", "")
    edges = edges.select("page_id", "file", "page", "line_no", plain.alias("plain"), F.trim(F.regexp_replace(F.replace(masked, F.lit("#"), F.lit(" ")), r"\s+", " ")).alias("masked"), F.length(bare).alias("letters"), roman.alias("roman"), F.least("top", "bottom").alias("depth"))
    digits = F.translate(F.regexp_extract("plain", _NUMBER, 1), "lIOoSB", "110058").try_cast("long")
    # a numeral's worth: its letters, less twice those that stand before a greater one
    worth = lambda c: F.length("roman") - F.length(F.replace(F.col("roman"), F.lit(c), F.lit("")))
    numeral = worth("i") + 5 * worth("v") + 10 * worth("x") + 50 * worth("l") + 100 * worth("c") - F.when(F.col("roman").rlike("iv|ix"), 2).otherwise(0) - F.when(F.col("roman").rlike("xl|xc"), 20).otherwise(0)
    dressed = F.col("plain").rlike(r"(?i)^(?:page|p\b)|^[\[(—–-]")
    edges = edges.withColumn("number", F.when((F.col("letters") == 0) | (F.length("plain") <= 2) | dressed, digits)).withColumn("number", F.coalesce("number", F.when(F.col("roman") != "", numeral)))
    # spaces get lost, and capitals are misread in ways of their own
    edges = edges.withColumn("key", F.xxhash64(F.translate(skeleton(F.regexp_replace("masked", " ", "")), "f47a", "coto"))).drop("roman")
    edges = materialise(edges, "edges")

    titles = edges.where("letters > 0 and number is null")
    # a title needs no third word
    named = F.col("plain").rlike(r"^(?:[\p{Lu}\d][\p{L}\p{N}'-]*(?: |$)){2,}$")
    words = F.size(F.split("masked", " ")) + named.cast("int")
    repeated = titles.select("file", "key", "page_id", words.alias("words")).distinct().groupBy("file", "key").agg(F.count("*").alias("pages"), F.max("words").alias("words"))
    repeated = repeated.where((F.col("pages") >= least_pages) & ((F.col("pages") > least_pages) | (F.col("words") > 2))).select("file", "key")
    running = titles.join(repeated, ["file", "key"], "left_semi").select("page_id", "line_no", F.lit("running_line").alias("kind"))

    numbers = edges.where("number is not null").withColumn("shift", F.col("number") - F.col("page"))
    usual = numbers.where("shift is not null").groupBy("file", "shift").count()
    usual = usual.groupBy("file").agg(F.max_by("shift", F.struct("count", -F.abs("shift"))).alias("usual"), F.max("count").alias("support"))
    numbered = numbers.join(usual, "file", "left").where(dressed | F.col("page").isNull() | F.col("usual").isNull() | (F.col("shift") == F.col("usual")))
    return running.unionByName(numbered.select("page_id", "line_no", F.lit("page_number").alias("kind")))


def body_of(lines: DataFrame, furnished: DataFrame) -> DataFrame:
    """Body lines with the body line before and after them in their page, and whether they begin and end it."""
    body = lines.join(furnished.select("page_id", "line_no"), ["page_id", "line_no"], "left_anti")
    full = body.where("full = 1")
    order = Window.partitionBy("page_id").orderBy("line_no")
    return full.select("page_id", "file", "page", "line_no", "line", F.lag("line").over(order).alias("before"), F.lead("line").over(order).alias("after"), F.lag("line_no").over(order).alias("before_no"))


def across_pages(body: DataFrame) -> DataFrame:
    """``body`` where the line after a page's last is the first of the file's next page, and the line before likewise."""
    firsts = body.where("before is null").groupBy("file", (F.col("page") - 1).alias("page")).agg(F.min_by("line", "page_id").alias("next_first"))
    lasts = body.where("after is null").groupBy("file", (F.col("page") + 1).alias("page")).agg(F.min_by("line", "page_id").alias("last_before"))
    ends = body.where("after is null or before is null").join(firsts, ["file", "page"], "left").join(lasts, ["file", "page"], "left")
    ends = ends.withColumn("after", F.coalesce("after", "next_first")).withColumn("before", F.coalesce("before", "last_before")).drop("next_first", "last_before")
    return body.where("after is not null and before is not null").unionByName(ends)


def tokens_of(body: DataFrame, *beside: str) -> DataFrame:
    """Tokens of body lines without the two halves of broken words: page_id, line_no, at, token, form, and as asked for by ``beside`` prev
    and next, the forms before and after it in its line and sentence (empty where there is none).

    The form is the token in lower case without marks that follow or quote it.
    """
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    # the forms of a whole line at once; a token of marks alone leaves an empty form in its place
    form = F.regexp_replace(F.lower(line), r"[.,;:?)\]\"'”’]+(?= |$)", "")
    form = F.regexp_replace(form, r"(?<=^| )[\"'“‘\[]+", "")
    form = F.regexp_replace(form, r"(?<=^| )\((?!\p{L}+(?= |$))", "")
    rows = body.where(~F.col("line").rlike(_TABLE))
    # the halves of broken words: the last token of a line, and the first of the next
    start, end = F.when(F.coalesce(F.col("before").rlike(_BREAK), F.lit(False)), 1).otherwise(0), F.when(F.col("line").rlike(_BREAK), 1).otherwise(0)
    # tokens that end a sentence, as a sign of their own
    stops = F.split(F.regexp_replace(line, r"[^ ]*[.!?][\"'”’)]*(?= |$)", "\x02"), " ").alias("stops")
    lists = rows.select("page_id", "line_no", start.alias("start"), end.alias("end"), F.split(line, " ").alias("parts"), F.split(form, " ").alias("forms"), *([stops] if beside else []))
    whole = lambda c: F.slice(c, F.col("start") + 1, F.greatest(F.lit(0), F.size("parts") - F.col("start") - F.col("end")))
    lists = lists.select("page_id", "line_no", "start", whole("parts").alias("token"), whole("forms").alias("form"), *([whole("stops").alias("stop")] if beside else []))
    # one struct a token, so that no row carries the whole line
    inner = lambda f: F.ltrim(f, F.lit("("))
    ends = lambda i: F.try_element_at("stop", i) == "\x02"
    beyond = lambda i, end: F.when(end, "").otherwise(inner(F.coalesce(F.try_element_at("form", i), F.lit(""))))
    sides = {
        "prev": F.transform("form", lambda f, i: F.when(i > 0, beyond(i, ends(i))).otherwise("")).alias("prev"),
        "next": F.transform("form", lambda f, i: beyond(i + 2, ends(i + 1))).alias("next"),
    }
    zipped = F.arrays_zip("token", "form", *(sides[side] for side in beside))
    long = lists.select("page_id", "line_no", "start", F.posexplode(zipped).alias("i", "x"))
    out = long.select("page_id", "line_no", (F.col("i") + F.col("start")).alias("at"), "x.token", *(f"x.{side}" for side in beside), "x.form")
    return out.where("form != ''")


def form_counts(tokens: DataFrame) -> DataFrame:
    """form, count, capital: how often each form occurs, and in what share with a capital."""
    capital = F.avg(F.col("token").rlike(r"^\W?\p{Lu}").cast("int")).alias("capital")
    return tokens.groupBy("form").agg(F.count("*").alias("count"), capital)


_WORD = r"^\p{L}+(?:['’-]\p{L}+)*$"
_MIXED = r"^(?=.*\p{L}.*\p{L})(?:\p{L}|[-'])*(?:[@+!$]|[0-9](?!\d))(?:\p{L}|[-'@+!0-9])*$"
_ORDINAL = r"^\d+(?:st|nd|rd|th|s|e)$"


def misread_forms(counts: DataFrame, ratio: int = 12, rate: float = 0.005, confusions: int = 2) -> DataFrame:
    """Forms that are, or may be, misreadings: form, word (what it should be, null if nothing known), words (all that explain it), sure.

    A form is one where a form of its skeleton is ``ratio`` times as frequent and at most ``confusions`` confusions explain it (a form
    that is always written with a capital, unlike the other, is a name); or where glyphs that no word holds stand between
    letters. It is sure where no more than about ``rate`` of the other's occurrences are so misread; else it may be a word of its own, and what
    stands beside each of its tokens decides.
    """
    counts = counts.where(F.length("form").between(2, 64) & F.col("form").rlike(r"\p{L}")).withColumn("skeleton", skeleton(F.col("form")))
    good = counts.where(F.col("form").rlike(_WORD)).select("skeleton", F.col("form").alias("word"), F.col("count").alias("often"), F.col("capital").alias("usual"))
    name = F.col("form").rlike(_WORD) & (F.col("capital") == 1) & (F.col("usual") < 0.03)
    pairs = counts.join(good, "skeleton").where((F.col("form") != F.col("word")) & (F.col("often") >= ratio * F.col("count")) & ~name)
    pairs = pairs.select("form", "word", "often", (F.col("count") <= 3 + rate * F.col("often")).alias("rare"))
    told = pairs.mapInArrow(partial(_explained, most=confusions), "form string, word string, often long, rare boolean")
    told = told.groupBy("form").agg(F.max_by("word", F.struct("rare", "often", "word")).alias("word"), F.collect_list("word").alias("words"), F.max("rare").alias("sure"))
    odd = counts.where(F.col("form").rlike(_MIXED) & ~F.col("form").rlike(_ORDINAL) & ~F.col("form").contains("/")).select("form")
    digits = counts.where(F.col("form").rlike(r"^(?:[0-9]+[lo]+[0-9lo]*|[lo]+[0-9][0-9lo]*)$")).select("form")
    odd = odd.unionByName(digits).distinct().withColumn("odd", F.lit(True))
    both = told.join(odd, "form", "full")
    return materialise(both.select("form", "word", F.coalesce("words", F.array().cast("array<string>")).alias("words"), (F.coalesce("sure", F.lit(False)) | F.col("odd").isNotNull()).alias("sure")), "misread")


def misread_tokens(body: DataFrame, forms: DataFrame, choose: bool = True, ratio: int = 12) -> DataFrame:
    """Each misread token (page_id, line_no, at, token, form, word) with the word that stands for it.

    Of several words it is the one seen most beside its neighbours (with ``choose``; else any). A token whose form may be a word of its
    own is one only where another word is seen ``ratio`` times as often both after the word before it and before the word after it.
    """
    hit, at, place = materialise(tokens_of(body).join(forms, "form"), "hits"), ["page_id", "line_no", "at"], ["prev", "form", "next"]
    # only the lines with a form in doubt are looked at again
    doubtful = hit.where(~F.col("sure") | (F.lit(choose) & (F.size("words") > 1)))
    lines = body.join(doubtful.select("page_id", "line_no").distinct(), ["page_id", "line_no"], "left_semi")
    doubtful = materialise(doubtful.select(*at, "form", "words").join(tokens_of(lines, "prev", "next").select(*at, "prev", "next"), at), "doubtful")
    ways = doubtful.select(*place, "words").distinct()
    ways = ways.select(*place, F.explode(F.array_union(F.array("form"), "words")).alias("word"))
    # counted by pairs of neighbours, so that no row gathers all that follows a word
    asked = ways.select(F.col("prev").alias("a"), F.col("word").alias("b")).unionByName(ways.select(F.col("word").alias("a"), F.col("next").alias("b"))).where("a != '' and b != ''").distinct()
    seen = materialise(tokens_of(body, "prev").select(F.col("prev").alias("a"), F.col("form").alias("b")).join(asked, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count("*").alias("seen")), "seen")
    before = seen.select(F.col("a").alias("prev"), F.col("b").alias("word"), F.col("seen").alias("left"))
    after = seen.select(F.col("a").alias("word"), F.col("b").alias("next"), F.col("seen").alias("right"))
    ways = ways.join(before, ["prev", "word"], "left").join(after, ["word", "next"], "left").na.fill(0, ["left", "right"])
    own = ways.where("word = form").select(*place, F.greatest("left", F.lit(1)).alias("own_left"), F.greatest("right", F.lit(1)).alias("own_right"))
    ways = ways.where("word != form and left + right > 0").join(own, place)
    backed = (F.col("left") >= ratio * F.col("own_left")) & (F.col("right") >= ratio * F.col("own_right"))
    choice = ways.groupBy(*place).agg(F.max(F.struct(backed.alias("backed"), (F.col("left") + F.col("right")).alias("seen"), "word")).alias("best")).select(*place, "best.backed", F.col("best.word").alias("better"))
    hit = hit.join(doubtful.join(choice, place).select(*at, "backed", "better"), at, "left").where("sure or coalesce(backed, false)")
    return hit.select("page_id", "line_no", "at", "token", "form", F.coalesce("better", "word").alias("word"))


def breaks(body: DataFrame, counts: DataFrame) -> DataFrame:
    """Body lines at whose end a word is broken: page_id, line_no, head, tail (its halves)."""
    ends = body.where(F.col("line").rlike(_BREAK) & ~F.col("line").rlike(_TABLE)).select(
        "page_id", "line_no",
        F.regexp_extract("line", r"([\p{L}\p{N}@+!'’‐-]*\p{L})[-‐¬­]\s*$", 1).alias("head"),
        F.regexp_extract("line", r"([-‐¬­])\s*$", 1).alias("mark"),
        F.regexp_extract(F.coalesce("after", F.lit("")), r"^\s*(\p{Ll}[\p{L}\p{N}@+!'’-]*?)(?=[-‐¬­]?\s*$|[^\p{L}\p{N}@+!'’-]|$)", 1).alias("tail"),
        F.col("after").isNull().alias("last"),
    )
    counts = counts.where(F.col("form").rlike(_WORD)).select("form", "count")
    starts = counts.where(F.col("form").contains("-")).groupBy(F.substring_index("form", "-", 1).alias("form")).agg(F.sum("count").alias("starts"))
    asked = ends.select("page_id", "line_no", F.explode(F.create_map(F.lit("joined"), F.lower(F.concat("head", "tail")), F.lit("compound"), F.lower(F.concat_ws("-", "head", "tail")), F.lit("head"), F.lower("head"), F.lit("tail"), F.lower("tail"))).alias("what", "form"))
    known = asked.join(counts, "form").groupBy("page_id", "line_no").pivot("what", ["joined", "compound", "head", "tail"]).agg(F.first("count"))
    led = ends.select("page_id", "line_no", F.lower("head").alias("form")).join(starts, "form").select("page_id", "line_no", "starts")
    both = ends.join(known.withColumnsRenamed({"head": "n_head", "tail": "n_tail"}), ["page_id", "line_no"], "left").join(led, ["page_id", "line_no"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    plain = F.col("mark") == "-"
    by_counts = F.when(n("joined") + n("compound") > 0, n("joined") >= n("compound")).when(F.col("tail") == "", (n("starts") == 0) | (n("n_head") == 0)).otherwise(~((n("n_head") > 0) & (n("n_tail") > 0)) | (n("starts") == 0))
    return both.where((F.length("head") > 0) & (~plain | by_counts)).where(F.col("last") | (F.col("tail") != "") | ~plain).select("page_id", "line_no", "head", "tail", "mark")


def _parts(pages: DataFrame, edge: int = 3):
    prefer_hash_joins(pages.sparkSession)
    lines = materialise(lines_of(pages), "lines")
    furnished = materialise(furniture(lines, edge), "furniture")
    body = materialise(across_pages(body_of(lines, furnished)), "body")
    # tokens are not kept, as they take more room than the text
    return lines, furnished, body, materialise(form_counts(tokens_of(body)), "forms")


def noise(pages: DataFrame, edge: int = 3, ratio: int = 12, rate: float = 0.005, confusions: int = 2) -> DataFrame:
    """Lines with noise: page_id, line_no (from 1), kind (running_line, page_number, hyphen_break or misread), one row a kind.

    ``pages``: page_id, document_id, document_name, source_path, page, text. A page_id that comes twice counts once; null
    and empty texts have no lines. Pages without a number are in no order: breaks at their ends are judged by the half that is there.
    Running lines and page numbers are sought among the ``edge`` first and last lines of a page that are not blank; for the others
    see ``misread_forms``.
    """
    lines, furnished, body, counts = _parts(pages, edge)
    release(lines)
    wrong = misread_tokens(body, misread_forms(counts, ratio, rate, confusions), False, ratio).select("page_id", "line_no")
    stray = body.where(F.col("line").rlike(STRAY) & ~F.col("line").rlike(_TABLE)).select("page_id", "line_no")
    misread = wrong.unionByName(stray).distinct().withColumn("kind", F.lit("misread"))
    broken = breaks(body, counts).select("page_id", "line_no", F.lit("hyphen_break").alias("kind"))
    return furnished.unionByName(broken).unionByName(misread).distinct().select("page_id", F.col("line_no").cast("int").alias("line_no"), "kind")


def paragraphs(pages: DataFrame) -> DataFrame:
    """Readable paragraphs: file, page, page_id, paragraph (from 1 in its page), continues (goes on from the page before), text.

    Furniture and stray marks are left out, misread words replaced where the right one is known, broken words joined (one
    that runs to the next page of its file stays whole on the first). A paragraph begins after a blank line or at an indented one.
    """
    lines, furnished, body, counts = _parts(pages)
    fixed = misread_tokens(body, misread_forms(counts)).where("word is not null")
    cased = F.when(F.col("token").rlike(r"^[\"'“‘\[(]*\p{Lu}") & (F.length("token") > 1), F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substr(word, 2)"))).otherwise(F.col("word"))
    # the marks around the form stay
    lead, trail = F.regexp_extract("token", r"^[\"'“‘\[]*", 0), F.regexp_extract("token", r"[.,;:?)\]\"'”’]*$", 0)
    fixes = fixed.groupBy("page_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("at", F.concat(lead, cased, trail).alias("new")))).alias("fixes"))
    cuts = breaks(body, counts).select("page_id", "line_no", "tail", F.lit(True).alias("cut"))
    before = cuts.select("page_id", F.col("line_no").alias("before_no"), F.lit(True).alias("tail_gone"))
    rows = body.join(fixes, ["page_id", "line_no"], "left").join(cuts, ["page_id", "line_no"], "left").join(before, ["page_id", "before_no"], "left")
    # the first line of a page loses its first word to the page before
    first = body.where("before_no is null").select("page_id", "line_no", "file", "page")
    ends = cuts.join(body.select("page_id", "line_no", "file", "page", F.col("after").alias("next")), ["page_id", "line_no"])
    led = first.join(ends.select("file", (F.col("page") + 1).alias("page"), F.col("next").alias("line")).distinct(), ["file", "page"]).join(body.select("page_id", "line_no", "line"), ["page_id", "line_no", "line"], "left_semi").select("page_id", "line_no", F.lit(True).alias("led")).distinct()
    rows = rows.join(led, ["page_id", "line_no"], "left")
    gone = F.coalesce("tail_gone", "led", F.lit(False))
    parts = F.filter(F.split(F.trim("line"), r"\s+"), lambda t: t != "")
    fixed_parts = F.transform(parts, lambda t, i: F.coalesce(F.try_element_at("fixes", i), t))
    fixed_parts = F.when(F.col("line").rlike(_TABLE), parts).otherwise(F.filter(fixed_parts, lambda t: ~t.rlike(r"^[\\~_•^·|¦`´°¨]+$")))
    # what follows the tail of a broken word (a comma, say) goes with it
    tail_token = F.regexp_extract(F.coalesce("after", F.lit("")), r"^\s*(\S+)", 1)
    rest = F.when(gone, F.slice(fixed_parts, 2, F.greatest(F.size(fixed_parts) - 1, F.lit(0)))).otherwise(fixed_parts)
    text = F.array_join(rest, " ")
    # a compound split at its own hyphen goes on without a space
    text = F.when(F.col("cut"), F.concat(F.regexp_replace(text, r"[-‐¬­]\s*$", ""), tail_token)).when(F.col("line").rlike(_BREAK), F.concat(text, F.lit("\x01"))).otherwise(text)
    rows = rows.select("page_id", "file", "page", "line_no", "line", text.alias("piece"), gone.alias("gone"))
    blanks = lines.where("full = 0").select("page_id", (F.col("line_no") + 1).alias("line_no")).withColumn("blank", F.lit(1))
    order = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.when(F.col("blank").isNotNull() | F.col("line").rlike(r"^\s{2,}\S"), 1).otherwise(0)
    rows = rows.join(blanks, ["page_id", "line_no"], "left").withColumn("paragraph", F.sum(starts).over(order))
    out = rows.groupBy("page_id", "file", "page", "paragraph").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), " ").alias("text"), F.min_by("line", "line_no").alias("line"), F.min_by("gone", "line_no").alias("gone"),
    )
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("paragraph"))
    out = out.where("trim(text) != ''").withColumn("n", number)
    return out.select("file", "page", "page_id", F.col("n").alias("paragraph"), ((F.col("n") == 1) & (F.col("gone") | F.col("line").rlike(r"^\p{Ll}"))).alias("continues"), F.trim(F.regexp_replace(F.regexp_replace("text", "\x01 ?", ""), r"\s+", " ")).alias("text"))


def continuous(paragraphs: DataFrame, bucket_pages: int = 64) -> DataFrame:
    """Paragraphs over page ends: file, paragraph (from 1 in its file), page and page_id (where it begins), pages (on how many it stands), text.

    ``paragraphs``: as ``paragraphs`` gives them. The first paragraph of a page goes on from the last of the page before, if that is there.
    Pages without a number stand each for itself. Paragraphs are numbered with running totals within buckets of pages, so no
    task holds a whole file.
    """
    numbered = paragraphs.where("page is not null and file is not null")
    ends = numbered.groupBy("file", (F.col("page") + 1).alias("page")).agg(F.lit(True).alias("led"))
    rows = numbered.join(ends, ["file", "page"], "left").withColumn("bucket", F.floor(F.col("page") / bucket_pages))
    # of pages with the same number the first one goes on
    first = F.row_number().over(Window.partitionBy("file", "page").orderBy("page_id", "paragraph")) == 1
    rows = rows.withColumn("starts", F.when(F.col("continues") & F.coalesce("led", F.lit(False)) & first, 0).otherwise(1).cast("long"))
    rows = total_before(rows, ["file"], ["page", "page_id", "paragraph"], "starts", "bucket").withColumn("n", F.col("before") + F.col("starts"))
    pieces = F.array_sort(F.collect_list(F.struct("page", "page_id", "paragraph", "text")))
    whole = rows.groupBy("file", "n").agg(pieces.alias("pieces"))
    whole = whole.select("file", F.col("n").alias("paragraph"), F.col("pieces")[0]["page"].alias("page"), F.col("pieces")[0]["page_id"].alias("page_id"), F.size("pieces").alias("pages"), F.array_join(F.transform("pieces", lambda x: x["text"]), " ").alias("text"))
    alone = paragraphs.where("page is null or file is null").select("file", F.col("paragraph").cast("long").alias("paragraph"), "page", "page_id", F.lit(1).alias("pages"), "text")
    return whole.unionByName(alone)
