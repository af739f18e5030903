"""Noise of scanned pages, on pages made for it."""

import random

from pyspark.sql import functions as F

from lodestone.llm import scans

SUBJECTS = "the careful manager|every regional branch|a steady supplier|the quiet committee|this northern harbour|the second register".split("|")
VERBS = "reviewed described welcomed favoured considered questioned".split()
OBJECTS = "the long-standing report|a modest proposal|the warehouse near the river|an annual summary|the building beside the canal|another committee".split("|")


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(OBJECTS)}".capitalize() + "."


def made(seed=4):
    """Scanned pages of a few files with known noise, and clean ones: rows, {(page_id, line_no, kind)}."""
    rng, rows, truth, page_id = random.Random(seed), [], set(), 0
    for f in range(6):
        for p in range(1, 9):
            page_id += 1
            lines = ["QUIET REGISTER" if p % 2 else f"Northern Harbour Notes  {p + 10}", ""] if p > 1 else []
            if p > 1:
                truth.add((page_id, 1, "running_line"))
            words, line = " ".join(sentence(rng) for _ in range(14)).split(), ""
            while words:
                w = words.pop(0)
                if len(line) + len(w) > 60:
                    if len(w) > 7 and "-" not in w and w.isalpha() and rng.random() < 0.5:
                        lines.append(line + w[:4] + rng.choice("-¬­"))
                        truth.add((page_id, len(lines), "hyphen_break"))
                        line = w[4:] + " "
                        continue
                    if w == "long-standing":
                        lines.append(line + "long-")  # its own hyphen
                        line = "standing "
                        continue
                    lines.append(line.rstrip())
                    line = ""
                    if rng.random() < 0.1 and "reviewed" in lines[-1]:
                        lines[-1] = lines[-1].replace("reviewed", rng.choice(["rcviewed", "reviewecl", "re+iewed".replace("+", "v", 1).replace("w", "vv")]))
                        truth.add((page_id, len(lines), "misread"))
                line += w + " "
            lines.append(line.rstrip())
            if rng.random() < 0.4:
                at = next(i for i, x in enumerate(lines) if len(x.split()) > 3 and (page_id, i + 1, "running_line") not in truth)
                first, rest = lines[at].split(" ", 1)
                lines[at] = f"{first} ~ {rest}"
                truth.add((page_id, at + 1, "misread"))
            lines += ["", rng.choice([f"- {p} -", f"Page {p} of 8", str(p)])]
            truth.add((page_id, len(lines), "page_number"))
            rows.append((page_id, f"f{f}-p{p}", f"F{f}.PDF" if p == 3 else f"f{f}.pdf", None, p, "\n".join(lines)))
    for p in range(30):
        page_id += 1
        rows.append((page_id, f"clean{p}", f"clean{p}.txt", None, 1, "\n\n".join(" ".join(sentence(rng) for _ in range(20)) for _ in range(3))))
    return rows, truth


SCHEMA = "page_id long, document_id string, document_name string, source_path string, page int, text string"


def test_noise_is_found(spark):
    rows, truth = made()
    extra = [(9001, None, None, None, None, None), (9002, "e", "e.txt", None, None, ""), (9003, "e", "e.txt", None, 1, " \n "), rows[0]]
    df = spark.createDataFrame(rows + extra, SCHEMA).withColumn("line", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = [tuple(r) for r in scans.noise(df).collect()]
    assert len(got) == len(set(got))
    for kind in ("running_line", "page_number", "hyphen_break", "misread"):
        mine, want = {x for x in got if x[2] == kind}, {x for x in truth if x[2] == kind}
        assert len(mine & want) >= 0.95 * len(want), (kind, want - mine)
        assert len(mine & want) >= 0.95 * len(mine), (kind, mine - want)


def test_paragraphs_read_on(spark):
    rows, _ = made()
    out = scans.paragraphs(spark.createDataFrame(rows, SCHEMA))
    texts = [r.text for r in out.collect()]
    joined = " ".join(texts)
    for bad in ("QUIET REGISTER", "Northern Harbour Notes", "rcviewed", "reviewecl", "­", "¬", "~"):
        assert bad not in joined, bad
    words = set(joined.replace(".", " ").lower().split())
    known = set(" ".join(SUBJECTS + VERBS + OBJECTS).lower().split())
    assert words <= known, sorted(words - known)[:10]


def test_word_runs_to_the_next_page(spark):
    rows = [(1, "a-p1", "a.pdf", None, 1, "The committee\nfavoured the exam-"), (2, "a-p2", "a.pdf", None, 2, "ple of the others.\nIt was good.")] + [(10 + i, f"c{i}", f"c{i}.txt", None, 1, "we saw an example here today") for i in range(3)]
    got = {(r.page_id, r.paragraph): r for r in scans.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 1].text == "The committee favoured the example" and got[2, 1].text == "of the others. It was good." and got[2, 1].continues


def test_nothing(spark):
    assert scans.noise(spark.createDataFrame([], SCHEMA)).count() == 0
    assert scans.paragraphs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_explained():
    for form, word in (("tliat", "that"), ("frorn", "from"), ("durmg", "during"), ("renamecl", "renamed"), ("aboiit", "about"), ("vvith", "with"), ("fr0m", "from"), ("wh!ch", "which"), ("htigated", "litigated"), ("pattem", "pattern")):
        assert scans.explained(form, word), form
    for form, word in (("that", "that"), ("cat", "cut"), ("form", "from")):
        assert not scans.explained(form, word), form


def test_paragraphs_go_on_over_pages(spark):
    rows = [
        (1, "a-p1", "a.pdf", None, 1, "It began here.\n\nThe committee\nfavoured the exam-"), (2, "a-p2", "A.pdf", None, 2, "ple of the others\nand the second"), (3, "a-p3", "a.pdf", None, 3, "one too.\n\n  Then it was over."),
        (4, "a-p5", "a.pdf", None, 5, "and a page is missing before this."), (5, "b", None, None, None, "no number here."), (6, "b2-p1", "a 2.pdf", None, 1, "Another file\nwas revised"), (7, "b2-p2", "a 2.pdf", None, 2, "in the end."),
    ] + [(10 + i, f"c{i}", f"c{i}.txt", None, 1, "We saw an example here today.") for i in range(3)]
    got = {(r.file, r.paragraph): r for r in scans.continuous(scans.paragraphs(spark.createDataFrame(rows, SCHEMA)), bucket_pages=2).collect()}
    mine = {k: (r.page_id, r.pages, r.text) for k, r in got.items() if k[0] in ("a.pdf", "a 2.pdf", "b")}
    assert mine == {
        ("a.pdf", 1): (1, 1, "It began here."), ("a.pdf", 2): (1, 3, "The committee favoured the example of the others and the second one too."), ("a.pdf", 3): (3, 1, "Then it was over."),
        ("a.pdf", 4): (4, 1, "and a page is missing before this."), ("a 2.pdf", 1): (6, 2, "Another file was revised in the end."), ("b", 1): (5, 1, "no number here."),
    }
    assert scans.continuous(scans.paragraphs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_what_stands_before_decides_where_a_form_may_be_a_word(spark):
    """A form too frequent to be sure of: misread where another word is usual in its place, a word of its own elsewhere."""
    lines = ["they come and go all day"] * 400 + ["they come arid go all day"] * 8 + ["a hot arid plain lies there"] * 8
    rows = [(i, f"p{i}", f"p{i}.txt", None, 1, line) for i, line in enumerate(lines)]
    got = {r.page_id for r in scans.noise(spark.createDataFrame(rows, SCHEMA)).collect() if r.kind == "misread"}
    assert got == set(range(400, 408))
