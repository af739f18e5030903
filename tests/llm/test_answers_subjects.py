"""Defects of answers and subject areas, on held-out cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import answers, subjects

NAMES = ["Lomdan", "Veskor", "Tarnix", "Pelora", "Quenda", "Rasmir", "Ostvik", "Haldun", "Brenna", "Corvane"]
ANSWER_SCHEMA = "id string, field string, question string, answer string, others string, answerable boolean"
REFERENCE_SCHEMA = "id string, question string, answer string, others string, declined boolean"


def log(n, rng):
    rows = []
    for i in range(n):
        a, b, c = rng.sample(NAMES, 3)
        year = rng.randrange(1800, 2020)
        q, full, french = rng.choice([
            (f"Who founded {a} Works?", f"{a} Works was founded by {b} {c} in {year}.", f"{b} {c} a fondé la société en {year}."),
            (f"Where is {a} Works based?", f"The headquarters of {a} Works are located in {c}, not in {b}.", f"Le siège de la société se trouve à {c}."),
            (f"When did {a} Works start?", f"The company started in {year}, at first with two helpers.", f"La société existe depuis {year}."),
        ])
        rows.append((f"q{i}", q, full, french))
    return rows


def test_defects_on_held_out_answers(spark):
    rng = random.Random(3)
    rows = log(300, rng)
    refs = [(i, q, a, a, False) for i, q, a, _ in rows] + [(f"f{i}", f"Qui a fondé {n} Works ?", f"{n} a fondé la société en 1900.", "", False) for i, n in enumerate(NAMES * 6)]
    refs += [(f"n{i}", f"Who founded {n} Mills?", "The passages do not state this.", "", True) for i, n in enumerate(NAMES * 3)]
    cases, want = [], {}
    for k, (i, q, a, f) in enumerate(log(140, random.Random(9))):
        kind = k % 7
        words = a.rstrip(".").split()
        answer, defect = [
            (a, None), (rng.choice(["", None, " ", "n/a", "<p></p>", "[]", "Answer:", "​"]), "empty"), (" ".join(words[: len(words) // 2 + 1]) + rng.choice(["", "..."]), "truncated"),
            (rng.choice(["I'm sorry, but I cannot share that.", "Unfortunately I am not able to comment on this.", "I would rather not answer."]), "refusal"), (rng.choice([q, q.upper(), f"Question: {q}", f"{q} {q}"]), "copies_question"), (f, "other_language"), (a.rstrip("."), None),
        ][kind]
        cases.append((f"c{k}", "x", q, answer, "", True))
        want[f"c{k}"] = defect
    # declining what cannot be answered is right, an answer after a polite beginning too
    cases += [("ok1", "x", "Who founded Lomdan Works?", "I cannot answer this from the passages.", "", False), ("ok2", "x", rows[0][1], f"Sorry to be brief: {rows[0][2]}", rows[0][2], True), ("null", "x", None, None, None, None), cases[0]]
    want |= {"ok1": None, "ok2": None, "null": "empty"}
    df = spark.createDataFrame(cases, ANSWER_SCHEMA).withColumn("counts", F.lit("clash")).withColumn("key", F.lit(1))
    got = {r.id: r.defect for r in answers.defects(df, spark.createDataFrame(refs, REFERENCE_SCHEMA)).collect()}
    assert set(got) == set(want)
    wrong = {k: (want[k], got[k]) for k in want if want[k] != got[k]}
    assert len(wrong) <= 0.05 * len(want), wrong
    assert not {"ok1", "ok2", "null"} & set(wrong)


def test_defects_of_nothing(spark):
    none = spark.createDataFrame([], ANSWER_SCHEMA)
    refs = spark.createDataFrame([], REFERENCE_SCHEMA)
    assert answers.defects(none, refs).count() == 0
    one = spark.createDataFrame([("a", "x", "Who?", "N/A", "", True), ("b", "x", "Who?", "word " * 20_000, "", True)], ANSWER_SCHEMA)
    assert {r.id: r.defect for r in answers.defects(one, refs).collect()}["a"] == "empty"


def test_field_gradient_and_best_path():
    rng = np.random.default_rng(0)
    features, tags = [], []
    for _ in range(200):
        n = int(rng.integers(1, 4))
        t = [0] * (n - 1) + [int(rng.integers(0, 5))]
        f = np.zeros((n, answers.WIDTH), np.float32)
        for i, tag in enumerate(t):
            f[i, tag], f[i, 10] = 1, 1
        features.append(f)
        tags.append(t)
    model = answers.train_field(features, tags, steps=60)
    assert np.mean([answers.best_tags(model, f) == t for f, t in zip(features, tags)]) > 0.98
    # the best path of a sequence, against all paths
    import itertools

    f = rng.normal(size=(4, answers.WIDTH)).astype(np.float32)
    emit = f @ model["emit"]
    score = lambda p: model["first"][p[0]] + sum(emit[i, t] for i, t in enumerate(p)) + sum(model["step"][a, b] for a, b in zip(p, p[1:]))
    assert tuple(answers.best_tags(model, f)) == max(itertools.product(range(5), repeat=4), key=score)


AREAS = {"law": "court ruling verdict statute judge appeal", "sport": "match goal team referee league sprint", "music": "violin opera choir sonata concert tempo"}


def documents(n, rng, labelled=True):
    """Documents of ten sentences on one or two areas, some neutral: rows, {(doc_id, area)}, labels."""
    rows, truth, labels = [], set(), []
    for d in range(n):
        mine = rng.sample(list(AREAS), rng.choice([0, 1, 1, 2]))
        text = []
        for s in range(10):
            area = mine[s % len(mine)] if mine and s < 7 else None
            words = rng.sample(AREAS[area].split(), 2) if area else ["office", "letter"]
            text.append(f"Then {rng.choice(NAMES)} noted the {words[0]} and the {words[1]} near {rng.choice(NAMES)}.")
        rng.shuffle(text)
        if d % 10 == 3:  # a passing sentence
            other = next(a for a in AREAS if a not in mine)
            text[0] = f"Then {rng.choice(NAMES)} noted the {AREAS[other].split()[0]} and the {AREAS[other].split()[1]} there."
        rows.append((d, " ".join(text)))
        truth |= {(d, a) for a in mine if sum(any(w in t for w in AREAS[a].split()) for t in text) >= 2}
        labels += [(d, a) for a in mine] if labelled and d % 3 == 0 else []
    return rows, truth, labels


def test_subjects_on_held_out_documents(spark):
    rows, truth, labels = documents(240, random.Random(5))
    rows += [(900, None), (901, ""), (902, "Word"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("clash")).withColumn("labels", F.lit("clash"))
    lab = spark.createDataFrame(labels + [labels[0], (1, "unknown"), (5000, "law"), (None, "law"), (2, None)], "doc_id long, subject string")
    areas = spark.createDataFrame([(a,) for a in AREAS], "subject string")
    got = {(r.doc_id, r.subject) for r in subjects.prevailing(subjects.subject_areas(docs, lab, areas)).collect()}
    held = {x for x in truth if x[0] % 3}
    mine = {x for x in got if x[0] % 3}
    assert len(mine & held) >= 0.93 * len(held) and len(mine & held) >= 0.93 * len(mine)
    assert not {x for x in got if x[0] >= 900}


def test_subjects_of_nothing(spark):
    docs = spark.createDataFrame([(1, "Some words here.")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, subject string")
    areas = spark.createDataFrame([("law",)], "subject string")
    assert subjects.subject_areas(docs.limit(0), lab, areas).count() == 0
    assert subjects.prevailing(subjects.subject_areas(docs, lab, areas)).count() <= 1
