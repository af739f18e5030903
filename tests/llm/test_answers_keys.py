"""Defects where the counted keys are sent to every task, and where most of them are joined."""

import random

from lodestone.llm import answers
from tests.llm.test_answers_subjects import ANSWER_SCHEMA, NAMES, REFERENCE_SCHEMA, log


def cases(rng):
    rows = log(150, rng)
    refs = [(i, q, a, a, False) for i, q, a, _ in rows] + [(f"f{i}", f"Qui a fondé {n} Works ?", f"{n} a fondé la société en 1900.", "", False) for i, n in enumerate(NAMES * 3)]
    refs += [(f"n{i}", f"Who founded {n} Mills?", "The passages do not state this.", "", True) for i, n in enumerate(NAMES * 2)]
    asked = []
    for k, (_, q, a, f) in enumerate(log(60, rng)):
        asked.append((f"c{k}", "x", q, [a, f, q, "That is nothing we talk about here.", None, a.rsplit(" ", 2)[0]][k % 6], "", True))
    return asked, refs


def test_joined_keys_give_the_same_defects(spark):
    asked, refs = cases(random.Random(4))
    asked, refs = spark.createDataFrame(asked, ANSWER_SCHEMA), spark.createDataFrame(refs, REFERENCE_SCHEMA)
    sent = {(r.id, r.field): (r.defect, tuple(r.tags)) for r in answers.defects(asked, refs).collect()}
    joined = {(r.id, r.field): (r.defect, tuple(r.tags)) for r in answers.defects(asked, refs, broadcast_keys=40).collect()}
    assert sent == joined
    # a way to decline that no reference has, told by its coming back under unrelated questions
    assert {sent[(f"c{k}", "x")][0] for k in range(3, 60, 6)} == {"refusal"}


def test_language_of_a_question_that_leaves_it_open():
    assert answers.asked_language("Was stellt Lomdan Works her?", "Die Firma stellt vor allem Geräte her.") == "de"
    assert answers.asked_language("What does Lomdan Works make?", "") == "en"
    assert answers.asked_language("", "") == ""
