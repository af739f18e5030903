"""Several values in one field."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import packed

CASES = {
    None: [], "": [], "  ": [], "[]": [], '""': [], "a": ["a"], " a ; b;;c; ": ["a", "b", "c"], "|a | b|": ["a", "b"], "a, b": ["a", "b"], "X, Y; Z": ["X, Y", "Z"], "X, Y | Z": ["X, Y", "Z"],
    "smith/farrier / smith": ["smith/farrier", "smith"], '["a, b","c \\"d\\" e"]': ["a, b", 'c "d" e'], '"[""a"",""b \\""c\\""""]"': ["a", 'b "c"'], "['O''x', \"O'Neil\"]": ["O''x", "O'Neil"],
    '{"a, b",c}': ["a, b", "c"], "“a, b”, “c”": ["a, b", "c"], "(1) a (2) b, c (3) d": ["a", "b, c", "d"], "1. a\n2. b": ["a", "b"], '"a", "b"]': ["a", "b"], '["a", "b"': ["a", "b"], '["a","a",]': ["a", "a"],
    "a\nb, c\nd": ["a", "b, c", "d"], 'Joe "Big" Top; b': ['Joe "Big" Top', "b"], '["caf\\u00e9"]': ["café"], '"Joe ""Big"" Top", x': ['Joe "Big" Top', "x"], "R & D, x": ["R & D", "x"], '"open, b': ['"open', "b"],
}


@pytest.mark.parametrize("field", list(CASES), ids=lambda f: repr(f)[:30])
def test_cover(field):
    assert packed.cover(field) == CASES[field]


VALUE = st.text(st.characters(whitelist_categories=("Lu", "Ll")), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.builds(lambda a, b, c: a + c + b, VALUE, VALUE, st.sampled_from(["", ", ", " ", "; ", "-", " / "])), min_size=1, max_size=5))
def test_round_trip_of_quoted_notations(values):
    assert packed.cover(json.dumps(values)) == values
    assert packed.cover(json.dumps(values, ensure_ascii=False, separators=(",", ":"))) == values
    assert packed.cover('"' + json.dumps(values).replace('"', '""') + '"') == values
    assert packed.cover(repr(values)) == values
    assert packed.cover(", ".join(f"“{v}”" for v in values)) == values
    if all(";" not in v and " / " not in v for v in values) and len(values) > 1:
        assert packed.cover("; ".join(values)) == values


def fields(spark, *rows):
    return spark.createDataFrame([(i, "f", v) for i, v in enumerate(rows)], "key long, field string, packed string")


def unpacked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.key, r.pos)):
        out.setdefault(r.key, []).append(r.item)
        assert r.pos == len(out[r.key])
    return out


def test_known_values_protect_their_separator(spark):
    rows = fields(spark, '["Torran, Upper Ward", "x"]', '"Torran, Upper Ward"', "Old Torran, Torran, Upper Ward, b", "a, a", None, "", '["a, a"]', '["a, a", "q"]')
    want = {0: ["Torran, Upper Ward", "x"], 1: ["Torran, Upper Ward"], 2: ["Old Torran", "Torran, Upper Ward", "b"], 3: ["a", "a"], 6: ["a, a"], 7: ["a, a", "q"]}
    assert unpacked(packed.unpack(rows)) == want
    # a dictionary too large for one automaton is dealt to several, with the same result
    assert unpacked(packed.unpack(rows, automaton_bytes=0)) == want
    assert unpacked(packed.unpack(rows, automaton_bytes=7)) == want


def test_repeated_keys_and_empty_tables(spark):
    rows = fields(spark, "a;b", "c").unionByName(fields(spark, "a;b"))
    assert unpacked(packed.unpack(rows)) == {0: ["a", "b"], 1: ["c"]}
    assert packed.unpack(rows.limit(0)).count() == 0


def test_very_long_field():
    assert len(packed.cover("; ".join(["a, b"] * 20_000))) == 20_000
    assert len(packed.cover(", ".join(["a"] * 20_000))) == 20_000


def test_cover_cuts_the_fewest_known_values():
    text = "a, b, c, d"
    at = lambda part: (text.index(part), text.index(part) + len(part))
    assert packed.cover(text, {at("a, b"), at("c, d"), at("b, c, d")}) == ["a, b", "c, d"]
    assert packed.cover(text, {at("a, b"), at("a, b, c"), at("b, c")}) == ["a, b, c", "d"]
    assert packed.cover(text, {at("b, c")}) == ["a", "b, c", "d"]
    # spans that are no whole parts change nothing
    assert packed.cover("xa, bc", {(1, 5), (0, 5), (1, 6)}) == ["xa", "bc"]


def test_long_and_quoted_known_values_in_one_automaton_and_in_several(spark):
    long = ", ".join(f"part{i}" for i in range(15))
    partly = 'x, "y"'
    rows = fields(spark, json.dumps([long, "q"]), json.dumps([long]), f"k, {long}, z", json.dumps([partly, "q"]), json.dumps([partly]), partly, f"{partly}, z")
    got = unpacked(packed.unpack(rows))
    assert got[2] == ["k", long, "z"] and got[5] == [partly] and got[6] == [partly, "z"]
    for size in (len(long), 8, 0):
        assert unpacked(packed.unpack(rows, automaton_bytes=size)) == got
