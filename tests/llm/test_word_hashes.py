"""Words as hashes and batches in slices."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import text


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=40), st.integers(1, 15))
def test_windows_have_equal_values_only_where_their_words_are(words, length):
    hashes = text.word_hashes(" ".join(words))
    values = text.rolling(hashes, length)
    windows = [tuple(words[i : i + length]) for i in range(len(words) - length + 1)]
    assert len(values) == len(windows)
    assert len(set(zip(windows, values.tolist()))) == len(set(windows)) == len(set(values.tolist()))


def test_batch_windows_stay_within_their_text():
    texts = ["a b c d", None, "", "a b", "a b c"]
    words, places = text.batch_hashes(texts)
    values, of = text.batch_rolling(words, places, 3)
    assert of.tolist() == [0, 0, 4] and values[0] == values[2] == text.rolling(text.word_hashes("A, b! C"), 3)[0]


def test_words_are_letters_and_digits():
    assert np.array_equal(text.word_hashes("Ünïcode_Wörd x1"), text.word_hashes("ünïcode wörd X1"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=30), st.integers(1, 7), st.integers(1, 60))
def test_slices_hold_everything_in_order(texts, rows, size):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    parts = list(text.slices([batch], rows=rows, size=size))
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    for p in parts:
        total = sum(len((t or "").encode()) for t in p.column("text").to_pylist())
        assert p.num_rows <= rows and (p.num_rows == 1 or total <= size)
