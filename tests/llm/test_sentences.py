from lodestone.llm.subjects import sentences


def words(text):
    return [w for s in sentences(text) for w in s]


def test_no_word_is_lost():
    run = " ".join(f"w{i}" for i in range(48))
    assert words(run) == run.split()
    text = "# The heading\n\nFirst sentence of it all. Yes. > On Monday Ann wrote:\nSecond sentence of the text. No."
    assert sorted(words(text)) == sorted("the heading first sentence of it all yes on monday ann wrote second sentence of the text no".split())


def test_headings_are_no_sentences_of_their_own():
    assert sentences("# Heading\n\nOne two three four. Five six seven.") == [["heading", "one", "two", "three", "four"], ["five", "six", "seven"]]
    assert sentences("One two three. Tail.") == [["one", "two", "three", "tail"]]
    assert sentences("Two words") == [] and sentences("") == [] and sentences(None) == []


def test_long_runs_are_cut_into_pieces():
    assert [len(s) for s in sentences(" ".join("abc" for _ in range(48)))] == [14, 14, 20]
    assert [len(s) for s in sentences(" ".join("abc" for _ in range(52)))] == [14, 14, 14, 10]
