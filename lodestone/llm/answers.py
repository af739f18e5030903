"""Defective question-answer pairs, from clauses of the answer tagged by a conditional random field.

An answer is cut into clauses. A linear-chain conditional random field tags each as answer, refusal, echo (of the
question), foreign (another language than the question's) or unfinished; what share of the words each tag covers decides
the pair's defect. Which clauses are whole, how they go on, which words belong to a language and which turns of phrase recur
under unrelated questions is counted over all references and answers.

The field is trained on two bounded samples. Reference answers, which are whole, are taken as they are and made
defective: cut off, preceded or replaced by their question, put to a question in another language; references
that decline are refusals. Of the answers themselves those are taken all of whose clauses can be told by counts alone:
whole in a reference, in another script or language, or made of turns that no reference has though they recur under
unrelated questions, as ways to decline do. No wording of a refusal is given; no weight is set by hand.
"""

from __future__ import annotations

import io
import re
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise, small_enough

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: At most so many reference answers are trained on, and so many answers looked at for training, chosen by a hash of their id.
TRAINING_ANSWERS = 1_500
TRAINING_ASKED = 6_000
#: At most so many counted keys are sent to every task, the most frequent ones; the others are joined.
BROADCAST_KEYS = 2_000_000
BUCKETS = 512

#: Frequent function words by language.
COMMON = {
    "en": "the a an of in on at to for from by with and or but not no is are was were be been has have had do does did it its this that these who whom which what when where why how many much as than there their they he she his her i me my we us our you can could will would may must should about since also some any all more most only".split(),
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine keinen ist sind war waren wird werden wurde wurden hat haben hatte es sie er ihr sein seine ihre von vom zu zum zur in im an am auf aus bei mit nach für über unter vor seit durch wer was wo wann wie warum viele welche welcher welches dass so noch nur auch als".split(),
    "fr": "le la les un une des du de d l et ou mais ne n pas plus est sont était étaient a ont avait il elle ils elles on ce cet cette ces c qui que qu quoi quel quelle où quand comment combien pourquoi dans en sur sous par pour avec sans à au aux se s y sa son ses leur depuis".split(),
    "es": "el la los las un una unos unas de del y e o pero no es son fue era eran está están ha han había hay lo le se su sus que quién qué cuál dónde cuándo cómo cuánto cuántos cuántas en por para con sin sobre a al desde hasta esto esta este como más muy".split(),
    "it": "il lo la i gli le un uno una di del dello della dei degli delle da dal dalla e ed o ma non è sono era erano ha hanno aveva si ci ne su sul sulla nel nella nei che chi cosa quale dove quando come quanti quanto con per a al alla questo questa anche più".split(),
    "pt": "o a os as um uma uns umas de do da dos das e ou mas não é são foi era foram há tem se em no na nos nas por pelo pela para com sem que quem qual onde quando como quanto quantos ao à aos desde isto este esta seu sua mais".split(),
    "nl": "de het een van en of maar niet geen is zijn was waren wordt werd werden heeft hebben had er dit dat die deze wie wat waar wanneer hoe waarom veel in op aan te ten voor met door bij uit over naar om als ook nog sinds".split(),
    "pl": "i w we z ze na do od po za o u nie jest są był była było byli się to ten ta te tego tej który która które kto co gdzie kiedy jak ile dlaczego przez dla przy pod nad oraz ale lub czy już jego jej ich".split(),
    "sv": "och att det som en ett den de i på av för med till är var inte har hade om från sedan vem vad var när hur varför men eller sig sin sitt han hon vid efter under också".split(),
    "ru": "и в во не на с со что он она они оно как а но то все это этот эта к ко у из за от по о об для до при был была было были есть его её их кто где когда сколько почему или же".split(),
}
#: What stands for an answer where there is none.
PLACEHOLDERS = set("n a na none null nil nan tbd tba todo undefined empty blank unknown no text missing answer answers a q response output reply".split())
#: Alphabets by their first and last letter.
SCRIPTS = (("Ѐ", "ӿ", "ru"), ("Ͱ", "Ͽ", "el"), ("֐", "׿", "he"), ("؀", "ۿ", "ar"), ("぀", "ヿ", "ja"), ("一", "鿿", "zh"), ("가", "힯", "ko"))
#: English words for oneself, and of negation.
SELF, NEGATION = set("i i'm i'd i've i'll me my mine we we're us our".split()), set("not no none never nothing nobody cannot can't couldn't won't wouldn't don't didn't isn't unable nor neither".split())

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[^\w\s]|_")
_CLAUSE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|(?<=;)\s+|(?<=[^\W\d]:)\s+|,\s(?:yet|but)\s(?=[A-Z])|\n+")
_TAG = re.compile(r"<[^<>]{0,40}>")
_LETTER = re.compile(r"[^\W\d_]")
_STOPS = {w for words in COMMON.values() for w in words}
_NAMES = list(COMMON)
_SPOKEN = {w: [i for i, known in enumerate(COMMON.values()) if w in known] for w in _STOPS}
_ASKING = set("question asks asked q ask".split())


def _latin(text: str) -> bool:
    """Whether at most a fifth of the letters lie beyond the Latin ones."""
    if text.isascii():
        return True
    letters = _LETTER.findall(text)
    return 5 * sum(c > "ɏ" for c in letters) <= len(letters)


def words_of(text: str) -> list[str]:
    return [t for t in _TOKEN.findall(text) if t[0].isalnum()]


def clauses(answer: str | None) -> list[str]:
    """Clauses of an answer with at least a word each; none for an answer that says nothing."""
    text = _TAG.sub(" ", answer or "").replace("​", " ").replace("﻿", " ")
    out = [c.strip() for c in _CLAUSE.split(text)]
    out = [c for c in out if c and words_of(c)]
    if len(out) > 3 or len(text) > 80:
        return out
    words = [w.lower() for c in out for w in words_of(c)]
    return [] if len(words) <= 3 and all(w in PLACEHOLDERS for w in words) else out


def _scores(text: str) -> list[int]:
    """How many of a text's words are frequent in each language."""
    score = [0] * len(_NAMES)
    for t in words_of(text.lower()):
        for w in (t,) if t.isalnum() else re.split(r"['’]", t):
            for i in _SPOKEN.get(w, ()):
                score[i] += 1
    return score


def _spoken(text: str, rather: str) -> tuple[str, int]:
    """The language of a text, and how many more of its frequent words are there than of ``rather``'s."""
    if not text.isascii():
        letters = len(_LETTER.findall(text))
        for low, high, name in SCRIPTS:
            if letters and sum(low <= c <= high for c in text) * 3 > letters:
                return name, letters
    score = _scores(text)
    most, _, lang = max((n, name == rather, name) for n, name in zip(score, _NAMES))
    return (lang, most - (score[_NAMES.index(rather)] if rather in COMMON else 0)) if most else ("", 0)


def language(text: str, rather: str = "en") -> str:
    """The language whose frequent words a text holds most of, ``rather`` where it is one of several; the script's where it
    is not Latin; none where a text holds no frequent word."""
    return _spoken(text, rather)[0]


def asked_language(question: str, whole: str) -> str:
    """The language of a question; a whole answer to it decides where the words of the question leave it open."""
    own, score = language(question), _scores(question)
    best = sorted(score)[-2:]
    return own if own and (own not in COMMON or best[1] > best[0] + 1) else language(whole, own or "en") or own


def mask(clause: str) -> list[str]:
    """Tokens of a clause with names and numbers masked, without the stop at its end."""
    out = []
    for t in _TOKEN.findall(clause.rstrip(" .!?…\"'”’)")):
        low = t.lower()
        out.append("#" if any(c.isdigit() for c in t) else low if low in _STOPS or not t[0].isupper() else "X")
    return out


_ALL = (1 << 64) - 1
_SALTS = {kind: xxhash.xxh3_64_intdigest(kind) for kind in ("whole", "declined", "begin", "word", "lang", "pair")}
#: A recurring pair has the pair's key with these bits turned.
_RECURRING = 0x5851F42D4C957F2D


def _mix(h: int) -> int:
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _ALL
    return h ^ (h >> 32)


def _key(kind: str, h: int) -> int:
    return _mix(h ^ _SALTS[kind])


def _word_key(kind: str, *parts: str) -> int:
    return _key(kind, xxhash.xxh3_64_intdigest("\x1f".join(parts)))


def _plain_words(clause: str) -> list[str]:
    return [w.lower() for w in words_of(clause) if not w[0].isupper() and not any(c.isdigit() for c in w)]


class Clause:
    """A clause put to a question in a language: the values of all beginnings of its masked tokens (one running hash), and the keys
    of its pairs of tokens that hold a word."""

    def __init__(self, text: str, lang: str):
        self.text, tokens = text, mask(text)
        start = xxhash.xxh3_64_intdigest(lang)
        hashes, h, self.beginnings = [xxhash.xxh3_64_intdigest(t) for t in tokens], start, []
        for x in hashes:
            h = _mix((h * 0x9E3779B97F4A7C15 + x) & _ALL)
            self.beginnings.append(h)
        told = [t not in ("X", "#") and t[0].isalnum() for t in tokens]
        self.pairs = [_key("pair", ((start ^ a) * 0x9E3779B97F4A7C15 + b) & _ALL) for a, b, x, y in zip(hashes, hashes[1:], told, told[1:]) if x or y]
        self.cased = words_of(text)
        self.words = [w.lower() for w in self.cased]
        self.plain = [low for w, low in zip(self.cased, self.words) if not w[0].isupper() and not any(c.isdigit() for c in w)]


def _counted(keys: dict[int, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.fromiter(keys, np.uint64, len(keys)).view(np.int64)), pa.array(np.fromiter(keys.values(), np.int64, len(keys)))], ["key", "count"])


def _reference_keys(batches):
    """Keys that references count towards, once a reference, added up within a batch: whole clauses, how they begin, words, words of a
    language, pairs of tokens."""
    for batch in batches:
        counts: dict[int, int] = {}
        for question, answer, declined in zip(*(batch.column(c).to_pylist() for c in ("question", "answer", "declined"))):
            lang, mine = asked_language(question or "", answer or ""), set()
            for clause in (Clause(c, lang) for c in clauses(answer)):
                mine.add(_key("declined" if declined else "whole", clause.beginnings[-1]))
                mine.update(_key("begin", h) for h in clause.beginnings[:-1])
                mine.update(clause.pairs)
                mine.update(_word_key("word", w) for w in clause.words)
                mine.update(_word_key("lang", lang, w) for w in clause.plain)
            mine.update(_word_key("word", w.lower()) for w in words_of(question or ""))
            mine.update(_word_key("lang", lang, w) for w in _plain_words(question or ""))
            for key in mine:
                counts[key] = counts.get(key, 0) + 1
        yield _counted(counts)


def _pair_keys(batches):
    """Pairs of tokens of the answers in the question's language, and the least and greatest hash of the masked questions they stand under."""
    for batch in batches:
        seen: dict[int, list[int]] = {}
        for question, answer, whole in zip(*(batch.column(c).to_pylist() for c in ("question", "answer", "whole"))):
            lang, under = asked_language(question or "", whole or ""), xxhash.xxh3_64_intdigest(" ".join(mask(question or ""))) >> 1
            for key in {key for c in clauses(answer) for key in Clause(c, lang).pairs} if language(answer or "", lang) == lang else ():
                n = seen.setdefault(key, [0, under, under])
                n[0], n[1], n[2] = n[0] + 1, min(n[1], under), max(n[2], under)
        columns = [pa.array(np.fromiter(seen, np.uint64, len(seen)).view(np.int64))] + [pa.array([x[i] for x in seen.values()], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "count", "low", "high"])


class Pair:
    """A question with the clauses of an answer and what it asks of the counts."""

    def __init__(self, question: str | None, answer: str | None, others: str | None, whole: str | None):
        self.question, self.others = question or "", others or ""
        self.language = asked_language(self.question, whole or "")
        self.found, self.spoken = [Clause(c, self.language) for c in clauses(answer)], language(answer or "", self.language)
        keys = set()
        for c in self.found:
            whole = c.beginnings[-1]
            c.whole, c.declined, c.begin = _key("whole", whole), _key("declined", whole), _key("begin", whole)
            c.shorter = _key("begin", c.beginnings[-2]) if len(c.beginnings) > 1 else 0
            c.last, c.spoken = _word_key("word", c.words[-1]), {w: _word_key("lang", self.language, w) for w in c.plain}
            keys.update((c.whole, c.declined, c.begin, c.shorter, c.last), c.spoken.values(), c.pairs, (k ^ _RECURRING for k in c.pairs))
        self.keys = keys


_FLAGS = (
    "bias last ellipsis stop comma function whole declined begins cut_word unknown_last row_prefix in_row novel0 novel1 novel2 novel3 overlap covers asks asking "
    "same_language other_language far_language no_language strange strange_half names_only short whole_not_begun script strange_many "
    "new_pairs mostly_new recurring mostly_recurring self negation self_negation"
).split()
_AT = {name: i for i, name in enumerate(_FLAGS)}
WIDTH = len(_FLAGS) + BUCKETS


def _describe(pair: Pair, known: set[int]) -> tuple[list[list[float]], list[list[int]], list[int | None]]:
    """Of each clause: its flags, the buckets of its plain words, and the tag that counts alone tell, if they do."""
    asked = {w.lower() for w in words_of(pair.question)}
    row = {w.lower() for w in words_of(f"{pair.question} {pair.others}")}
    latin, rows, buckets, told, ends = _latin(pair.question), [], [], [], []
    for i, c in enumerate(pair.found):
        text, words, plain, lang = c.text, c.words, c.plain, pair.language
        last, end = words[-1], text.rstrip("\"'”’) ")[-1:]
        whole, declined, begins = c.whole in known, c.declined in known, c.begin in known
        unknown = c.last not in known and last not in row and not last.isdigit()
        strange = sum(c.spoken[w] not in known for w in (plain[:-1] if len(plain) > 1 and plain[-1] == last else plain))
        novel = sum(w not in asked and w not in _STOPS and w not in _ASKING and w not in PLACEHOLDERS for w in words)
        own, margin = _spoken(text, lang)
        script = latin and not _latin(text)
        new = [k for k in c.pairs if k not in known]
        recurring = sum(k ^ _RECURRING in known for k in new)
        size = max(1, len(c.pairs))
        overlap, covers = sum(w in asked for w in words) / len(words), len(asked & set(words)) / max(1, len(asked))
        cut_word = not whole and not begins and unknown and c.shorter in known
        row_prefix = last not in row and len(last) > 1 and end not in ".!?" and any(w.startswith(last) for w in row)
        mine, nots = any(w in SELF for w in words), any(w in NEGATION for w in words)
        far = own != "" and own != lang and margin > 1
        flags = {
            "bias": 1, "last": i == len(pair.found) - 1, "ellipsis": text.rstrip().endswith(("…", "..")), "stop": end in ".!?" and not text.rstrip().endswith(".."), "comma": end in ",:;-–—(", "function": last in _STOPS and last not in ("him", "her", "it"),
            "whole": whole, "declined": declined, "begins": begins and not whole, "cut_word": cut_word, "unknown_last": unknown and end not in ".!?", "row_prefix": row_prefix, "in_row": last in row,
            "novel0": novel == 0, "novel1": novel == 1, "novel2": novel == 2, "novel3": novel > 2, "overlap": overlap, "covers": covers, "asks": end == "?", "asking": any(w in _ASKING for w in words),
            "same_language": own != "" and own == lang, "other_language": own != "" and own != lang, "far_language": far, "no_language": own == "", "script": script,
            "strange": strange / max(1, len(plain)), "strange_half": strange * 2 > len(plain) > 1, "strange_many": strange > 1 and strange * 2 > len(plain) and own != lang, "names_only": not plain, "short": len(words) < 4, "whole_not_begun": whole and not begins,
            "new_pairs": len(new) / size, "mostly_new": 2 * len(new) > size, "recurring": recurring / size, "mostly_recurring": 2 * recurring > size, "self": mine, "negation": nots, "self_negation": mine and nots,
        }
        rows.append([float(flags[name]) for name in _FLAGS])
        buckets.append([xxhash.xxh3_64_intdigest(w) % BUCKETS for w in plain])
        ends.append(end)
        odd = pair.spoken == lang and own in (lang, "") and not begins and not cut_word and not row_prefix and len(c.pairs) > 1 and 2 * recurring >= size and overlap < 0.5
        tag = "foreign" if script or far else "echo" if min(overlap, covers) > 0.8 else "answer" if whole else "refusal" if declined or odd else None
        told.append(TAGS.index(tag) if tag else None)
    # what leads to an echo is part of it
    for i in range(len(told) - 1, 0, -1):
        if told[i] == TAGS.index("echo") and ends[i - 1] == ":":
            told[i - 1] = told[i]
    return rows, buckets, told


def _dense(flags: np.ndarray, buckets: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(flags), WIDTH), np.float32)
    if len(flags):
        out[:, : len(_FLAGS)] = flags
        out[np.repeat(np.arange(len(buckets)), [len(b) for b in buckets]), [len(_FLAGS) + x for b in buckets for x in b]] = 0.7
    return out


def _described(batch: pa.RecordBatch, hot: np.ndarray):
    """For a batch of pairs: the number of clauses of each, the features of all clauses, the numbers of words, and the tags told by counts.

    A key is known where it is in ``hot`` (sorted) or comes with its row.
    """
    pairs = [Pair(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("question", "answer", "others", "whole")))]
    keys = np.unique(np.array([k for p in pairs for k in p.keys], dtype=np.uint64).view(np.int64))
    at = np.searchsorted(hot, keys)
    found = keys[hot[np.minimum(at, len(hot) - 1)] == keys] if len(hot) else keys[:0]
    known = set(found.view(np.uint64).tolist())
    own = batch.column("known").to_pylist() if "known" in batch.schema.names else None
    flags, buckets, told = [], [], []
    for i, p in enumerate(pairs):
        f, b, t = _describe(p, known | {k & _ALL for k in own[i]} if own and own[i] else known)
        flags, buckets = flags + f, buckets + b
        told.append(t)
    sizes = np.array([len(c.words) for p in pairs for c in p.found], np.int64)
    return np.array([len(p.found) for p in pairs], np.int64), _dense(np.array(flags, np.float32), buckets), sizes, told


def _cut(rng, answer: str) -> str | None:
    body = answer.rstrip(" .!?")
    if len(body.split()) < 3:
        return None
    at = int(rng.integers(max(4, len(body) // 4), len(body)))
    cut = body[:at].rstrip() if rng.random() < 0.4 else body[:at].rsplit(None, 1)[0]
    return cut + str(rng.choice(["", "", "", "…", "...", " ..."])) if len(cut.split()) > 1 else None


def _shuffled(rng, question: str) -> str:
    words = question.rstrip(" ?").split()
    k = int(rng.integers(1, 3))
    return " ".join(words[k:] + words[:k]).strip() + "?"


def examples(row: dict, foreign: list[dict]) -> list[tuple[str, str, str, str, list[str]]]:
    """Training answers made from a whole one: question, answer, others, the whole answer, tags (one a clause). ``foreign``: references that may be
    in another language. The same row always gives the same examples."""
    rng, out = np.random.default_rng(xxhash.xxh3_64_intdigest(str(row["id"]))), []
    q, a, o = row["question"], row["answer"], row["others"] or ""
    lang, found = asked_language(q, a), clauses(a)
    kind, asked = "refusal" if row["declined"] else "answer", {w.lower() for w in words_of(q)}
    echoes = [min(sum(w in asked for w in c) / len(c), len(asked & set(c)) / max(1, len(asked))) > 0.8 for c in ([w.lower() for w in words_of(x)] for x in found)]
    plain = ["echo" if e else kind for e in echoes]

    def add(question, answer, others, tags, whole=a):
        if tags and len(clauses(answer)) == len(tags):
            out.append((question, answer, others, whole, tags))

    add(q, a, o, plain)
    if a.rstrip().endswith("."):
        add(q, a.rstrip()[:-1], o, plain)
    for _ in range(2):
        if kind == "answer" and (cut := _cut(rng, a)):
            add(q, cut, f"{o} {a}", plain[: len(clauses(cut)) - 1] + ["unfinished"])
    echo = str(rng.choice([q, q, q.upper(), q.lower(), q.rstrip(" ?") + ".", q.rstrip(" ?"), q + "?", "Question: " + q, "Q: " + q, f"{q} {q}", _shuffled(rng, q)]))
    add(q, echo, o, ["echo"] * len(clauses(echo)))
    if kind == "answer":
        add(q, f"{q} {a}", o, ["echo"] * (len(clauses(f"{q} {a}")) - len(found)) + plain)
    strangers = [s for s in foreign if s["language"] != lang]
    if strangers and lang:
        s = strangers[int(rng.integers(len(strangers)))]
        if language(s["answer"]) == s["language"] and not s["declined"]:
            add(q, s["answer"], o, ["foreign" if _plain_words(c) else "answer" for c in clauses(s["answer"])])
            if kind == "answer":
                add(s["question"], a, s["others"] or "", ["foreign" if _plain_words(c) else "answer" for c in found], s["answer"])
    # a clause of a language that the references do not hold: frequent words of it among names
    if lang in COMMON:
        other = str(rng.choice([x for x in _NAMES if x != lang]))
        name = " ".join(w for w in words_of(q) if w[:1].isupper()) or "A"
        words = [str(w) if rng.random() < 0.7 else name for w in rng.choice(COMMON[other], int(rng.integers(4, 9)))]
        clause = " ".join(words) + "."
        if _spoken(clause, lang)[0] == other:
            add(q, clause, o, ["foreign"])
    return out


def _made(batches, foreign):
    """Examples of references, with the tags of their clauses."""
    for batch in batches:
        made = [e for row in batch.to_pylist() for e in examples(row, foreign.value)]
        tags = [[TAGS.index(t) for t in e[4]] for e in made]
        yield pa.RecordBatch.from_arrays([*(pa.array([e[i] for e in made], pa.string()) for i in range(4)), pa.array(tags, pa.list_(pa.int32()))], ["question", "answer", "others", "whole", "tags"])


def _featured(batches, hot):
    """One row of arrays a batch: features of all clauses, their tags, and the number of clauses of each sequence. Where no tags
    are given, the sequences are taken whose every clause is told by the counts."""
    for batch in batches:
        lengths, x, _, told = _described(batch, hot.value)
        given = batch.column("tags").to_pylist()
        tags = [g if g is not None else t for g, t in zip(given, told)]
        keep = np.array([bool(t) and len(t) == n and None not in t for t, n in zip(tags, lengths)], bool)
        if keep.any():
            x, y = x[np.repeat(keep, lengths)], np.array([t for t, k in zip(tags, keep) if k for t in t], np.int8)
            # half of the foreign clauses shall be told by their strange words alone, as those of unlisted languages must
            half = np.array([xxhash.xxh3_64_intdigest(a or "") & 1 == 1 for a in batch.column("answer").to_pylist()], bool)
            blind = (y == TAGS.index("foreign")) & np.repeat(half, lengths)[np.repeat(keep, lengths)]
            for name in ("other_language", "far_language"):
                x[blind, _AT[name]] = 0
            x[blind, len(_FLAGS) :] = 0
            file = io.BytesIO()
            np.savez_compressed(file, x=x.astype(np.float16), y=y, lengths=lengths[keep])
            yield pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["arrays"])


def _parameters(theta: np.ndarray) -> dict:
    k, at = len(TAGS), WIDTH * len(TAGS)
    return {"emit": theta[:at].reshape(WIDTH, k), "step": theta[at : at + k * k].reshape(k, k), "first": theta[at + k * k :]}


SIZE = WIDTH * len(TAGS) + len(TAGS) ** 2 + len(TAGS)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the log-likelihoods of sequences, and its gradient: counted features less expected ones (forward and backward sums)."""
    model, k = _parameters(theta), len(TAGS)
    emit, starts = x @ model["emit"].astype(np.float32), np.cumsum(lengths) - lengths
    error, step, first, value = np.zeros((len(x), k)), np.zeros((k, k)), np.zeros(k), 0.0
    for n in np.unique(lengths[lengths > 0]):
        at = starts[lengths == n][:, None] + np.arange(n)
        e, gold = emit[at].astype(np.float64), np.eye(k)[y[at]]
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[:, 0] = e[:, 0] + model["first"]
        for i in range(1, n):
            ahead[:, i] = e[:, i] + _log_sum(ahead[:, i - 1, :, None] + model["step"], 1)
        for i in range(n - 2, -1, -1):
            behind[:, i] = _log_sum(model["step"] + (e[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        norm = _log_sum(ahead[:, -1], 1)
        wrong = gold - np.exp(ahead + behind - norm[:, None, None])
        error[at], first = wrong, first + wrong[:, 0].sum(axis=0)
        value += (e * gold).sum() + (gold[:, 0] @ model["first"]).sum() - norm.sum()
        for i in range(1, n):
            both = ahead[:, i - 1, :, None] + model["step"] + (e[:, i] + behind[:, i])[:, None, :] - norm[:, None, None]
            pair = np.einsum("ni,nj->ij", gold[:, i - 1], gold[:, i])
            step += pair - np.exp(both).sum(axis=0)
            value += (pair * model["step"]).sum()
    return value, np.concatenate([(x.T @ error.astype(np.float32)).ravel(), step.ravel(), first])


def climb(sums, steps: int, decay: float = 3e-4, memory: int = 8) -> np.ndarray:
    """Parameters of the greatest mean likelihood less ``decay`` times half their squares (limited-memory BFGS).
    ``sums``: theta -> (sum of likelihoods, its gradient, number of sequences)."""

    def down(theta):
        value, gradient, n = sums(theta)
        return (decay / 2 * theta @ theta - value / n, decay * theta - gradient / n) if n else (0.0, np.zeros_like(theta))

    theta, past = np.zeros(SIZE), []
    value, gradient = down(theta)
    while steps > 0 and np.abs(gradient).max() > 1e-5:
        d, left = -gradient, []
        for s, t in reversed(past):
            left.append(s @ d / (s @ t))
            d = d - left[-1] * t
        d = d * (past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / np.linalg.norm(gradient))
        for (s, t), a in zip(past, reversed(left)):
            d = d + (a - t @ d / (s @ t)) * s
        rate = 1.0
        while steps > 0:
            steps -= 1
            new = theta + rate * d
            new_value, new_gradient = down(new)
            if new_value <= value + 1e-4 * rate * (gradient @ d):
                break
            rate /= 3
        else:
            break
        if (new - theta) @ (new_gradient - gradient) > 1e-12:
            past = [*past, (new - theta, new_gradient - gradient)][-memory:]
        theta, value, gradient = new, new_value, new_gradient
    return theta


def train_field(features: list[np.ndarray], tags: list[list[int]], steps: int = 40) -> dict:
    """The field of sequences that are at hand."""
    x, y = np.concatenate([np.zeros((0, WIDTH), np.float32), *features]), np.array([t for ts in tags for t in ts], np.int64)
    lengths = np.array([len(f) for f in features], np.int64)
    return _parameters(climb(lambda theta: (*likelihood(theta, x, y, lengths), len(lengths)), steps))


def _sums(batches, theta):
    """Likelihood and gradient over the sequences of a partition."""
    value, gradient, n = 0.0, np.zeros(SIZE), 0
    for batch in batches:
        for blob in batch.column("arrays").to_pylist():
            data = np.load(io.BytesIO(blob))
            v, g = likelihood(theta, data["x"].astype(np.float32), data["y"], data["lengths"])
            value, gradient, n = value + v, gradient + g, n + len(data["lengths"])
    yield pa.RecordBatch.from_arrays([pa.array([value]), pa.array([gradient.tobytes()], pa.binary()), pa.array([n])], ["value", "gradient", "n"])


def fit(arrays: DataFrame, steps: int = 30) -> dict:
    """The field of the sequences in ``arrays``; every step adds up the gradients of the partitions (24 kB each)."""

    def sums(theta):
        rows = arrays.mapInArrow(partial(_sums, theta=theta), "value double, gradient binary, n long").collect()
        return sum(r.value for r in rows), sum((np.frombuffer(r.gradient) for r in rows), np.zeros(SIZE)), sum(r.n for r in rows)

    return _parameters(climb(sums, steps))


def best_paths(model: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest tags of each of several sequences (Viterbi), one after another."""
    emit, starts, out = x @ model["emit"], np.cumsum(lengths) - lengths, np.zeros(len(x), np.int64)
    for n in np.unique(lengths[lengths > 0]):
        at = starts[lengths == n][:, None] + np.arange(n)
        score, back = emit[at[:, 0]] + model["first"], []
        for i in range(1, n):
            total = score[:, :, None] + model["step"]
            back.append(total.argmax(axis=1))
            score = total.max(axis=1) + emit[at[:, i]]
        here = score.argmax(axis=1)
        out[at[:, -1]] = here
        for i in range(n - 2, -1, -1):
            here = np.take_along_axis(back[i], here[:, None], 1)[:, 0]
            out[at[:, i]] = here
    return out


def best_tags(model: dict, features: np.ndarray) -> list[int]:
    return best_paths(model, features, np.array([len(features)])).tolist()


def defect_of(tags: list[int], sizes: list[int], answerable: bool) -> str | None:
    """The defect of an answer from the share of its words under each tag; an answer without clauses is empty."""
    if not tags:
        return "empty"
    cover = {name: sum(s for t, s in zip(tags, sizes) if TAGS[t] == name) / sum(sizes) for name in TAGS}
    if cover["foreign"] >= 0.5:
        return "other_language"
    if cover["echo"] == 1:
        return "copies_question"
    if TAGS[tags[-1]] == "unfinished":
        return "truncated"
    if cover["refusal"] > 0 and cover["answer"] == 0 and cover["foreign"] == 0 and answerable:
        return "refusal"
    return None


def _tagged(batches, hot, model):
    for batch in batches:
        lengths, x, sizes, _ = _described(batch, hot.value)
        tags, ends = best_paths(model.value, x, lengths).tolist(), np.cumsum(lengths).tolist()
        found, spans = [], []
        for n, end, sure in zip(lengths.tolist(), ends, batch.column("answerable").to_pylist()):
            found.append(defect_of(tags[end - n : end], sizes[end - n : end].tolist(), bool(sure)))
            spans.append([TAGS[t] for t in tags[end - n : end]])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("field"), pa.array(found, pa.string()), pa.array(spans, pa.list_(pa.string()))], ["id", "field", "defect", "tags"])


def _asked_keys(batches):
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("id", "field", "question", "answer", "whole")))
        found = [(i, f, np.array(list(Pair(q, a, "", w).keys), np.uint64).view(np.int64)) for i, f, q, a, w in rows]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.list_(pa.int64()))], ["id", "field", "keys"])


def _with_known(answers: DataFrame, rest: DataFrame | None) -> DataFrame:
    """``answers`` with ``known``: those of its keys that are in ``rest``, the keys too many to be sent to every task."""
    if rest is None:
        return answers
    asked = answers.select("id", "field", "question", "answer", "whole").mapInArrow(_asked_keys, "id string, field string, keys array<long>")
    found = asked.select("id", "field", F.explode("keys").alias("key")).join(rest, "key").groupBy("id", "field").agg(F.collect_list("key").alias("known"))
    return answers.join(found, ["id", "field"], "left")


def defects(answers: DataFrame, references: DataFrame, training_answers: int = TRAINING_ANSWERS, training_asked: int = TRAINING_ASKED, broadcast_keys: int = BROADCAST_KEYS, partitions: int = 4) -> DataFrame:
    """Tags and defect of each answer: id, field, defect (null where there is none), tags (one a clause).

    ``answers``: id, field, question, answer, others (further texts of the row), answerable (whether declining is a defect), and perhaps
    whole (a whole answer, which tells the language where the words of the question do not).
    ``references``: id, question, answer (whole ones), others, declined (whether the answer declines). Keys that come twice count once. A null,
    empty or placeholder answer is ``empty``; a null question counts as empty. Without references the field is untrained and only
    empty answers are told.
    """
    spark = answers.sparkSession
    context = spark.sparkContext
    whole = F.col("whole") if "whole" in answers.columns else F.lit("").alias("whole")
    answers = answers.select("id", "field", "question", "answer", "others", "answerable", whole).where("id is not null and field is not null").dropDuplicates(["id", "field"])
    answers = materialise(answers, "answers")
    references = materialise(references.select("id", "question", "answer", "others", "declined").where("id is not null and question is not null and answer is not null").dropDuplicates(["id"]), "references")

    # keys that two references have, and pairs of tokens that no two references have but three answers to different questions
    counts = references.select("question", "answer", "declined").mapInArrow(_reference_keys, "key long, count long").groupBy("key").agg(F.sum("count").alias("count")).where("count > 1")
    counts = materialise(counts, "counts")
    pairs = answers.select("question", "answer", "whole").mapInArrow(_pair_keys, "key long, count long, low long, high long").groupBy("key").agg(F.sum("count").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
    recurring = pairs.where("count > 2 and low < high").join(counts, "key", "left_anti").select(F.col("key").bitwiseXOR(F.lit(_RECURRING)).alias("key"), "count")
    known = materialise(counts.unionByName(recurring), "known")
    rest = None
    if not small_enough(known, broadcast_keys):
        # of a sum of counts, at most ``broadcast_keys`` keys can have that part of it each
        least = known.agg(F.sum("count")).first()[0] / broadcast_keys
        rest, known = known.where(F.col("count") < least).select("key"), known.where(F.col("count") >= least)
    hot = context.broadcast(np.sort(known.select("key").toPandas().key.to_numpy(np.int64)))

    sample = materialise(references.orderBy(F.xxhash64("id"), "id").limit(training_answers), "sample")
    # of bounded size
    foreign = [r.asDict() | {"language": asked_language(r.question, r.answer)} for r in sample.select("id", "question", "answer", "others", "declined").orderBy("id").collect()]
    strangers = context.broadcast([r for r in foreign if r["language"]])
    made = sample.repartition(partitions, "id").mapInArrow(partial(_made, foreign=strangers), "question string, answer string, others string, whole string, tags array<int>")
    made = made.select(F.monotonically_increasing_id().cast("string").alias("id"), F.lit("made").alias("field"), "question", "answer", "others", "whole", "tags")
    looked = answers.orderBy(F.xxhash64("id", "field"), "id", "field").limit(training_asked).select("id", "field", "question", "answer", "others", "whole", F.lit(None).cast("array<int>").alias("tags"))
    train = made.unionByName(looked.repartition(partitions, "id"))
    train = train if rest is None else materialise(train, "train")
    columns = ["question", "answer", "others", "whole", "tags"] + ([] if rest is None else ["known"])
    arrays = materialise(_with_known(train, rest).select(*columns).mapInArrow(partial(_featured, hot=hot), "arrays binary"), "arrays")
    model = context.broadcast(fit(arrays))
    columns = ["id", "field", "question", "answer", "others", "whole", "answerable"] + ([] if rest is None else ["known"])
    found = _with_known(answers, rest).select(*columns).mapInArrow(partial(_tagged, hot=hot, model=model), "id string, field string, defect string, tags array<string>")
    found = materialise(found, "defects")
    for sent in (hot, strangers, model):
        sent.destroy()
    return found
