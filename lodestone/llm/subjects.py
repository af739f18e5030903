"""Subject areas of documents, from averaged word and subword embeddings with independent logistic outputs.

A sentence is the mean of its words' vectors, a word the mean of its own and its letter sequences' vectors; each area has
a logistic output. Labels are given to whole documents. Training has two phases: first every sentence of a document stands
for all its labels; then, with the first model as teacher, for those labels of its document that it speaks for. In every
step each partition computes the gradient over its sentences, the sums are added, and one update is made. Then every
document is scored sentence by sentence, and an area counts where enough of the sentences deal with it.
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

from lodestone.llm.text import WORD, slices
from lodestone.session import materialise

#: At most so many labelled documents are trained on, chosen by a hash of their id.
LABELLED_DOCUMENTS = 3_000
#: More areas than this are refused, since every model holds an output an area.
MOST_SUBJECTS = 10_000
BUCKETS = 1 << 14
DIMENSIONS = 12
_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n+")
_LEAD = re.compile(r"^[\s>*•#|-]+")
_HEADING = re.compile(r"^\s*#{1,6}\s|^\s*>.*\bwrote:\s*$")


def sentences(text: str | None, longest: int = 40, piece: int = 14) -> list[list[str]]:
    """Words of each sentence. Headings, leads of quotations and sentences of one or two words go with the sentence that
    follows (with the last one at the end of a text); a run without an end is cut into pieces, the last of which takes the rest."""
    out, ahead = [], []
    for part in _END.split(text or ""):
        words = WORD.findall(_LEAD.sub("", part).lower()) if part else []
        if len(words) < 3 or _HEADING.match(part):
            ahead += words
        elif len(words) > longest:
            cuts = [*range(0, len(words) - piece // 2, piece), len(words)]
            out += [words[i:j] for i, j in zip(cuts, cuts[1:])]
            out[1 - len(cuts)], ahead = ahead + out[1 - len(cuts)], []
        else:
            out, ahead = [*out, ahead + words], []
    if ahead and out:
        out[-1] = out[-1] + ahead
    return out


def features(word: str) -> list[int]:
    """Buckets of a word and of its letter sequences of four."""
    marked = f"<{word}>"
    return [xxhash.xxh3_64_intdigest(word) % BUCKETS] + [BUCKETS + xxhash.xxh3_64_intdigest(marked[i : i + 4]) % BUCKETS for i in range(0, max(1, len(marked) - 3))]


def _saved(data: dict) -> pa.RecordBatch:
    file = io.BytesIO()
    np.savez(file, **data)
    return pa.RecordBatch.from_arrays([pa.array([file.getvalue()], pa.binary())], ["arrays"])


def _loaded(batches):
    for batch in batches:
        for blob in batch.column("arrays").to_pylist():
            data = np.load(io.BytesIO(blob))
            yield {k: data[k] for k in data.files}


def _packed(batches, subjects: list[str]):
    """Training sentences of a batch as one row of arrays: words of each sentence, buckets of each word, targets."""
    place = {s: i for i, s in enumerate(subjects)}
    for batch in batches:
        vocabulary: dict[str, int] = {}
        words, ends, targets = [], [0], []
        for text, labels in zip(batch.column("text").to_pylist(), batch.column("labels").to_pylist()):
            y = np.zeros(len(subjects), dtype=np.float32)
            y[[place[s] for s in labels if s in place]] = 1
            for sentence in sentences(text):
                words += [vocabulary.setdefault(w, len(vocabulary)) for w in sentence]
                ends.append(len(words))
                targets.append(y)
        if targets:
            of = [features(w) for w in vocabulary]
            yield _saved({
                "words": np.array(words, np.int32), "ends": np.array(ends, np.int64), "targets": np.array(targets, np.float32),
                "buckets": np.concatenate(of).astype(np.int32), "starts": np.cumsum([0, *map(len, of)]).astype(np.int64),
            })


def _forward(model: dict, data) -> tuple[np.ndarray, ...]:
    sizes = np.diff(data["starts"])[:, None]
    vectors = np.add.reduceat(model["embedding"][data["buckets"]], data["starts"][:-1]) / sizes
    counts = np.diff(data["ends"])[:, None]
    means = np.add.reduceat(vectors[data["words"]], data["ends"][:-1]) / counts
    return means, 1 / (1 + np.exp(-(means @ model["output"] + model["bias"]))), sizes, counts


def _sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(index, weights=values[:, k], minlength=size) for k in range(values.shape[1])], axis=1)


def _spoken_for(batches, teacher, trust: np.ndarray):
    """The sentences with those of their targets that the teacher speaks for: it believes in them clearly more than of just
    any sentence under the label, and not much less than in another label of the document."""
    for data in _loaded(batches):
        belief = _forward(teacher.value, data)[1]
        best = (belief * data["targets"]).max(axis=1, keepdims=True)
        kept = (data["targets"] > 0) & (belief >= 0.6 * best) & (belief >= trust)
        yield _saved(data | {"targets": kept.astype(np.float32)})


def _gradients(batches, model):
    """Sum of the gradients over the sentences of a partition, as half-precision parts of its greatest entry."""
    model, total, seen = model.value, None, 0
    for data in _loaded(batches):
        means, p, sizes, counts = _forward(model, data)
        error = (p - data["targets"]).astype(np.float32)
        back = (error @ model["output"].T) / counts
        words = _sums(np.repeat(back, counts[:, 0], axis=0), data["words"], len(sizes)) / sizes
        embedding = _sums(np.repeat(words, sizes[:, 0], axis=0), data["buckets"], 2 * BUCKETS)
        flat = np.concatenate([embedding.ravel(), (means.T @ error).ravel(), error.sum(axis=0)])
        total, seen = flat if total is None else total + flat, seen + len(p)
    if total is not None:
        scale = float(np.abs(total).max()) or 1.0
        yield pa.RecordBatch.from_arrays([pa.array([(total / scale).astype(np.float16).tobytes()], pa.binary()), pa.array([scale]), pa.array([seen])], ["gradient", "scale", "seen"])


def train(labelled: DataFrame, subjects: list[str], steps: tuple[int, int] = (40, 60), rate: float = 0.1, decay: float = 1e-5, partitions: int = 4, seed: int = 3) -> dict:
    """The model from ``labelled`` (text, labels array<string>). No labelled sentences give the untrained model.

    In each step every partition gives one gradient of fixed size, and the driver makes one update; nothing of a step stays behind.
    """
    spark = labelled.sparkSession
    context = spark.sparkContext
    labelled = materialise(labelled, "labelled")
    packed = materialise(labelled.repartition(partitions).mapInArrow(partial(_packed, subjects=subjects), "arrays binary"), "sentences")
    given = {r[0]: r[1] for r in labelled.select(F.explode("labels").alias("label")).groupBy("label").count().collect()}  # a row a subject
    total = max(1, labelled.count())
    trust = 0.5 + 0.5 * np.array([given.get(s, 0) / total for s in subjects])
    rng, n = np.random.default_rng(seed), len(subjects)
    model = {
        "embedding": rng.normal(0, 0.3, (2 * BUCKETS, DIMENSIONS)).astype(np.float32),
        "output": rng.normal(0, 0.3, (DIMENSIONS, n)).astype(np.float32),
        "bias": np.full(n, -2.0, np.float32),
    }
    for phase, phase_steps in enumerate(steps):
        if phase:
            teacher = context.broadcast(model)  # of fixed size
            packed = materialise(packed.mapInArrow(partial(_spoken_for, teacher=teacher, trust=trust), "arrays binary"), "sentences")
            teacher.destroy()
        first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
        for t in range(1, phase_steps + 1):
            shared = context.broadcast(model)  # of fixed size
            rows = packed.mapInArrow(partial(_gradients, model=shared), "gradient binary, scale double, seen long").collect()
            shared.destroy()
            seen = sum(r.seen for r in rows)
            if not seen:
                return model
            flat, at, new = sum(np.frombuffer(r.gradient, np.float16).astype(np.float32) * np.float32(r.scale) for r in rows) / seen, 0, {}
            for k in model:
                g = flat[at : at + model[k].size].reshape(model[k].shape) + decay * model[k]
                at += model[k].size
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                new[k] = (model[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            model = new
    return model


class _Logits(dict):
    """Row of each word seen by this worker in ``rows``: the word's part of every area's logit."""

    def __init__(self, model: dict):
        super().__init__()
        self.table = model["embedding"] @ model["output"]
        self.rows = np.zeros((1 << 15, self.table.shape[1]))

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        if row >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[row] = self.table[features(word)].mean(axis=0)
        return row


_KNOWN: dict = {}


def _scores(batches, model, name: str, subjects: list[str], belief: float, lead: float, most_words: int = 400_000):
    if name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[name] = _Logits(model.value)
    bias, limit = model.value["bias"], np.log(belief / (1 - belief))
    names = np.array(subjects, dtype=object)
    for batch in slices(batches):
        if len(_KNOWN[name]) > most_words:  # forget, so that memory stays bounded
            _KNOWN[name] = _Logits(model.value)
        words = _KNOWN[name]
        found = [sentences(t) for t in batch.column("text").to_pylist()]
        flat = [s for d in found for s in d]
        if not flat:
            continue
        lengths = np.array([len(s) for s in flat])
        index = np.fromiter((words[w] for s in flat for w in s), np.int64, lengths.sum())
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        logits = np.add.reduceat(words.rows[index], starts) / lengths[:, None] + bias
        about = (logits >= limit) & (logits >= logits.max(axis=1, keepdims=True) - lead)
        counts = np.array([len(d) for d in found])
        hits = np.zeros((len(found), len(names)), np.int32)
        np.add.at(hits, np.repeat(np.arange(len(found)), counts), about.astype(np.int32))
        doc, area = np.nonzero(hits)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), pa.array(names[area].tolist(), pa.string()), pa.array(hits[doc, area]), pa.array(counts[doc].astype(np.int32))], ["doc_id", "subject", "hits", "sentences"]
        )


def subject_areas(documents: DataFrame, labels: DataFrame, subjects: DataFrame, belief: float = 0.35, lead: float = 0.7, labelled_documents: int = LABELLED_DOCUMENTS, **training) -> DataFrame:
    """Sentences of each document that deal with an area: doc_id, subject, hits, sentences; areas without one have no row.

    ``documents``: doc_id long, text. ``labels``: doc_id, subject. ``subjects``: subject. Null or empty texts have no sentences and no rows; ids and labels that come twice count once; labels of unknown
    subjects or documents are ignored. A sentence deals with an area at a probability of ``belief`` or more, unless another
    area's logit is higher by over ``lead``. The model is fitted to at most ``labelled_documents`` documents.
    """
    import uuid

    spark = documents.sparkSession
    names = sorted(r[0] for r in subjects.where("subject is not null").select("subject").distinct().limit(MOST_SUBJECTS + 1).collect())
    if len(names) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    given = labels.where("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("labels"))
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_documents)
    texts = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    labelled = texts.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"])  # of bounded size
    model = spark.sparkContext.broadcast(train(labelled, names, **training))
    scored = texts.mapInArrow(partial(_scores, model=model, name=uuid.uuid4().hex, subjects=names, belief=belief, lead=lead), "doc_id long, subject string, hits int, sentences int")
    scored = materialise(scored.dropDuplicates(["doc_id", "subject"]), "scored")
    model.destroy()
    return scored


def prevailing(scored: DataFrame, share: float = 0.2, least: int = 2) -> DataFrame:
    """Areas that at least ``share`` of a document's sentences deal with, and at least ``least`` of them
    (all of them in shorter documents)."""
    return scored.where((F.col("hits") >= F.least(F.lit(least), F.col("sentences"))) & (F.col("hits") >= share * F.col("sentences")))
