"""Passages of held-out items inside a corpus, by greedy string tiling.

Seeds (windows of consecutive words, as Karp-Rabin values) of the items are joined to those of the documents; each
(document, passage) that shares a seed is tiled: the longest common runs of words are marked one after another, never
twice, until none of the least length is left. Coverage by tiles is independent of their order, so reordered passages count.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import rolling, slices, word_hashes
from lodestone.session import materialise, small_enough

#: Seeds up to this number go to every task; more are joined by a shuffle, with the same result.
BROADCAST_SEEDS = 2_000_000
_SEEDS = "item_id string, part string, length int, seed long, at int, words int"
_HITS = "doc_id long, length int, seed long"
_TILES = "doc_id long, item_id string, part string, words int, longest int, covered int, tiles int"


def _item_seeds(batches, run: int, whole: bool):
    """Seeds of the passages with their places; of a question the first window only where it is looked for as a ``whole``."""
    for batch in batches:
        rows = []
        for item, part, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "part", "text"))):
            words = word_hashes(text)
            length = run if part == "context" else min(run, len(words))
            if length:
                values = rolling(words[:length] if whole and part == "question" else words, length).view(np.int64).tolist()
                rows += [(item, part, length, seed, at, len(words)) for at, seed in enumerate(values)]
        columns = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["item_id", "part", "length", "seed", "at", "words"])


def _document_seeds(batches, lengths: list[int], known):
    """Distinct seeds of each document; only those in ``known`` (by length, sorted) where it is given."""
    seeds = known.value if known is not None else None
    for batch in slices(batches):
        docs, sizes, values = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = word_hashes(text)
            for length in lengths:
                found = rolling(words, length).view(np.int64)
                if seeds is not None and len(found):
                    at = np.searchsorted(seeds[length], found)
                    found = found[seeds[length][np.minimum(at, len(seeds[length]) - 1)] == found]
                if len(found):
                    found = np.unique(found)
                    docs.append(np.full(len(found), doc))
                    sizes.append(np.full(len(found), length, dtype=np.int32))
                    values.append(found)
        cat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.empty(0), kind)
        yield pa.RecordBatch.from_arrays([cat(docs, pa.int64()), cat(sizes, pa.int32()), cat(values, pa.int64())], ["doc_id", "length", "seed"])


def _free_runs(words: np.ndarray, free: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and Karp-Rabin values of the windows of ``length`` words none of which is marked."""
    values = rolling(words, length)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[length:] == taken[: len(values)]) if len(values) else np.empty(0, np.int64)
    return at, values[at]


def _held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``among`` (sorted, not empty)."""
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def _longest(doc: np.ndarray, passage: np.ndarray, free_d: np.ndarray, free_p: np.ndarray, least: int) -> int:
    """Length of the longest common run of unmarked words, by bisection; 0 where none has ``least`` words."""
    low, high = least - 1, min(len(doc), len(passage))
    while low < high:
        middle = (low + high + 1) // 2
        values = np.sort(_free_runs(passage, free_p, middle)[1])
        if len(values) and _held(_free_runs(doc, free_d, middle)[1], values).any():
            low = middle
        else:
            high = middle - 1
    return low if low >= least else 0


def _matches(doc: np.ndarray, passage: np.ndarray, free_d: np.ndarray, free_p: np.ndarray, length: int):
    """(place in ``doc``, place in ``passage``) of common windows of ``length`` unmarked words, in order of the document, each with the
    first place in the passage that is unmarked when it is asked for."""
    places: dict[int, list[int]] = {}
    at, values = _free_runs(passage, free_p, length)
    among = np.sort(values)
    for p, value in zip(at[::-1].tolist(), values[::-1].tolist()):
        places.setdefault(value, []).append(p)  # the first is last
    at, values = _free_runs(doc, free_d, length)
    hits, end = _held(values, among), 0
    for d, value in zip(at[hits].tolist(), values[hits].tolist()):
        left = places[value] if d >= end else []
        while left and not free_p[left[-1] : left[-1] + length].all():
            left.pop()
        if left:
            end = d + length
            yield d, left.pop()


def tile(doc: np.ndarray, passage: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, place in ``doc``, place in ``passage``) of each tile, longest first.

    The windows of the greatest length that the unmarked words of both have in common are marked, then those of the next length. Of
    equally long matches the first in the document, then in the passage, is marked first. Where each window of ``least``
    words stands once in the passage, the runs of common windows are read off; else lengths are found by bisection. Empty sides or a
    side shorter than ``least`` give no tile. Time and memory grow with the words, not with the pairs of places.
    """
    if least < 1:
        raise ValueError("least must be positive")
    values, tiles = rolling(passage, least), []
    if not len(values) or len(doc) < least:
        return tiles
    order = np.argsort(values, kind="stable")
    among, seeds = values[order], rolling(doc, least)
    place = np.minimum(np.searchsorted(among, seeds), len(among) - 1)
    at_d = np.flatnonzero(among[place] == seeds)
    at_p = order[place[at_d]]
    once = not (among[1:] == among[:-1]).any()
    free_d, free_p = np.ones(len(doc), bool), np.ones(len(passage), bool)

    def unmarked(free: np.ndarray, at: np.ndarray) -> np.ndarray:
        taken = np.concatenate([[0], np.cumsum(~free)])
        return taken[at + least] == taken[at]

    while len(at_d):
        if once:
            ends = np.flatnonzero(np.append((np.diff(at_d) != 1) | (np.diff(at_p) != 1), True))
            sizes = np.diff(ends, prepend=-1)
            length = int(sizes.max()) + least - 1
            starts = (ends - sizes + 1)[sizes == sizes.max()]
            found = zip(at_d[starts].tolist(), at_p[starts].tolist())
        elif length := _longest(doc, passage, free_d, free_p, least):
            found = _matches(doc, passage, free_d, free_p, length)
        else:
            break
        for d, p in found:
            if free_d[d : d + length].all() and free_p[p : p + length].all() and (doc[d : d + length] == passage[p : p + length]).all():
                free_d[d : d + length] = free_p[p : p + length] = False
                tiles.append((length, d, p))
        left = unmarked(free_d, at_d) & unmarked(free_p, at_p) if once else unmarked(free_d, at_d)
        at_d, at_p = at_d[left], at_p[left]
    return tiles


def _tiled(batches, least: int):
    for batch in batches:
        rows = []
        for doc, item, part, text, passage in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "part", "text", "passage"))):
            words = word_hashes(passage)
            found = tile(word_hashes(text), words, least if part == "context" else min(least, len(words)))
            rows.append((doc, item, part, len(words), max((t[0] for t in found), default=0), sum(t[0] for t in found), len(found)))
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.string()] + [pa.int32()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "part", "words", "longest", "covered", "tiles"])


def tilings(documents: DataFrame, items: DataFrame, run: int = 13, least: int | None = None, reach: float = 0.0) -> DataFrame:
    """Tilings of each document with each passage with which it shares a seed.

    ``documents``: doc_id long, text. ``items``: item_id string, context, question. A seed is ``run`` words of a
    context, or the beginning of a question (the whole of a short one), as ``leaked`` asks for. Tiles have ``least`` words
    (``run`` where not given); where it is given, every window of so many words of contexts and questions is a seed, so
    that each pair with a tile is found. Pairs whose seeds lie on less than the share ``reach`` of a passage are not tiled:
    tiles consist of seeds, so they can't cover more. Null or empty texts share nothing; ids that come twice count once.
    """
    whole = least is None
    run, least = (run, run) if whole else (min(run, least), least)
    passages = items.select("item_id", F.explode(F.create_map(F.lit("context"), F.coalesce("context", F.lit("")), F.lit("question"), F.coalesce("question", F.lit("")))).alias("part", "text")).dropDuplicates(["item_id", "part"])
    seeds = materialise(passages.mapInArrow(partial(_item_seeds, run=run, whole=whole), _SEEDS), "seeds")
    documents = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    lengths = sorted(r[0] for r in seeds.select("length").distinct().collect())  # at most ``run`` values
    distinct = seeds.select("length", "seed").distinct()
    known = None
    if small := small_enough(seeds, BROADCAST_SEEDS):
        local = distinct.toPandas()
        known = documents.sparkSession.sparkContext.broadcast({n: np.sort(local.seed.to_numpy()[local.length == n]) for n in lengths})
    hits = documents.mapInArrow(partial(_document_seeds, lengths=lengths, known=known), _HITS)
    joined = hits.join(F.broadcast(seeds) if small else seeds, ["length", "seed"])
    pairs = joined.select("doc_id", "item_id", "part").distinct()
    if reach > 0:
        places = joined.groupBy("doc_id", "item_id", "part", "length", "words").agg(F.collect_set("at").alias("places"))
        held = F.size(F.array_distinct(F.flatten(F.transform("places", lambda at: F.sequence(at, at + F.col("length") - 1)))))
        pairs = places.where(held / F.col("words") >= reach).select("doc_id", "item_id", "part")
    pairs = materialise(pairs, "pairs")
    if known is not None:
        known.destroy()
    texts = documents.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    both = pairs.join(texts, "doc_id").join(passages.withColumnRenamed("text", "passage"), ["item_id", "part"])
    return both.mapInArrow(partial(_tiled, least=least), _TILES)


def leaked(tiled: DataFrame, run: int = 13) -> DataFrame:
    """(doc_id, item_id) with ``run`` or more consecutive words of the context, or with the whole question."""
    return tiled.where(((F.col("part") == "context") & (F.col("longest") >= run)) | ((F.col("part") == "question") & (F.col("longest") == F.col("words")) & (F.col("words") > 0))).select("doc_id", "item_id").distinct()


def coverage(tiled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Documents that hold at least ``threshold`` of an item's context or question in tiles, in whatever order."""
    share = F.col("covered") / F.col("words")
    return tiled.where((F.col("words") > 0) & (share >= threshold)).select("doc_id", "item_id", "part", "tiles", "longest", F.round(share, 6).alias("covered_share"))
