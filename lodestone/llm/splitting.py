"""Cutting long texts into pieces at natural boundaries, by dynamic programming."""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token is a maximal run of letters, digits or underscores, or one other character that is not white space.
TOKEN = re.compile(r"\w+|[^\w\s]")
_TOKEN_JAVA = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{85}]"
CUTS = ("paragraph", "sentence", "line", "clause", "comma", "word", "inside")
PENALTY = np.array([0.0, 1.0, 2.0, 5.0, 8.0, 25.0, 80.0])
_PIECES = "kind string, id string, piece int, start int, tokens int, cut string, text string"


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_TOKEN_JAVA))


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: where it starts, where it ends, and the kind of boundary (index into CUTS) behind it."""
    found = list(TOKEN.finditer(text))
    starts, ends = (np.fromiter((f(m) for m in found), np.int64, len(found)) for f in (re.Match.start, re.Match.end))
    kinds = np.full(len(found), 5, dtype=np.int8)
    for i, m in enumerate(found[:-1]):
        gap = text[ends[i] : starts[i + 1]]
        token = m.group()
        if not gap:
            kinds[i] = 6
        elif gap.count("\n") > 1:
            kinds[i] = 0
        elif token in ".!?…" or token in "\"'”’)]" and i and found[i - 1].group() in ".!?…":
            kinds[i] = 1
        elif "\n" in gap:
            kinds[i] = 2
        elif token in ";:":
            kinds[i] = 3
        elif token == ",":
            kinds[i] = 4
    if len(found):
        kinds[-1] = 0
    return starts, ends, kinds


def best_cuts(kinds: np.ndarray, limit: int, overlap: int, balance: float = 6.0, per_piece: float = 4.0) -> list[int]:
    """Ends of the pieces (in tokens) of least total penalty, imbalance and number.

    Each piece but the first begins ``overlap`` tokens before the end of the one before. All natural boundaries are
    candidates; where two lie too far apart for one piece, every token between them is one too.
    """
    n = len(kinds)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    if n <= limit:
        return [n] if n else []
    step = limit - overlap
    natural = np.flatnonzero(kinds <= 4) + 1
    natural = natural[(natural > overlap) & (natural < n)]
    ends = [0]
    for c in [*natural.tolist(), n]:
        if c - ends[-1] > step:
            ends.extend(range(max(ends[-1], overlap) + 1, c))
        ends.append(c)
    at = np.unique(np.array(ends))
    ideal = limit if n <= limit else (n + (-(-(n - overlap) // step) - 1) * overlap) / -(-(n - overlap) // step)
    cost, back = np.full(len(at), np.inf), np.zeros(len(at), dtype=np.int64)
    cost[0] = 0
    low = np.searchsorted(at, at - step)
    for j in range(1, len(at)):
        i = np.arange(max(1, low[j]), j)
        total = cost[i] + balance * ((at[j] - at[i] + overlap - ideal) / ideal) ** 2
        if len(i):
            k = int(np.argmin(total))
            cost[j], back[j] = total[k], i[k]
        if at[j] <= limit and (first := balance * ((at[j] - ideal) / ideal) ** 2) < cost[j]:
            cost[j], back[j] = first, 0
        cost[j] += per_piece + (PENALTY[kinds[at[j] - 1]] if at[j] < n else 0)
    out, j = [], len(at) - 1
    while j:
        out.append(int(at[j]))
        j = back[j]
    return out[::-1]


def _pieces(batches, limit: int, overlap: int):
    names = ["kind", "id", "piece", "start", "tokens", "cut", "text"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for kind, key, text in zip(*(batch.column(c).to_pylist() for c in ("kind", "id", "text"))):
            starts, ends, kinds = boundaries(text)
            begin = 0
            for i, end in enumerate(best_cuts(kinds, limit, overlap)):
                rows.append((kind, key, i + 1, begin, end - begin, "end" if end == len(kinds) else CUTS[kinds[end - 1]], text[starts[begin] : ends[end - 1]]))
                begin = end - overlap
        columns = list(zip(*rows)) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)


def split_long(texts: DataFrame, limit: int = 550, overlap: int = 80) -> DataFrame:
    """Pieces of the texts of more than ``limit`` tokens: kind, id, piece (from 1), start (token), tokens, cut, text.

    ``texts``: kind string, id string, text. Texts within the limit, null and empty ones give no row; a key that
    comes twice counts once. No piece has more than ``limit`` tokens, and each repeats the last ``overlap`` tokens of the piece before.
    """
    long = texts.select("kind", "id", "text").where((F.length("text") > limit) & (token_count(F.col("text")) > limit))
    return long.dropDuplicates(["kind", "id"]).mapInArrow(partial(_pieces, limit=limit, overlap=overlap), _PIECES)
