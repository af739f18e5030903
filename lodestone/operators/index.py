"""Index of chunks: term frequencies, term statistics, hashed vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

DIMENSIONS = 384
_WORD = regex.compile(T.WORD)


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk_id, term, tf. ``chunks``: chunk_id (once each), text; null and empty texts have no terms."""
    return chunks.select("chunk_id", F.explode(T.index_tokens(F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def collection(chunks: DataFrame) -> DataFrame:
    """One row: n, avgdl. Chunks without terms count too."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(T.index_tokens(F.col("text")))).alias("avgdl"))


def term_statistics(chunks: DataFrame) -> DataFrame:
    """term, df, idf."""
    df = chunks.select(F.explode(F.array_distinct(T.index_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = chunks.agg(F.count("*").alias("n"))
    return df.join(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5))).alias("idf"))  # n is one row


class _Cells(dict):
    """Cells of each word seen by this worker: of the word, and of its letter sequences of three and four."""

    def __missing__(self, word: str):
        if len(self) > 200_000:
            self.clear()
        own = int(hashlib.sha256(word.encode()).hexdigest()[:8], 16)
        parts = [int(hashlib.md5(word[i : i + n].encode()).hexdigest()[:8], 16) for n in (3, 4) for i in range(len(word) - n + 1)]
        cells = np.array([own % DIMENSIONS] + [h % DIMENSIONS for h in parts])
        signs = np.array([1.5 if own >> 8 & 1 else -1.5] + [0.5 if h >> 8 & 1 else -0.5 for h in parts])
        self[word] = cells, signs
        return self[word]


_CELLS = _Cells()


def vector(text: str | None) -> np.ndarray:
    """The hashed vector of a text, of length one; zero where it has no word. Earlier words weigh more."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(DIMENSIONS)
    found = [_CELLS[w] for w in words]
    values = np.concatenate([s for _, s in found])
    firsts = np.cumsum([0] + [len(s) for _, s in found[:-1]])
    values[firsts] /= 1 + 0.05 * np.log(np.arange(1, len(words) + 1))
    out = np.bincount(np.concatenate([c for c, _ in found]), weights=values, minlength=DIMENSIONS)
    norm = math.sqrt(float(out @ out))
    return out / norm if norm > 0 else out


def _embed(batches, key: str):
    for batch in batches:
        vectors = [vector(t) for t in batch.column("text").to_pylist()]
        flat = pa.array(np.concatenate(vectors) if vectors else np.empty(0))
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * DIMENSIONS)
        yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, flat)], [key, "vector"])


def embedded(rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, vector) of each text."""
    return rows.select(F.col(key).cast("string").alias(key), "text").mapInArrow(lambda b: _embed(b, key), f"{key} string, vector array<double>")
