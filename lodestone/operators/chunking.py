"""Cutting pages into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as T
from lodestone.operators.running import total_before


def word_chunks(pages: DataFrame, size: int = 550, overlap: int = 80, bucket_pages: int = 8192) -> DataFrame:
    """Windows of ``size`` words that step by ``size - overlap``; a page within the size is one chunk, as it is.

    ``pages``: page_id long, document_id, page, text. A page_id that comes twice counts once; null and empty texts give no chunk.
    Chunks are numbered over all pages by page_id. A window without a heading has the section of the window before, the first
    the document's id.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    one = pages.where("page_id is not null and trim(text) != ''").dropDuplicates(["page_id"]).select("page_id", "document_id", "page", "text", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    n, step = F.size("w"), size - overlap
    # the first window, and each one that the window before did not already bring to the end
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < n)))
    # the windows are made before they are rows, so that no row carries the whole page
    body = F.when(n <= size, F.array(F.struct(n.alias("words"), F.col("text").alias("text")))).otherwise(
        F.transform(starts, lambda s: F.struct(F.least(F.lit(size), n - s).alias("words"), F.array_join(F.slice("w", s + 1, F.lit(size)), " ").alias("text")))
    )
    windows = one.select("page_id", "document_id", "page", F.posexplode(body).alias("i", "x")).select("page_id", "document_id", "page", "i", "x.words", "x.text")
    windows = windows.withColumn("head", T.heading(F.col("text")))
    order = Window.partitionBy("page_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    windows = windows.withColumn("section", F.coalesce(F.last("head", ignorenulls=True).over(order), F.col("document_id")))
    counts = one.select("page_id", F.size(starts).alias("chunks"), F.floor(F.col("page_id") / bucket_pages).alias("bucket"), F.lit(0).alias("all"))
    before = total_before(counts, ["all"], ["page_id"], "chunks", "bucket").select("page_id", "before")
    return windows.join(before, "page_id").select(
        F.concat("document_id", F.lit(":chunk-"), (F.col("before") + F.col("i")).cast("string")).alias("chunk_id"),
        "page_id", "document_id", "page", "section", F.col("words").cast("long").alias("words"), "text",
    )


def character_chunks(documents: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Windows of ``size`` characters over the squashed text, numbered by document: doc_id, chunk_number, text.

    Null and empty texts give no chunk; a blank window gives none but keeps its number.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    flat = documents.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", T.squashed(F.col("text")).alias("t")).where("t != ''")
    n, step = F.length("t"), size - overlap
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
    parts = F.transform(starts, lambda s: F.trim(F.substring("t", s + 1, F.lit(size))))
    out = flat.select("doc_id", F.posexplode(parts).alias("i", "text")).select("doc_id", (F.col("i") + 1).cast("long").alias("chunk_number"), "text")
    return out.where("text != ''")
