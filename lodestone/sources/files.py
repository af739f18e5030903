"""Reading documents from files, and writing results to them."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "document_id string, document_name string, source_path string, page int, text string"
CHUNKS = "chunk_id string, document_id string, document_name string, page int, section string, text string, token_count int, char_count int"
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"BT(.*?)ET", re.S)
_LITERAL = re.compile(rb"\(((?:\\.|[^\\()])*)\)")
_ESCAPES = {b"n": b"\n", b"r": b"\n", b"t": b"\t", b"b": b"", b"f": b""}


def pdf_texts(content: bytes, printable: float = 0.8) -> list[str]:
    """The texts that the content streams of a PDF show, one a stream; streams of other data are left out.

    Understands literal strings in plain or deflated streams; text in other encodings is not recovered.
    """
    out = []
    for raw in _STREAM.findall(content):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        lines = []
        for shown in _SHOWN.findall(raw):
            parts = [re.sub(rb"\\(\d{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), x, flags=re.S) for x in _LITERAL.findall(shown)]
            lines.append(b"".join(parts).decode("latin-1"))
        text = "\n".join(x for x in lines if x.strip())
        if text and sum(c.isprintable() or c.isspace() for c in text) >= printable * len(text):
            out.append(text)
    return out


def _read(batches):
    for batch in batches:
        rows = {name: [] for name in ("document_id", "document_name", "source_path", "page", "text")}
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            name = path.rsplit("/", 1)[-1]
            stem, _, kind = name.rpartition(".")
            if kind.lower() == "pdf":
                found = [(f"{stem}-p{i}", i, t) for i, t in enumerate(pdf_texts(content), 1)]
            else:
                found = [(stem, 1, content.decode("utf-8", errors="ignore"))]
            for key, page, text in found:
                if text.strip():
                    for column, value in zip(rows, (key, name, path, page, text)):
                        rows[column].append(value)
        yield pa.RecordBatch.from_pydict(rows, pa.schema([("document_id", pa.string()), ("document_name", pa.string()), ("source_path", pa.string()), ("page", pa.int32()), ("text", pa.string())]))


def scan_document(spark: SparkSession, path: str) -> DataFrame:
    """Pages of one file, as ``scan_documents`` reads them; a file that is not there, or of another kind, is an error."""
    if not re.search(r"\.(txt|md|pdf)$", path, re.I):
        raise ValueError(f"unsupported kind of file: {path}")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_read, PAGES)


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of all .txt, .md and .pdf files below a folder: text files are one page, undecodable bytes are dropped, files and pages
    without text give no row. Other files are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").rlike(r"\.(txt|md|pdf)$")).select("path", "content").mapInArrow(_read, PAGES)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSONL file; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON, with what may be missing filled in."""
    rows = spark.read.schema(CHUNKS).option("multiLine", "true").json(path)
    return rows.na.fill({"section": "General", "token_count": 0}).withColumn("char_count", F.coalesce("char_count", F.length("text")))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None, mode: str = "overwrite") -> None:
    """Write a result as parquet, csv (with a header) or json, partitioned by a column where one is named."""
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown kind of file: {kind}")
    writer = df.write.mode(mode).option("header", "true")
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def write_index(chunks: DataFrame, path: str) -> None:
    """Write the index of chunks (term frequencies, lengths, statistics, vectors) as tables; postings are clustered by term."""
    from lodestone.functions import text as T
    from lodestone.operators import index

    index.term_frequencies(chunks).repartition("term").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    chunks.select("chunk_id", F.size(T.index_tokens(F.col("text"))).alias("length")).write.mode("overwrite").parquet(f"{path}/lengths")
    index.term_statistics(chunks).write.mode("overwrite").parquet(f"{path}/terms")
    index.embedded(chunks).write.mode("overwrite").parquet(f"{path}/vectors")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an index that ``write_index`` wrote, by name."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "lengths", "terms", "vectors")}


def local_index(documents: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Windows of characters as a searchable corpus: corpus_id (the document's name without its ending), document_id (of the window), text.

    ``documents``: doc_id, document_name, text; a null name gives a null corpus, which no route leads to.
    """
    from lodestone.operators import chunking

    named = documents.dropDuplicates(["doc_id"]).select("doc_id", F.regexp_replace("document_name", r"\.[^.]*$", "").alias("corpus_id"))
    windows = chunking.character_chunks(documents, size, overlap).join(named, "doc_id")
    return windows.select("corpus_id", F.concat_ws(":", F.col("doc_id").cast("string"), F.concat(F.lit("chunk-"), F.col("chunk_number").cast("string"))).alias("document_id"), "text")
