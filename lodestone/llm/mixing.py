"""Mixing sources to target shares of all tokens, by a low-discrepancy schedule.

Golden-ratio points are mapped through the cumulative weights, so each stretch of the schedule holds every source in
its share. The slots of a source are ranked; its records, shuffled by a hash, are laid end to end and cut into blocks of
equal tokens, also within a record; the block of rank r fills the source's slot of rank r.
"""

from __future__ import annotations

import base64
import math
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.running import total_before
from lodestone.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public tokenizer's pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GOLDEN = (math.sqrt(5) - 1) / 2
_ENCODINGS: dict = {}


def _built(vocabulary: bytes):
    key = hash(vocabulary)
    if key not in _ENCODINGS:  # once a worker
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def _encoding(path: str):
    return _built(Path(path).read_bytes())


def _sizes(batches, vocabulary):
    encoding = _built(vocabulary.value)
    for batch in batches:
        sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], ["doc_id", "source", "tokens"])


def source_name(source: Column) -> Column:
    """The proper spelling of a source: lower case, trimmed, words joined by underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def plan_shares(targets: list[tuple[str, float, int]], tokens: dict[str, int]) -> tuple[list[tuple[str, float, int]], float]:
    """Sources that can be used with their weights (the shares of those that have tokens, made to sum to 1) and repeats,
    and the largest total at which every one of them reaches its share within its repeats."""
    usable = [(s, w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and tokens.get(s, 0) > 0]
    whole = sum(w for _, w, _ in usable)
    usable = [(s, w / whole, r) for s, w, r in usable]
    return usable, min((tokens[s] * r / w for s, w, r in usable), default=0.0)


def _bits(rows: int, rows_each: int = 50_000) -> int:
    return max(0, math.ceil(math.log2(max(1, rows / rows_each))))


def mix(documents: DataFrame, targets: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """The mix of ``blocks`` (which see) with one row a use of a record, and the shares it reaches.

    Returns ``mixed`` (slot, offset, doc_id, source, pass, tokens): where the record begins, and how many of its tokens are
    used; what the slot cannot hold of it goes on in the source's next one. And ``shares``.
    """
    pieces, shares = blocks(documents, targets, **how)
    mixed = pieces.groupBy("source", "doc_id", "pass").agg(F.min(F.struct("slot", "offset")).alias("at"), F.sum("tokens").alias("tokens"))
    return mixed.select("at.slot", "at.offset", "doc_id", "source", "pass", "tokens"), shares


def blocks(documents: DataFrame, targets: DataFrame, block: int = 1024, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix as blocks of equal tokens, and the shares it reaches.

    ``documents``: doc_id long, text, source. ``targets``: source, target_share, max_repeats (at most a few thousand
    rows; they are planned on the driver with one token sum a source). Ids that come twice count once; documents with a null
    or untargeted source, without text or without tokens are not used. Sources without documents cannot be used, and their
    share goes to the others in proportion. The total is the largest at which every usable source reaches its share
    within its repeats, or ``total_tokens``; with a larger one, sources that are used up fall short and the shares show it. Empty tables give an empty mix and shares of zero.

    Returns ``pieces`` (slot, offset, doc_id, source, pass, start, tokens), read in order of slot and offset: ``tokens`` tokens of the
    record from its token ``start`` on, at ``offset`` in the slot. Every slot is full, but for the last of a source that is used up. And
    ``shares`` (source, target_share, max_repeats, available_tokens, used_tokens, actual_share, records, most_uses), a row a target.
    ``tokenizer`` is a file that only the driver reads.
    """
    spark = documents.sparkSession
    named = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).where("doc_id is not null and source is not null and length(text) > 0")
    named = named.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi") if targets.limit(10_001).count() <= 10_000 else named.join(targets.select("source"), "source", "left_semi")
    vocabulary = spark.sparkContext.broadcast(Path(tokenizer).read_bytes())  # a vocabulary, some 1 MB
    sizes = named.select("doc_id", "source", "text").mapInArrow(partial(_sizes, vocabulary=vocabulary), "doc_id long, source string, tokens long")
    sizes = materialise(sizes.where("tokens > 0").dropDuplicates(["doc_id"]), "sizes")
    vocabulary.destroy()
    sums = {r.source: (r.tokens, r.rows) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).collect()}
    wanted = [(r.source, r.target_share, r.max_repeats) for r in targets.dropDuplicates(["source"]).select("source", "target_share", "max_repeats").orderBy("source").collect()]
    usable, most = plan_shares(wanted, {s: t for s, (t, _) in sums.items()})
    total = total_tokens if total_tokens and usable else most
    slots = max(1, int(total // block)) if usable else 0

    # the schedule: slot -> source, and its rank among the source's slots
    cumulative, names = [], [s for s, _, _ in usable]
    for _, w, _ in usable:
        cumulative.append((cumulative[-1] if cumulative else 0.0) + w)
    i = F.col("id")
    high, low = F.floor(i / F.lit(1 << 20)), i % F.lit(1 << 20)
    point = high * F.lit((GOLDEN * (1 << 20)) % 1) + low * F.lit(GOLDEN)
    point = point - F.floor(point)
    bounds = F.array(*[F.lit(float(c)) for c in cumulative[:-1]]) if len(names) > 1 else F.array().cast("array<double>")
    pick = F.size(F.filter(bounds, lambda c: c <= F.col("point")))
    schedule = spark.range(slots).withColumn("point", point).select(
        F.col("id").alias("slot"), F.element_at(F.array(*[F.lit(n) for n in names] or [F.lit("")]), pick + 1).alias("source"),
        F.floor(F.col("id") / 65_536).alias("bucket"), F.lit(1).cast("long").alias("one"),
    )
    schedule = materialise(total_before(schedule, ["source"], ["slot"], "one", "bucket").select("slot", "source", F.col("before").alias("block")), "schedule")

    # the records of each pass, shuffled, end to end
    parts = [(s, sums[s][0], min(r, -(-int(total * w + 3 * block) // sums[s][0])), math.ceil(total * w / block) + 3) for s, w, r in usable]
    limits = spark.createDataFrame(parts or [("", 1, 0, 0)], "source string, all long, passes int, blocks long")
    if not total_tokens:
        # the schedule ends where it would ask a source for a block that is not there
        held = spark.createDataFrame([(s, -(-sums[s][0] * r // block)) for s, _, r in usable] or [("", 0)], "source string, held long")
        end = schedule.join(F.broadcast(held), "source").where("block >= held").agg(F.min("slot")).first()[0]
        schedule = schedule if end is None else schedule.where(F.col("slot") < end)
    bits = _bits(max([r for _, r in sums.values()], default=1))
    uses = (
        sizes.join(F.broadcast(limits), "source")  # a row a usable source
        .where("passes > 0")
        .withColumn("pass", F.explode(F.expr("sequence(0, passes - 1)")))
        .withColumn("order", F.xxhash64(F.lit(seed), "pass", "doc_id"))
        .withColumn("bucket", F.shiftright("order", 63 - bits) if bits else F.lit(0).cast("long"))
    )
    laid = total_before(uses, ["source", "pass"], ["order", "doc_id"], "tokens", "bucket")
    laid = laid.withColumn("place", F.col("pass") * F.col("all") + F.col("before"))
    first, last = F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("tokens") - 1) / block)
    laid = laid.withColumn("block", F.explode(F.sequence(first, last))).where("block < blocks")
    start, end = F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("place")), F.least("tokens", (F.col("block") + 1) * block - F.col("place"))
    laid = laid.select("source", "block", "doc_id", "pass", start.alias("start"), (end - start).alias("tokens"), (F.col("place") + start - F.col("block") * block).alias("offset"))
    used = materialise(schedule.join(laid, ["source", "block"]).select("slot", "offset", "doc_id", "source", "pass", "start", "tokens"), "mixed")
    # a record's pieces of one pass are one use
    per_use = used.groupBy("source", "doc_id", "pass").agg(F.sum("tokens").alias("tokens"))
    per_record = per_use.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.sum("tokens").alias("tokens"))
    per_source = per_record.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    available = sizes.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    whole = per_source.agg(F.sum("used_tokens").alias("whole"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    shares = (
        targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
        .join(per_source, "source", "left").join(available, "source", "left").join(F.broadcast(whole), F.lit(True), "left")  # one row
        .select("source", "target_share", "max_repeats", zero("available_tokens"), zero("used_tokens"), F.coalesce(F.round(F.col("used_tokens") / F.col("whole"), 6), F.lit(0.0)).alias("actual_share"), zero("records"), zero("most_uses"))
    )
    return used, shares
