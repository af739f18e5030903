"""Near-duplicate texts by a token-group matrix.

Method. Each distinct text gets a sample of its word-window hashes (its *tokens*). Texts are partitioned
into groups by the smallest token they share with any other text; a group keeps the union of its members'
tokens, and the (token, group) rows are the matrix. A text is joined to the matrix on its rarest tokens, its
overlap with a group's union bounds its overlap with every member, and only groups whose bound qualifies are
opened. Opened pairs are checked exactly on the full sets of word sequences.

Copies (the same words in the same order) are one class from the start: all joins run between classes, never between copies.

Tokens are windows of ``token_words`` words whose hash lies under a threshold that depends on the text's size
alone, about ``sample`` of its different windows, all of them for short texts and at least the ``floor`` least. A text and a partner of similarity 0.5 share about
eight of twenty; ``least_share`` of them is asked for of a group, ``pair_share`` of a pair. The exact check follows, so
sampling can only lose a pair, never add one; recall against brute force is tested.

Similar texts have nearly as many different word sequences, so groups hold texts of one size only (sizes grow by the factor
that the similarity allows), and a text is never put to groups of other than the same or the next size: a part of a page does not meet
the page.

Hot tokens: counts are pre-aggregated, a text leaves out its most frequent tokens as far as the required overlap allows (the
rest still meet every qualifying partner), groups over ``group_rows`` are split by a hash of the member, and the
groups of a token of more than ``hot_rows`` texts are dealt to several keys by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import batch_hashes, batch_rolling, mixed, rolling, slices, word_hashes
from lodestone.session import materialise, prefer_hash_joins, release

_SKETCH = "kind string, id string, n long, m long, copy long, tokens array<long>"
_SIMILAR = "a long, b long, similarity double"


#: Bits of a window's value that stand beside the number of its text in a slice of at most 2,048 texts.
_BITS = np.uint64(53)


def _distinct(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (their upper 53 bits) without those that their text has already, by text and value: one sort of numbers that hold both."""
    both = np.sort((text.astype(np.uint64) << _BITS) | (values >> (np.uint64(64) - _BITS)))
    both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
    return both << (np.uint64(64) - _BITS), (both >> _BITS).astype(np.int64)


def _sketches(batches, words: int, least_words: int, token_words: int, sample: int, floor: int):
    for batch in slices(batches):
        hashes, places = batch_hashes(batch.column("text").to_pylist())
        sizes = np.diff(places)
        # texts too short for a token window are one window
        values, text = batch_rolling(hashes, places, token_words)
        for t in np.flatnonzero((sizes >= max(least_words, words)) & (sizes < token_words)):
            values = np.append(values, rolling(hashes[places[t] : places[t + 1]], int(sizes[t])))
            text = np.append(text, t)
        kinds = np.array([xxhash.xxh3_64_intdigest(k) for k in batch.column("kind").to_pylist()], dtype=np.uint64)
        values = mixed(values ^ kinds[text]) if len(values) else values
        values, text = _distinct(values, text)
        # the rate is that of the text's different windows; its few least ones are always kept
        windows = np.bincount(text, minlength=len(sizes))
        top = np.minimum(1.0, sample / np.maximum(1, windows))
        limit = np.minimum(top * 2.0**64, 2.0**64 - 2048).astype(np.uint64)
        limit[top >= 1] = np.uint64(2**64 - 1)
        rank = np.arange(len(values)) - (np.cumsum(windows) - windows)[text]
        keep = ((values <= limit[text]) | (rank < floor)) & (sizes[text] >= max(least_words, words))
        values, text = values[keep], text[keep]
        rows = np.flatnonzero(sizes >= max(least_words, words))
        ends = np.zeros(len(rows) + 1, dtype=np.int32)
        ends[1:] = np.searchsorted(text, rows, side="right")
        copy = [xxhash.xxh3_64_intdigest(hashes[places[r] : places[r + 1]].tobytes()) for r in rows]
        sequences = np.bincount(_distinct(*batch_rolling(hashes, places, words))[1], minlength=len(sizes))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("kind").take(pa.array(rows)), batch.column("id").take(pa.array(rows)), pa.array(sizes[rows], pa.int64()), pa.array(sequences[rows], pa.int64()),
                pa.array(np.array(copy, dtype=np.uint64).view(np.int64), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(values.view(np.int64))),
            ],
            ["kind", "id", "n", "m", "copy", "tokens"],
        )


def _similar(batches, words: int, most: int = 4_000_000):
    """Similarity of the sets of word sequences of two texts. Sets are kept while they hold no more than ``most`` values."""
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in slices(batches, "ta"):
        found = []
        for a, b, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))):
            if held > most:
                sets, held = {}, 0
            for cid, text in ((a, ta), (b, tb)):
                if cid not in sets:
                    sets[cid] = np.unique(rolling(word_hashes(text), words))
                    held += len(sets[cid])
            x, y = sets[a], sets[b]
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            found.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def near_duplicates(
    texts: DataFrame,
    words: int = 5,
    similarity: float = 0.8,
    least_words: int = 1,
    token_words: int = 6,
    sample: int = 20,
    floor: int = 4,
    least_share: float = 0.15,
    pair_share: float = 0.15,
    group_rows: int = 64,
    hot_rows: int = 4_096,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts of like content within each ``kind``.

    ``texts``: kind string, id string, text string. Keys that come twice count once; null and empty texts and
    texts of fewer than ``least_words`` words belong to nothing; a null id is no key and is left out.

    Returns three tables:
    ``members`` (kind, id, copy, n): the class of copies of each key, and its number of words;
    ``classes`` (cid, kind, copy, n, m, id): each class with its number of different word sequences and its least id;
    ``links`` (a, b, similarity): each pair of different classes (cids) at or over ``similarity``, once.
    """
    prefer_hash_joins(texts.sparkSession)
    source = texts.select("kind", F.col("id").cast("string").alias("id"), "text").where(
        F.col("id").isNotNull() & F.col("kind").isNotNull() & F.col("text").isNotNull()
    )
    sketch = materialise(
        source.mapInArrow(lambda b: _sketches(b, words, least_words, token_words, sample, floor), _SKETCH), "sketch"
    )
    members = materialise(sketch.select("kind", "id", "copy", "n").dropDuplicates(["kind", "id"]), "members")
    sketched = materialise(
        sketch.groupBy("kind", "copy", "n")
        .agg(F.min("id").alias("id"), F.first("m").alias("m"), F.first("tokens").alias("tokens"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "sketched",
    )
    release(sketch)
    classes = materialise(sketched.drop("tokens"), "classes")

    # tokens that at least two classes have, rarest first; the last few of a class need not be looked up
    tokens = sketched.select("cid", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").count().where("count > 1")
    shared = materialise(tokens.join(counts, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("by")), "shared")
    rare = (
        sketched.select("cid", "m", F.size("tokens").alias("all"))
        .join(shared, "cid")
        .withColumn("need", F.greatest(F.lit(1), F.round(F.col("all") * least_share).cast("int")))
        .where("size(by) >= need")
        .select(
            "cid", "m", "need", "all",
            F.expr("transform(by, x -> x.token)").alias("tokens"),
            F.expr("slice(by, 1, size(by) - need + 1)").alias("rare"),
        )
        # texts of a group are of like size, and only those of the same or the next size can be similar enough
        .withColumn("key", F.array_min("tokens"))
        .withColumn("size", F.floor(F.log(F.greatest(F.lit(1), F.col("m"))) / F.log(F.lit(1 / similarity)) + 1e-9) if similarity < 1 else F.col("m"))
    )
    sizes = rare.groupBy("key", "size").agg(F.count("*").alias("rows"))
    grouped = materialise(
        rare.join(sizes, ["key", "size"])
        .withColumn("gid", F.xxhash64("key", "size", F.pmod(F.xxhash64("cid"), F.ceil(F.col("rows") / group_rows))))
        .drop("key", "rows"),
        "grouped",
    )
    release(sketched, shared)

    # the matrix: the union of each group's tokens; a text meets the groups that hold one of its rare tokens. The groups of a hot
    # token are dealt to several keys, and a text looks each of them up
    parts = F.ceil(F.col("r.count") / hot_rows)
    matrix = grouped.select("gid", "size", F.explode("rare").alias("r")).select("gid", "size", F.col("r.token").alias("token"), F.pmod(F.xxhash64("gid"), parts).alias("part")).distinct()
    unions = grouped.select("gid", F.explode("tokens").alias("token")).groupBy("gid").agg(F.collect_set("token").alias("union"))
    looked = grouped.select("cid", F.col("gid").alias("own"), F.col("size").alias("mine"), F.explode("rare").alias("r"))
    looked = looked.select("cid", "own", "mine", F.col("r.token").alias("token"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    met = looked.join(matrix, ["token", "part"]).where("own <= gid and abs(mine - size) <= 1").select("cid", "gid").distinct()
    asking = grouped.select("cid", "need", "all", "m", "tokens", F.col("gid").alias("own"))
    opened = (
        met.join(asking, "cid")
        .join(unions, "gid")
        .where("size(array_intersect(tokens, union)) >= need")
        .select("gid", "own", F.col("cid").alias("a"), F.col("tokens").alias("ta"), F.col("all").alias("alla"), F.col("m").alias("ma"))
    )
    inside = grouped.select("gid", F.col("cid").alias("b"), F.col("tokens").alias("tb"), F.col("all").alias("allb"), F.col("m").alias("mb"))
    pairs = materialise(
        opened.join(inside, "gid")
        .where("(own < gid or a < b) and a != b")
        .where(F.least("ma", "mb") >= similarity * F.greatest("ma", "mb") - 1e-9)
        .where(F.size(F.array_intersect("ta", "tb")) >= F.greatest(F.lit(1), F.round(pair_share * F.greatest("alla", "allb")).cast("int")))
        .select("a", "b"),
        "pairs",
    )
    release(grouped)

    # exact check on the whole texts of those classes that are in some pair
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct().join(classes.select("cid", "kind", "id"), "cid")
    whole = materialise(source.join(wanted, ["kind", "id"]).select("cid", "text").dropDuplicates(["cid"]), "whole")
    both = pairs.join(whole.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(whole.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b")
    links = both.mapInArrow(lambda x: _similar(x, words), _SIMILAR).where(F.col("similarity") >= similarity)
    links = materialise(links, "links")
    release(pairs, whole)
    return members, classes, links


def pairs_of_records(members: DataFrame, classes: DataFrame, links: DataFrame, copies_each: int = 256) -> DataFrame:
    """Each pair of different keys that are copies or near-duplicates: kind, id_a < id_b as strings.

    Copies are paired in parts of about ``copies_each``, so that no task holds all of a class.
    """
    of = materialise(members.join(classes.select("kind", "copy", "n", "cid"), ["kind", "copy", "n"]).select("cid", "kind", "id"), "of")
    left, right = (of.select(F.col("cid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("kind", "id"))) for c in "ab")
    across = links.select("a", "b").join(left, "a").join(right, "b").select(F.col("kind_a").alias("kind"), F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    several = of.groupBy("cid").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("parts", F.ceil(F.col("rows") / copies_each)).drop("rows")
    copies = of.join(several, "cid")
    same = (
        copies.select("cid", "kind", F.col("id").alias("id_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
        .join(copies.select("cid", F.col("id").alias("id_b"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")), ["cid", "part"])
        .where("id_a < id_b")
        .select("kind", "id_a", "id_b")
    )
    return across.unionByName(same)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected classes: (cid, root) for every class in some link, root the least cid that it reaches.

    Large-star and small-star steps in turn until no edge changes; each step is a join-free aggregation whose result
    is written. Stars are kept as edges, so no component is ever gathered.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        edges, done = materialise(small, "edges"), edges
        release(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("cid"), "root").unionByName(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("root")).distinct()
    )


def groups_of_records(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """One row a key: kind, id, group_id (least id of the group), copies of its class, links of its class to other classes."""
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("links"))
    rooted = classes.join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")).join(degree, "cid", "left")
    named = rooted.groupBy("root").agg(F.min("id").alias("group_id"))
    sized = members.groupBy("kind", "copy", "n").agg(F.count("*").alias("copies"))
    return (
        members.join(rooted.join(named, "root").drop("id"), ["kind", "copy", "n"])
        .join(sized, ["kind", "copy", "n"])
        .select("kind", "id", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
