"""Several values packed into one field: one row a value, with its place.

Method. Fields whose notation leaves no doubt (quoted values) give a dictionary of known whole values. A multi-pattern
automaton over the dictionary's values that hold a separator finds them in every other field, and dynamic programming
picks the cover of each field with the fewest parts that are no known value: a separator inside a known whole value is protected.

The dictionary is built and counted by Spark. An automaton holds at most ``automaton_bytes`` of it; a larger dictionary is dealt
to several by a hash, each of which goes over the fields once, and the spans that any of them finds are covered together.
"""

from __future__ import annotations

import re
import uuid
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialise

#: Opening quotes and what closes them.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’"}
STRONG = "|;\n\t"
BRACKETS = {"[": "]", "{": "}"}
_SEPARATOR = re.compile(r"[|;,\n\t]|\s/\s")
_ROWS = "key long, field string, pos int, item string"
_NUMBER = re.compile(r"(?:^|(?<=[\s;|,]))(?:\((\d{1,4})\)|(\d{1,4})[.)](?=\s))\s*")
_BULLET = re.compile(r"^(?:[•*·]|-(?=\s))\s*")
_ESCAPE = re.compile(r'\\(u[0-9a-fA-F]{4}|.)', re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def _joined(parts: list[str]) -> str:
    """The text of unescaped parts, with pairs of surrogates made one character and lone ones replaced."""
    text = "".join(parts)
    return text if not re.search("[\ud800-\udfff]", text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _bare(field: str) -> str:
    """The field without the outer escaping and brackets of its notation, either of which may have lost an end."""
    text = field.strip().strip("﻿​").strip()
    if len(text) > 1 and text[0] == text[-1] == '"' and text[1:].lstrip()[:1] in ("[", "{") and text[:-1].rstrip()[-1:] in ("]", "}"):
        text = text[1:-1].replace('""', '"').strip()
    opened = text[:1] if text[:1] in BRACKETS else ""
    if opened and (text.endswith(BRACKETS[opened]) or text[1:].lstrip()[:1] in QUOTES):
        text = text[1:]
        if text.endswith(BRACKETS[opened]):
            text = text[:-1]
    elif text[:1] in QUOTES and text[-1:] in BRACKETS.values():
        text = text[:-1]
    return text


def _quoted(text: str, at: int) -> tuple[int, str] | None:
    """Where the quoted value that begins at ``at`` ends, and the value; none if it is not closed."""
    close, out, i = QUOTES[text[at]], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            step = 6 if text[i + 1] == "u" else 2
            out.append(_unescaped(text[i : i + step]))
            i += step
        elif c == close:
            if c == '"' and text[i + 1 : i + 2] == '"' and text[i + 2 : i + 3] not in ("", ",", ";", "|", "\n"):
                out.append('"')
                i += 2
                continue
            rest = text[i + 1 :].lstrip(" ")[:1]
            if rest in ("", ",", *STRONG) or text[i + 1 : i + 4].startswith(" / ") or close != "'" and close != "’":
                return i + 1, _joined(out)
            out.append(c)
            i += 1
        else:
            out.append(c)
            i += 1
    return None


def atoms(field: str | None) -> tuple[list[tuple[str, bool, int, int]], list[str], str]:
    """The smallest parts of a field: (value, whether quoted, start, end), the separators between them, and the text scanned."""
    if field is None:
        return [], [], ""
    text = _bare(field)
    numbers = [m for m in _NUMBER.finditer(text)]
    marks = {}
    expected = 1
    for m in numbers:
        if int(m[1] or m[2]) == expected and (expected > 1 or not text[: m.start()].strip()):
            marks[m.start()] = m.end()
            expected += 1
    parts, seps, i, start, quoted = [], [], 0, 0, None
    fresh = True

    def close(end: int, sep: str) -> None:
        nonlocal quoted
        whole = quoted is not None and not text[quoted[2] : end].strip()
        value = quoted[0] if whole else text[start:end]
        parts.append((value, whole, quoted[1] if whole else start, end))
        seps.append(sep)
        quoted = None

    while i < len(text):
        c = text[i]
        if i in marks:
            if text[start:i].strip():
                close(i, "#")
            start = i = marks[i]
            fresh = True
            continue
        if fresh and c in QUOTES and (found := _quoted(text, i)):
            quoted, i, fresh = (found[1], i, found[0]), found[0], False
            continue
        if c in '"“«' and not fresh:
            end = text.find(QUOTES[c], i + 1)
            if end > 0 and "\n" not in text[i:end]:
                i = end + 1
                continue
        slash = c == "/" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace()
        if c in STRONG or c == "," or slash:
            close(i, "/" if slash else c)
            start, fresh = i + 1, True
        elif not c.isspace():
            fresh = False
        i += 1
    close(len(text), "")
    return parts, seps[:-1], text


def _merged(parts: list, seps: list[str], text: str) -> tuple[list, list[str]]:
    """Parts joined across commas that do not separate, as the field uses another separator too."""
    if "," not in seps or all(s == "," for s in seps):
        return parts, seps
    out, left = [parts[0]], []
    for sep, part in zip(seps, parts[1:]):
        if sep == ",":
            start = out[-1][2]
            out[-1] = (text[start : part[3]], False, start, part[3])
        else:
            out.append(part)
            left.append(sep)
    return out, left


def _edges(part: tuple, text: str) -> tuple[int, int]:
    piece = text[part[2] : part[3]]
    return part[2] + len(piece) - len(piece.lstrip()), part[2] + len(piece.rstrip())


def _aligned(edges: list[tuple[int, int]], spans) -> list[tuple[int, int]]:
    """Spans of the text that are two or more whole parts: (first part, last part)."""
    begins, ends = {a: i for i, (a, _) in reversed(list(enumerate(edges)))}, {b: i for i, (_, b) in enumerate(edges)}
    found = ((begins.get(a, len(edges)), ends.get(b, -1)) for a, b in spans)
    return [(i, j) for i, j in found if i < j]


def cover(field: str | None, spans=frozenset()) -> list[str]:
    """The values of a field, in order. ``spans``: (start, end) of known whole values in its text.

    Dynamic programming over the separators. A part that is a known value costs nothing, any other 1, and of covers that cost the
    same the one of fewest parts is taken. Parts joined over a separator must be a known value, and no repetition of one part
    ("a, a" is a value given twice).
    """
    parts, seps, text = atoms(field)
    if not parts:
        return []
    parts, seps = _merged(parts, seps, text)
    edges = [_edges(p, text) for p in parts]
    n = len(parts)
    known: dict[int, list[int]] = {}
    for i, j in _aligned(edges, spans):
        if len({text[a:b] for a, b in edges[i : j + 1]}) > 1:
            known.setdefault(j + 1, []).append(i)
    best = [(0, 0, 0)]  # cost, parts, where the last part begins
    for j in range(1, n + 1):
        ways = [(best[j - 1][0] + 1, best[j - 1][1] + 1, j - 1)] + [(best[i][0], best[i][1] + 1, i) for i in known.get(j, ())]
        best.append(min(ways))
    out, j = [], n
    while j:
        i = best[j][2]
        out.append(parts[i][0] if j - i == 1 else text[parts[i][2] : parts[j - 1][3]])
        j = i
    values = (_BULLET.sub("", value.strip()).strip() for value in reversed(out))
    return [v for v in values if v]


def _certain(batches):
    """Values that stand in quotes and hold a separator."""
    for batch in batches:
        found = []
        for field in batch.column("packed").to_pylist():
            if field and any(q in field for q in QUOTES):
                found += [v.strip() for v, quoted, _, _ in atoms(field)[0] if quoted and _SEPARATOR.search(v)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["item"])


def _automaton(values):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for v in values:
        automaton.add_word(v, len(v))
    if len(automaton):
        automaton.make_automaton()
    return automaton


_BUILT: dict = {}


def _built(dictionary, name: str):
    if name not in _BUILT:  # once a worker
        _BUILT.clear()
        _BUILT[name] = _automaton(dictionary.value)
    return _BUILT[name]


def _spans(automaton, packed: str | None) -> list[tuple[int, int]]:
    if not len(automaton) or not packed or not _SEPARATOR.search(packed):
        return []
    return [(end + 1 - size, end + 1) for end, size in automaton.iter(_bare(packed))]


def _found(batches, dictionary, name: str):
    """Spans of each field that an automaton finds and that are whole parts of it."""
    automaton = _built(dictionary, name)
    for batch in batches:
        rows = []
        for key, field, packed in zip(*(batch.column(c).to_pylist() for c in ("key", "field", "packed"))):
            if spans := _spans(automaton, packed):
                parts, seps, text = atoms(packed)
                edges = [_edges(p, text) for p in _merged(parts, seps, text)[0]]
                rows += [(key, field, edges[i][0], edges[j][1]) for i, j in _aligned(edges, spans)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "field", "a", "b"])


def _split(batches, dictionary, name: str = ""):
    """Rows of (key, field, pos, item); known spans come from the automaton, or with the rows where there are several."""
    automaton = _built(dictionary, name) if dictionary is not None else None
    for batch in batches:
        keys, fields, places, items = [], [], [], []
        given = batch.column("spans").to_pylist() if automaton is None else None
        for row, (key, field, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "field", "packed")))):
            spans = _spans(automaton, packed) if given is None else [(x["a"], x["b"]) for x in given[row] or ()]
            for pos, value in enumerate(cover(packed, spans)):
                keys.append(key)
                fields.append(field)
                places.append(pos + 1)
                items.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fields, pa.string()), pa.array(places, pa.int32()), pa.array(items, pa.string())], ["key", "field", "pos", "item"])


def unpack(fields: DataFrame, least_records: int = 2, automaton_bytes: int = 4_000_000) -> DataFrame:
    """One row a value: key, field, pos (from 1), item.

    ``fields``: key long, field string, packed string; a (key, field) that comes twice counts once. Null, empty and blank fields
    and empty values give no row and no place; repeated values stay. Quotes, escapes, brackets and numbering that only serve the
    packing are taken off; quotes left open belong to the value. Inside quotes nothing separates; a slash separates
    only between spaces; a comma only in fields without another separator. A known value is one that stands in quotes in
    at least ``least_records`` records.
    """
    context = fields.sparkSession.sparkContext
    fields = fields.select("key", "field", "packed").where("key is not null and packed is not null").dropDuplicates(["key", "field"])
    known = fields.select("packed").mapInArrow(_certain, "item string").groupBy("item").agg(F.count("*").alias("records"))
    known = materialise(known.where(F.col("records") >= least_records).select("item"), "known")
    size, values = known.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)), F.count("*")).first()
    shards = max(1, min(values, -(-size // max(1, automaton_bytes))))
    if shards == 1:
        dictionary = context.broadcast([r[0] for r in known.collect()])  # of checked size
        return fields.mapInArrow(partial(_split, dictionary=dictionary, name=uuid.uuid4().hex), _ROWS)
    known, spans = materialise(known.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards))).repartition("shard"), "shards"), []
    for shard in range(shards):
        dictionary = context.broadcast([r[0] for r in known.where(F.col("shard") == shard).select("item").collect()])  # about ``automaton_bytes``
        found = fields.mapInArrow(partial(_found, dictionary=dictionary, name=uuid.uuid4().hex), "key long, field string, a int, b int")
        spans.append(materialise(found, "spans"))
        dictionary.destroy()
    spans = reduce(DataFrame.unionByName, spans).groupBy("key", "field").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return fields.join(spans, ["key", "field"], "left").mapInArrow(partial(_split, dictionary=None), _ROWS)
