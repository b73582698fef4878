"""Benchmark passages in documents, found by winnowing.

Of the hashes of all runs of ``gram`` words, a text keeps the least (the rightmost of equal ones) in every window of
``span - gram + 1`` runs. Two texts that share ``span`` words in a row share such a window, and so one of the hashes kept.
The hashes of benchmark items and documents are joined; each hit is extended by the words around it to all spans that hold
it, and the spans' 128-bit digests are joined with those of the items. So every shared span is found, and nothing else.

An item of fewer than ``span`` words is one span of its own length. No hash of a longer run falls inside, so for each such
length that occurs, documents keep the hashes of all runs of that length.

Hashes and digests are made in Arrow batches, text by text, straight from the UTF-8 bytes. Hits are kept per distinct text:
copies of a document send their rows once. The text itself is read twice, and shuffled only where the texts with hits are too
many for Spark to broadcast their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forklore.session import materialize

SPAN = 10
GRAM = 5
PIECE = 1 << 22
TEXT = ["t1", "t2"]

_byte = np.arange(256, dtype=np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Bytes of words: digits, a-z, and all of characters beyond ASCII.
INSIDE = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (LOWER >= 128)
# odd multipliers of the hashes; any will do, as spans are compared by their digests
POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
STEP, TURN = np.uint64(0xD1342543DE82EF95), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * TURN
    return values ^ (values >> np.uint64(29))


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """``data`` in pieces that cut no word, so that the memory for hashing does not grow with the text."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and INSIDE[data[end]]:
            outside = np.flatnonzero(~INSIDE[data[end : end + PIECE]])
            end += int(outside[0]) if len(outside) else PIECE
        yield data[at:end]
        at = end


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: the words in lower case with a space after each, where each begins, and a hash of each."""
    texts, lengths, hashes = [], [], []
    for piece in _pieces(data):
        inside = INSIDE[piece]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        size = edges[1::2] - edges[::2]
        if not len(size):
            continue
        letters = LOWER[piece[inside]]
        first = np.cumsum(size) - size
        place = np.arange(len(letters))
        nth = np.repeat(np.arange(len(size)), size)
        hashes.append(np.add.reduceat((letters.astype(np.uint64) + np.uint64(1)) * POWERS[(place - first[nth]) & 1023], first))
        spaced = np.full(len(letters) + len(size), 32, np.uint8)
        spaced[place + nth] = letters
        texts.append(spaced)
        lengths.append(size)
    if not lengths:
        return np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, np.uint64)
    size = np.concatenate(lengths)
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    return np.concatenate(texts), starts, _mixed(np.concatenate(hashes) + size.astype(np.uint64) * STEP)


def kept(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the runs of ``gram`` words that winnowing keeps."""
    runs = len(hashes) - gram + 1
    n = runs - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    every = np.full(runs, gram, np.uint64)
    for i in range(gram):
        every = every * STEP + hashes[i : i + runs]
    every = _mixed(every)
    least, at = every[:n].copy(), np.arange(n)
    for i in range(1, window):
        other = every[i : i + n]
        lower = other <= least
        least[lower] = other[lower]
        at[lower] = np.flatnonzero(lower) + i
    at = at[np.diff(at, prepend=-1) > 0]
    return at, every[at].view(np.int64)


def digests(text: np.ndarray, starts: np.ndarray, at: np.ndarray, size: int) -> list[bytes]:
    """128-bit digests of the ``size`` words from each position of ``at``."""
    import xxhash

    raw = text.tobytes()
    return [xxhash.xxh3_128_digest(raw[starts[i] : starts[i + size] - 1]) for i in at]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text; none for null."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]


def _lists(parts: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """One list of structs per text, from columns per text."""
    offsets = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
    columns = [
        pa.array([v for p in parts for v in p[i]], t) if pa.types.is_binary(t)
        else pa.array(np.concatenate([np.asarray(p[i], np.int64) for p in parts] or [np.empty(0, np.int64)]), pa.int64()).cast(t)
        for i, (_, t) in enumerate(types)
    ]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, [n for n, _ in types]))


MARKS = [("hash", pa.int64()), ("pos", pa.int32()), ("size", pa.int32())]
SPANS = [("pos", pa.int32()), ("size", pa.int32()), ("digest", pa.binary())]


def _marks(sizes: list[int], span: int, gram: int):
    """Batches with ``text`` to batches with ``marks`` in its place: the hashes kept for spans of each of ``sizes``."""

    def marks_of(hashes: np.ndarray) -> tuple:
        found = []
        for size in sizes:
            at, values = kept(hashes, gram, span - gram + 1) if size == span else kept(hashes, size, 1)
            found.append((values, at, np.full(len(at), size)))
        return tuple(np.concatenate([f[i] for f in found]) for i in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            parts = [marks_of(words(data)[2]) for data in _texts(batch.column(at))]
            yield batch.set_column(at, "marks", _lists(parts, MARKS))

    return run


def _spans(span: int, gram: int):
    """Batches with ``text`` and ``marks`` (null for none) to batches with ``n_words`` and ``spans``, those that hold a mark."""

    def spans_of(data: np.ndarray, marks: list | None) -> tuple[int, tuple]:
        text, starts, _ = words(data)
        n = len(starts) - 1
        found: tuple[list, list, list] = ([], [], [])
        by_size: dict[int, list[int]] = {}
        for mark in marks or []:
            by_size.setdefault(mark["size"], []).append(mark["pos"])
        for size, at in sorted(by_size.items()):
            back = np.arange(span - gram + 1) if size == span else np.zeros(1, np.int64)
            first = np.unique(np.asarray(at)[:, None] - back)
            first = first[(first >= 0) & (first <= n - size)]
            found[0].extend(first)
            found[1].extend([size] * len(first))
            found[2].extend(digests(text, starts, first, size))
        return n, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, marks = batch.schema.get_field_index("text"), batch.schema.get_field_index("marks")
            found = [spans_of(d, m) for d, m in zip(_texts(batch.column(text)), batch.column(marks).to_pylist())]
            batch = batch.set_column(text, "n_words", pa.array([n for n, _ in found], pa.int64()))
            yield batch.set_column(marks, "spans", _lists([s for _, s in found], SPANS))

    return run


def _item_spans(span: int):
    """Batches with ``text`` to batches with ``spans``: all of the item's."""

    def spans_of(data: np.ndarray) -> tuple:
        text, starts, _ = words(data)
        n = len(starts) - 1
        size = min(n, span)
        at = np.arange(n - size + 1) if n else np.empty(0, np.int64)
        return at, np.full(len(at), size), digests(text, starts, at, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "spans", _lists([spans_of(d) for d in _texts(batch.column(at))], SPANS))

    return run


MARK_TYPE = "array<struct<hash:long,pos:int,size:int>>"
SPAN_TYPE = "array<struct<pos:int,size:int,digest:binary>>"


def _text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def item_spans(items: DataFrame, span: int) -> DataFrame:
    """``item, size, digest``: each span of each item once."""
    slim = items.select(F.col("item_id").cast("string").alias("item"), "text")
    found = slim.mapInArrow(_item_spans(span), f"item string, spans {SPAN_TYPE}")
    return found.select("item", F.inline("spans")).select("item", "size", "digest").distinct()


def hits(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What documents share with items, in three tables.

    ``rows``: one row per row of ``docs``: ``doc_id, t1, t2`` (the key of its text), ``n_words``.
    ``found``: ``t1, t2, pos, size, digest``: the spans of the text that an item holds, by word position.
    ``spans``: ``item, size, digest`` of all items.
    """
    spans = materialize(item_spans(items, span), "spans")
    sizes = sorted(r["size"] for r in spans.select("size").distinct().collect())  # 1 to span at most
    schema = f"t1 long, t2 long, marks {MARK_TYPE}"
    marked = items.select(*_text_key(F.col("text")), "text").mapInArrow(_marks(sizes, span, gram), schema)
    sought = materialize(marked.select(F.inline("marks")).select("hash", "size").distinct(), "sought")

    slim = docs.select("doc_id", *_text_key(F.col("text")), "text")
    kept_here = slim.where(F.col("text").isNotNull()).drop("doc_id").mapInArrow(_marks(sizes, span, gram), schema)
    met = kept_here.select(*TEXT, F.inline("marks")).join(sought, ["hash", "size"])
    by_text = met.groupBy(*TEXT).agg(F.collect_set(F.struct("pos", "size")).alias("marks"))
    by_text = materialize(by_text, "marks")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = slim.join(by_text, TEXT, "left").select("doc_id", *TEXT, "text", "marks").mapInArrow(
        _spans(span, gram), f"doc_id {kind}, t1 long, t2 long, n_words long, spans {SPAN_TYPE}"
    )
    rows = materialize(rows, "rows")
    tried = rows.where(F.size("spans") > 0).select(*TEXT, F.inline("spans")).distinct()
    found = tried.join(spans.select("size", "digest").distinct(), ["size", "digest"])
    return rows.drop("spans"), materialize(found, "hits"), spans


def decontaminate(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs`` (``doc_id, text``).

    Words are runs of digits, a-z (A-Z are lower-cased) and characters beyond ASCII. A span is ``span``
    consecutive words of an item (``item_id, text``), or all of a shorter item. ``n_hit`` counts the words of a document
    that lie inside any occurrence of a span; ``n_items`` the items that have one; ``items_sha256`` is of their ids, sorted as
    strings and joined by commas.

    A null or empty text has no words, and shares nothing. Repeated rows of documents are each returned, and rows that share a
    doc_id are judged by their own texts. Rows that share an item_id are one item; an item whose id is null marks
    words, but is not counted. Other columns play no part. No items: no hits.
    """
    rows, found, spans = hits(docs, items, span, gram)
    # words covered: each span adds what lies beyond the furthest end so far
    so_far = Window.partitionBy(*TEXT).orderBy("pos", "size").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("size")
    reach = F.greatest(F.col("pos"), F.coalesce(F.max(end).over(so_far), F.lit(0)))
    covered = found.select(*TEXT, F.greatest(end - reach, F.lit(0)).alias("new"))
    covered = covered.groupBy(*TEXT).agg(F.sum("new").alias("n_hit"))
    # texts with the same spans have the same items, which are looked up once
    same = found.groupBy(*TEXT).agg(F.sort_array(F.collect_set("digest")).alias("set"))
    same = materialize(same.withColumn("key", F.sha2(F.array_join(F.transform("set", F.hex), ""), 256)), "sets")
    sets = same.groupBy("key").agg(F.any_value("set").alias("set")).select("key", F.explode("set").alias("digest"))
    named = spans.where(F.col("item").isNotNull()).select("digest", "item")
    listed = sets.join(named, "digest").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    listed = listed.select(
        "key", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    per_text = covered.join(same.select(*TEXT, "key"), TEXT).join(listed, "key", "left").drop("key")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(materialize(per_text, "per_text"), TEXT, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
