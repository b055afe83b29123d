"""Substring dedup: a count-min prefilter in front of exact grouping of repeated windows.

Every window of ``size`` words has an anchor, the run of ``anchor`` words inside it with the
smallest hash. Equal windows have equal anchors, so a window can repeat only if its anchor
does, and there are about ``2 / (size - anchor + 2)`` anchors for each window. Pass one counts
anchors in partition sketches, which are merged; the merged sketch overestimates the count of a
window. Pass two keeps only the windows that it estimates as repeated, and groups those exactly
by 96 bits of two independent hashes of their words' bytes: they are shuffled once and sorted by hash and document, and the first
document of a hash is read off in passing. A window that repeats is never lost, whatever the
sketch's size.

The sketch grows with the input up to ``max_sketch_bytes`` (it is broadcast); beyond that it
lets more windows through, and the second pass has more to group, with the same result.

Rows: a null text has no words; a null doc_id is neither smaller nor larger than another, so
such rows keep all their words; rows with one doc_id are judged each on its own text, and none
of them is an earlier document than the others. Columns of the input are kept; n_words, n_removed
and kept_text replace columns of these names. A document's windows are judged whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from hearthline.llm import hashing
from hearthline.llm.memory import released
from hearthline.llm.spans import whole_row

PAGE = 1 << 16  # cells of the sketch that are merged together
ROWS = 2  # hash rows of the sketch
HELD = 2_000_000  # windows that a task compares before it passes them on
RUN = 1 << 31  # above the number of windows of a text


def _anchors(w: hashing.Words, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows, the anchor's place of each, and all runs' anchor hashes."""
    total = len(w.hashes) - size + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = hashing.runs(w.hashes, anchor)
    span = size - anchor + 1
    least = grams[:total].copy()
    place = np.zeros(total, np.int64)
    for k in range(1, span):
        other = grams[k : k + total]
        lower = other < least
        least[lower] = other[lower]
        place[lower] = k
    at = np.flatnonzero(w.text[:total] == w.text[size - 1 :])
    return at, at + place[at], grams


def _cells(grams: np.ndarray, row: int, width: int) -> np.ndarray:
    shift = np.uint64(64 - int(width).bit_length() + 1)
    salted = grams if row == 0 else hashing.mix(grams ^ np.uint64(0x9E3779B97F4A7C15))
    return (salted >> shift).astype(np.int64) + row * width


def _sketches(width: int, size: int, anchor: int):
    """For each partition the cells that it counted: by page, the cell's place in the page,
    twice if it was counted more than once (2 is all that matters)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        held = 0

        def flush():
            cells, n = np.unique(np.concatenate(pending), return_counts=True)
            cells = np.repeat(cells, np.minimum(n, 2))
            pages = cells // PAGE
            cuts = np.flatnonzero(np.diff(pages)) + 1
            parts = np.split((cells % PAGE).astype("<u2"), cuts)
            numbers = pages[np.concatenate([[0], cuts])] if len(cells) else []
            for lo in range(0, len(parts), 512):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[lo : lo + 512], pa.int64()), pa.array([x.tobytes() for x in parts[lo : lo + 512]], pa.binary())],
                    names=["page", "cells"],
                )

        for batch in batches:
            for _, part in hashing.slices(batch.column(0)):
                _, place, grams = _anchors(hashing.words(part), size, anchor)
                found = grams[np.unique(place)]
                for row in range(ROWS):
                    pending.append(_cells(found, row, width))
                    held += len(found)
            if held > 4_000_000:
                yield from flush()
                pending, held = [], 0
        if held:
            yield from flush()

    return run


@released
def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that were counted twice or more, as bits by page. Sketches stream through:
    memory holds one byte for each cell of this task's pages, however many sketches there are."""
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for page, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen = counts.setdefault(page, np.zeros(PAGE, np.uint8))
            more = np.bincount(np.frombuffer(cells.as_buffer(), "<u2"), minlength=PAGE)
            np.minimum(seen + np.minimum(more, 2).astype(np.uint8), 2, out=seen)
    for page, seen in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([page], pa.int64()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["page", "bits"])


def _repeated(sketch, width: int, size: int, anchor: int):
    """Windows that the sketch estimates as repeated. Of equal windows that this task holds at
    once only the first document's go on to the grouping; the others are settled here, and leave
    as runs of adjacent windows with g = -1. So a window that is everywhere moves once a task."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        held: list[tuple[np.ndarray, ...]] = []
        n = 0

        def flush():
            h, g, doc, tag, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, g, h))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            settled = np.zeros(len(h), bool)
            settled[order] = doc[order] > least
            open_ = ~settled
            yield from _windows(h[open_], g[open_], doc[open_], tag[open_], pos[open_], np.ones(int(open_.sum()), np.int64))
            doc, tag, pos = doc[settled], tag[settled], pos[settled]  # in the order of the texts
            starts = np.ones(len(doc), bool)
            starts[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (pos[1:] != pos[:-1] + 1)
            at = np.flatnonzero(starts)
            if len(at):
                length = np.diff(np.append(at, len(doc)))
                spread = hashing.mix(doc[at].view(np.uint64)).view(np.int64)
                yield from _windows(spread, np.full(len(at), -1, np.int64), doc[at], tag[at], pos[at], length)

        for batch in batches:
            ids, tags = (np.asarray(batch.column(k)) for k in (1, 2))
            for offset, part in hashing.slices(batch.column(0)):
                w = hashing.words(part)
                at, place, grams = _anchors(w, size, anchor)
                keep = np.ones(len(at), bool)
                for row in range(ROWS):
                    cells = _cells(grams[place], row, width)
                    keep &= (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
                at = at[keep]
                if len(at):
                    doc = w.text[at] + offset
                    held.append((
                        hashing.runs(w.hashes, size)[at].view(np.int64),
                        (hashing.runs(w.hashed(1), size, 1)[at] >> np.uint64(32)).astype(np.int64),
                        ids[doc], tags[doc], (at - w.first[w.text[at]]).astype(np.int64),
                    ))
                    n += len(at)
                if n > HELD:
                    yield from flush()
                    held, n = [], 0
        if held:
            yield from flush()

    return run


def _windows(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 17)]) for x in columns], names=["h", "g", "doc_id", "tag", "pos", "n"])


@released
def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by hash and document, those of other documents than the first with
    that hash; runs that were settled before pass. Only the last group's key is kept."""
    last: tuple[int, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, doc = (np.asarray(batch.column(k)) for k in range(3))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if last and (int(h[0]), int(g[0])) == last[:2]:
            head = np.cumsum(new) == 1
            least[head] = last[2]
        last = int(h[-1]), int(g[-1]), int(least[-1])
        keep = pa.array((g < 0) | (doc > least))
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(2, 6)], names=["doc_id", "tag", "pos", "n"])


def repeated_windows(docs: DataFrame, size: int = 13, anchor: int = 8, max_sketch_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, tag (crc32 of the text), pos, n: runs of n adjacent windows (pos: the first word
    of the first) whose words also start in a document with a smaller doc_id."""
    spark = docs.sparkSession
    anchor = min(anchor, size)
    texts = docs.select("text", "doc_id", F.crc32("text").alias("tag")).where("text is not null and doc_id is not null")
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = letters / 6 * 2 / (size - anchor + 2)  # anchors, at six bytes a word
    width = PAGE
    while width < 2 * expected and width * 2 * ROWS // 8 <= max_sketch_bytes:
        width *= 2
    pages = (
        texts.select("text").mapInArrow(_sketches(width, size, anchor), "page long, cells binary")
        .repartition("page").mapInArrow(_merge, "page long, bits binary")
    )
    bits = np.zeros(ROWS * width // 8, np.uint8)
    for page in pages.toLocalIterator():  # at most max_sketch_bytes in all
        bits[page["page"] * (PAGE // 8) : (page["page"] + 1) * (PAGE // 8)] = np.frombuffer(page["bits"], np.uint8)
    sketch = spark.sparkContext.broadcast(bits)
    found = texts.mapInArrow(_repeated(sketch, width, size, anchor), "h long, g long, doc_id long, tag long, pos long, n long")
    sorted_ = found.repartition("h", "g").sortWithinPartitions("h", "g", "doc_id")
    return sorted_.mapInArrow(_later, "doc_id long, tag long, pos long, n long")


def _cut(size: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = batch.column("row").field("text").to_pylist(), batch.column("places")
            total, removed, kept = [], [], []
            for k, text in enumerate(texts):
                found = (text or "").encode().split()
                total.append(len(found))
                if places[k].is_valid:
                    gone = np.zeros(len(found) + 1, np.int64)
                    start, n = np.divmod(np.asarray(places.slice(k, 1).flatten()), RUN)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n + size - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    removed.append(int(gone.sum()))
                    found = [x for x, y in zip(found, gone, strict=True) if not y]
                else:
                    removed.append(0)
                kept.append(b" ".join(found).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "kept_text"],
            )

    return run


def dedup_substrings(docs: DataFrame, size: int = 13, **sketch) -> DataFrame:
    """The documents with n_words, n_removed and kept_text: each word covered by a window of
    `size` words that also starts in a document with a smaller doc_id is removed."""
    docs = docs.drop("n_words", "n_removed", "kept_text")
    runs = repeated_windows(docs, size, **sketch).select("doc_id", "tag", (F.col("pos") * RUN + F.col("n")).alias("run"))
    places = runs.groupBy("doc_id", "tag").agg(F.collect_list("run").alias("places"))
    keyed = docs.select(whole_row(docs), "doc_id", F.crc32("text").alias("tag"))
    joined = keyed.join(places.hint("shuffle_hash"), ["doc_id", "tag"], "left").select("row", "places")
    schema = T.StructType([joined.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_cut(size), schema).select("row.*", "n_words", "n_removed", "kept_text")
