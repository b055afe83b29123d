"""Packing tokenized documents into sequences: shortest pack first over the length histogram.

Documents are tokenized and cut into pieces of at most `size` ids. Only the histogram of piece
lengths (`size` bins at most) goes to the driver. There lengths are placed longest first, each
into the shortest packs that still have room, which updates the counts of packing patterns (the
lengths in a pack). Patterns are joined back to the pieces by their rank among the pieces of one
length; ranks come from counts by (length, salt), so a length that many pieces share is ranked
in many tasks.

Tokenizing takes the words between blanks of a batch once each, by dictionary encoding; a task
remembers the ids of the words it met most, and ids are gathered as arrays. This needs a tokenizer
that drops white space, as `word_bpe_49k.json` does.

Rows: a null text counts as empty, which leaves the end id alone. Rows that repeat a doc_id
are packed each. A null doc_id is kept.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from hearthline.llm import hashing
from hearthline.llm.memory import released
from hearthline.storage import written

CACHED = 1 << 22  # letters of the words whose ids a task remembers, and eight for each word
SLICE = 1 << 22  # bytes of text that are tokenized together, at least one text
ROWS_PER_SALT = 50_000
#: A word of letters that normalization leaves as they are but for their case, and what follows it.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&*-;?@\[-`{}~]*)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids:
    """The ids of words, remembered: word k's are pool[at[k] : at[k] + n[k]]."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer)
        self.whole.model._resize_cache(0)  # words are remembered here
        self.letters = self.whole.model.tokenize if _parts_letters(self.whole) else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.stems: dict[str, bytes] = {}
        self.held = 0
        self.pool = np.zeros(0, "<u4")
        self.at, self.n, self.seen = (np.zeros(0, np.int64) for _ in range(3))

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word, four bytes an id. A plain word is its letters and then what
        follows them, which the tokenizer parts too."""
        whole = lambda x: [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(x, add_special_tokens=False)]
        if self.letters is None:
            return whole(words)
        found = list(map(PLAIN.fullmatch, words))
        stem = [m[1].lower() if m else "" for m in found]
        rest = [m[2] if m else x for m, x in zip(found, words, strict=True)]
        new, tokenize = list(set(stem) - self.stems.keys()), self.letters
        for x, y in zip(new, _byte_letters(new), strict=True):
            self.stems[x] = array("I", [t.id for t in tokenize(y)]).tobytes()
        new = list(set(rest))
        ids = dict(zip(new, whole(new), strict=True))
        return [self.stems[x] + ids[y] for x, y in zip(stem, rest, strict=True)]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each of the distinct words."""
        if self.held > CACHED:
            self._keep_common()
        get = self.known.get
        k = np.array(list(map(get, words, repeat(-1))), np.int64)
        new = [words[i] for i in np.flatnonzero(k < 0)]
        if new:
            ids = self._encode(new)
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            k[k < 0] = np.arange(first, first + len(new))
            self.held += sum(map(len, new)) + 8 * len(new)
            n = np.array(list(map(len, ids)), np.int64) // 4
            self.at = np.append(self.at, len(self.pool) + np.cumsum(n) - n)
            self.n = np.append(self.n, n)
            self.seen = np.append(self.seen, np.zeros(len(n), np.int64))
            self.pool = np.append(self.pool, np.frombuffer(b"".join(ids), "<u4"))
        return k

    def _keep_common(self) -> None:
        """Words that were met once go; all go if that frees less than half."""
        common = self.seen > 1
        words = [x for x, keep in zip(self.known, common.tolist(), strict=True) if keep]
        held = sum(map(len, words)) + 8 * len(words)
        at, n, pool = self.at[common], self.n[common], self.pool
        self.forget()
        if 2 * held <= CACHED:
            self.known, self.held = dict(zip(words, range(len(words)), strict=True)), held
            self.n, self.at, self.seen = n, np.cumsum(n) - n, np.ones(len(n), np.int64)
            self.pool = pool[np.repeat(at - self.at, n) + np.arange(int(n.sum()))]

    def of(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end id; where each text's begin, and the end)."""
        w = hashing.words(texts)
        n = w.ends - w.starts
        offsets = np.concatenate([[0], np.cumsum(n)])
        # the bytes of the words, one after the other
        spread = np.zeros(len(w.data) + 1, np.int8)
        spread[w.starts] = 1
        spread[w.ends] -= 1  # a text's last word may end where the next text's first begins
        inside = np.cumsum(spread[:-1], dtype=np.int8).astype(bool)
        words = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(w.data[inside])).dictionary_encode()
        codes = np.asarray(words.indices)
        k = self.numbers(words.dictionary.to_pylist())
        self.seen[k] += np.bincount(codes, minlength=len(k))
        ends = w.first[1:]
        at, n = np.insert(self.at[k][codes], ends, -1), np.insert(self.n[k][codes], ends, 1)
        first = np.concatenate([[0], np.cumsum(n)])
        pool = np.append(self.pool, np.array([end_id], "<u4"))
        at[at < 0] = len(self.pool)
        step = np.ones(first[-1], np.int32)  # from one id's place in the pool to the next
        step[first[:-1][n > 0]] = np.diff(at[n > 0], prepend=0) - np.append(0, n[n > 0][:-1] - 1)
        ids = pool[np.cumsum(step, dtype=np.int32)]
        return ids, np.concatenate([[0], first[ends + np.arange(1, len(ends) + 1)]])


def _parts_letters(tokenizer) -> bool:
    """Whether a plain word's letters are taken by themselves, as they are but for their case."""
    state = lambda x: json.loads(x.__getstate__()) if x is not None else {}
    steps = [x["type"] for x in state(tokenizer.normalizer).get("normalizers", [])]
    cuts = state(tokenizer.pre_tokenizer).get("pretokenizers", [])
    return steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and r"|[\p{L}]+|" in cuts[0]["pattern"].get("Regex", "")


def _byte_letters(words: list[str]) -> list[str]:
    """Words with the bytes of their Latin-1 letters written as byte-level models write bytes:
    printable ones as the letter of that number, the others as letters from 256 on."""
    whole = "\n".join(words)
    if not whole.isascii():
        odd = [*range(33), *range(127, 161), 173]
        for point in range(0xC0, 0x100):
            whole = whole.replace(chr(point), "".join(chr(256 + odd.index(b)) if b in odd else chr(b) for b in chr(point).encode()))
    return whole.split("\n") if words else []


def _pieces(tokenizer: str, size: int, end_id: int, with_ids: bool):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = _Ids(tokenizer)
        for batch in batches:
            for offset, part in hashing.slices(batch.column(1), SLICE):
                ids, first = known.of(part, end_id)
                total = np.diff(first)
                parts = -(-total // size)
                doc = np.repeat(np.arange(len(part)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
                length = np.minimum(total[doc] - start, size)
                begin = first[doc] + start
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
                columns = [batch.column(0).slice(offset, len(part)).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, first[-1]), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])

    return run


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a pack, number of such packs), by shortest pack first.

    Each step uses up a length's count or a pattern's, so there are at most as many steps as
    twice the bins and the patterns they make.
    """
    by_used: dict[int, list[list]] = defaultdict(list)
    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        left = histogram[length]
        for used in sorted(by_used):
            if used + length > size:
                break
            packs = by_used[used]
            while packs and left:
                pattern, n = packs.pop()
                take = min(n, left)
                if n > take:
                    packs.append([pattern, n - take])
                by_used[used + length].append([(*pattern, length), take])
                left -= take
            if not left:
                break
        if left:
            # packs that hold this length alone: as many in one pack as fit
            each = max(1, size // length)
            if left >= each:
                by_used[each * length].append([(length,) * each, left // each])
            if left % each:
                by_used[left % each * length].append([(length,) * (left % each), 1])
        by_used = defaultdict(list, {u: p for u, p in by_used.items() if p})
    return sorted((tuple(p), n) for packs in by_used.values() for p, n in packs)


def _slots(packs: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces of that length in a pack, first sequence, offset)."""
    out, ranks, first = [], defaultdict(int), 0
    for pattern, n in packs:
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            m = pattern.count(length)
            out.append((length, ranks[length], ranks[length] + m * n - 1, m, first, offset))
            ranks[length] += m * n
            offset += m * length
        first += n
    return out


def tokenized(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), size, end_id, with_ids), schema)


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and the ids if asked for."""
    spark = docs.sparkSession
    pieces = written(tokenized(docs, tokenizer, size, end_id, with_ids), "pieces")
    by_length = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(patterns(by_length, size))
    if not slots:
        return pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    salts = max(8, sum(by_length.values()) // ROWS_PER_SALT)
    salted = pieces.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start), {salts})"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    places = spark.createDataFrame(slots, "length long, low long, high long, m long, first long, base long")  # by bins of the histogram, not by rows
    joined = ranked.join(F.broadcast(places), "length").where("rank between low and high")
    return joined.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.expr("first + (rank - low) div m").alias("sequence_id"),
        F.expr("base + pmod(rank - low, m) * length").alias("offset"),
        *["ids"] * with_ids,
    )
