"""Listings of a stream of lines, many lines at a time.

Lines come in order, those of a paste together. What is counted within a listing is a running count less what it
was at the listing's head, so a chunk of lines is worked on as arrays; of the listing that a chunk ends in, only
what is known so far goes on to the next, however long the listing is.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hearthline.llm.memory import released

LINES, BYTES = 1 << 14, 8 << 20  # of a chunk, about
#: What is first of its kind in a listing: its own line, the one after it, and lines that a reader marks.
FIRSTS = ["name", "price", "spec", "checked_line", "dated_line", "past_line"]
BLANKS = r"[ \t\n\x0b\f\r]*"


def regex(pattern: str) -> str:
    """A pattern of Spark's functions for Arrow's, where \\s leaves out the vertical tab and groups have names."""
    number = itertools.count(1)
    return re.sub(r"\((?!\?)", lambda _: f"(?P<g{next(number)}>", pattern.replace(r"\s*", BLANKS))


def _groups(lines: pa.Array, pattern: str) -> list[np.ndarray]:
    """The groups of what is found first, as numbers where they are digits; 0 without any."""
    found = pc.extract_regex(lines, pattern)
    parts = [pc.struct_field(found, k) for k in range(found.type.num_fields)]
    digits = lambda x: pc.if_else(pc.match_substring_regex(x, r"\A\d+\z"), x, None).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return [digits(x) for x in parts] + [parts[-1]]


def _days(lines: pa.Array, pattern: str, today: int) -> np.ndarray:
    """Days of a date's year, month and day, or -1 without such a day or with one to come."""
    year, month, day, _ = _groups(lines, pattern)
    year = np.where(year < 100, year + 2000, year)
    first = (year - 1970) * 12 + np.clip(month, 1, 12) - 1
    start, after = (x.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for x in (first, first + 1))
    days = start + day - 1
    return np.where((month >= 1) & (month <= 12) & (day >= 1) & (days < after) & (days <= today), days, -1)


@dataclass(frozen=True)
class Marks:
    """Patterns of a price line, of a specification and of lines with dates; the line that fences a note; lines of a
    specification from the third on; a note's length."""

    head: str
    spec: str
    dates: tuple[str, str, str]  # of a checked date, of any, and of a number before a unit
    units: dict[str, int]  # in days
    fence: str
    spec_lines: int
    length: int


@dataclass
class Open:
    """A listing that may go on."""

    paste: pa.Array
    block: int
    row: int
    third: int
    closed: int
    level: int  # of fences before the first note, or 0
    notes: str
    firsts: list

    def line(self, length: int) -> list:
        return [self.block, *self.firsts, self.notes[:length] if self.level and self.closed > self.level else None]


class Splitter:
    def __init__(self, marks: Marks, today: int):
        self.marks, self.today = marks, today
        self.open: Open | None = None
        self.heads = 0  # in the paste so far
        self.out: list[pa.RecordBatch] = []

    def _emit(self, paste: pa.Array, block: pa.Array, *texts: pa.Array) -> None:
        """texts: what FIRSTS names, and the memo. The date is one that is called checked, else any, else so many days ago."""
        name, price, spec, checked, dated, past, memo = texts
        sure, other = (_days(x, p, self.today) for x, p in zip((checked, dated), self.marks.dates, strict=False))
        number, _, unit = _groups(past, self.marks.dates[2])
        each = sum((pc.equal(unit, u).fill_null(False).to_numpy(zero_copy_only=False) * k for u, k in self.marks.units.items()), np.zeros(len(block), np.int64))
        has = [x.is_valid().to_numpy(zero_copy_only=False) for x in (checked, dated, past)]
        day = np.select(has, [sure, other, self.today - number * each], -1)
        none = np.select(has, [sure < 0, other < 0, False], True)
        confirmed = pa.array(day.astype(np.int32), pa.int32(), mask=none).cast(pa.date32())
        self.out.append(pa.RecordBatch.from_arrays([paste, block, name, price, spec, confirmed, memo], names=["paste", "block", "name", "price", "spec", "confirmed_on", "memo"]))

    def _close(self) -> None:
        if self.open:
            block, *texts = self.open.line(self.marks.length)
            self._emit(self.open.paste, pa.array([block], pa.int64()), *(pa.array([x], pa.string()) for x in texts))
            self.open = None

    def add(self, paste: pa.Array, no: np.ndarray, line: pa.Array, row: np.ndarray, n: int) -> None:
        """The first n lines; one more is there if the stream goes on."""
        m, was = self.marks, self.open
        priced = pc.match_substring_regex(line, m.head).to_numpy(zero_copy_only=False)
        head = np.zeros(n, bool)
        follow = len(line) - 1
        head[:follow] = (priced[1:] & (row[1:] != 1))[:n]
        paste, no, line, row = paste.slice(0, n), no[:n], line.slice(0, n), row[:n]
        trimmed = pc.utf8_trim(line, characters=" ")
        fence = pc.equal(trimmed, m.fence).to_numpy(zero_copy_only=False)
        at = np.arange(n)
        last_head, last_start = (np.maximum.accumulate(np.where(x, at, -1)) for x in (head, row == 1))
        inside = np.where((last_head < 0) & (last_start < 0), was is not None, (last_head >= last_start) & (last_head >= 0))
        piece, fences = np.cumsum(head), np.cumsum(fence)
        heads = np.flatnonzero(head)
        many = len(heads) + 1  # pieces; the first goes on from before
        base_row = np.concatenate([[was.row if was else 0], row[heads]])
        base_fences = np.concatenate([[-was.closed if was else 0], fences[heads] - fence[heads]])
        in_paste = np.where(last_start < 0, self.heads + piece, piece - piece[last_start] + head[last_start])
        place, level = row - base_row[piece] + 1, fences - base_fences[piece]
        third = np.full(many, was.third if was else 0, np.int64)
        thirds = np.flatnonzero(inside & (place == 3))
        third[piece[thirds]] = no[thirds]
        matches = lambda pattern: inside & pc.match_substring_regex(line, pattern).to_numpy(zero_copy_only=False)
        marked = [inside & (place == 1), inside & (place == 2), matches(m.spec) & (place >= 3) & (no < third[piece] + m.spec_lines), *map(matches, m.dates)]
        firsts = np.full((len(marked), many), -1)
        for k, x in enumerate(marked):
            where = np.flatnonzero(x)
            of, seen = np.unique(piece[where], return_index=True)
            firsts[k, of] = where[seen]
        closed = np.bincount(piece[inside & fence], minlength=many)
        noted = np.flatnonzero(inside & ~fence & (level > 0))
        of, seen = np.unique(piece[noted], return_index=True)
        first_level = np.zeros(many, np.int64)
        first_level[of] = level[noted[seen]]
        if was and was.level:
            first_level[0] = was.level
        noted = noted[level[noted] == first_level[piece[noted]]]
        ends = np.searchsorted(piece[noted], np.arange(many + 1)).astype(np.int32)
        notes = pc.binary_join(pa.ListArray.from_arrays(ends, trimmed.take(pa.array(noted))), " ")
        line_at = lambda k, p: line[int(firsts[k, p])].as_py() if firsts[k, p] >= 0 else None

        if was:  # what this chunk says of the listing that was open
            was.third = int(third[0])
            was.closed += int(closed[0])
            was.level = int(first_level[0])
            more = notes[0].as_py()
            if len(was.notes) < m.length:
                was.notes = (was.notes + " " + more if was.notes and more else was.notes + more)[: m.length]
            was.firsts = [x if x is not None else line_at(k, 0) for k, x in enumerate(was.firsts)]
            if many > 1 or not inside[-1]:
                self._close()
        whole = np.arange(1, many - 1 if inside[-1] else many)
        if len(whole):
            picked = [line.take(pa.array(firsts[k, whole], mask=firsts[k, whole] < 0)) for k in range(len(FIRSTS))]
            told = pa.array((first_level[whole] > 0) & (closed[whole] > first_level[whole]))
            memo = pc.if_else(told, pc.utf8_slice_codeunits(notes.take(pa.array(whole)), 0, m.length), pa.scalar(None, pa.string()))
            self._emit(paste.take(pa.array(heads[whole - 1])), pa.array(in_paste[heads[whole - 1]], pa.int64()), *picked, memo)
        if inside[-1] and many > 1:
            p, h = many - 1, heads[-1]
            self.open = Open(paste.slice(int(h), 1), int(in_paste[h]), int(row[h]), int(third[p]), int(closed[p]), int(first_level[p]), notes[p].as_py()[: m.length], [line_at(k, p) for k in range(len(FIRSTS))])
        self.heads = int(in_paste[-1])

    def end(self) -> None:
        self._close()


def splitter(marks: Marks, today: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over paste, no, line, row (of the paste, from 1), in order: a row for each listing. today: days since 1970."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, held = Splitter(marks, today), []

        def work(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            paste, no, line, row = (x.chunk(0) for x in table.columns)
            n = len(line) if last else len(line) - 1
            if n:
                state.add(paste, no.to_numpy(), line.cast(pa.string()), row.to_numpy(), n)
            held[:] = [] if last else [table.slice(n).to_batches()[0]]
            if last:
                state.end()
            yield from state.out
            state.out = []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) > LINES or sum(x.nbytes for x in held) > BYTES:
                yield from work(False)
        if held:
            yield from work(True)

    return run
