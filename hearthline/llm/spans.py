"""All matches of a pattern in a text, with their places, in DataFrame functions.

Splitting by the pattern gives what stands between its matches, and extracting gives the
matches; their lengths, added up, give the places. Places are code points, ends exclusive.
Arrays are folded in chunks, so the work grows with the matches and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

SPANS = "array<struct<start:int,end:int,value:string>>"
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def unused(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it: no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns in one, so that columns made beside it clash with none of them."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def _chunks(items: Column) -> Column:
    """The numbers of the chunks of an array that isn't empty."""
    return F.sequence(F.lit(0), ((F.size(items) - 1) / CHUNK).cast("int"))


def _chunk(items: Column, c: Column) -> Column:
    return F.slice(items, c * CHUNK + 1, F.lit(CHUNK))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, which must
    not be empty. Only texts with a match pay for the extraction."""
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    none = F.expr(f"cast(array() as {SPANS})")
    pairs = bound(found, lambda f: F.zip_with(F.slice(gaps, 1, F.size(f)), f, lambda g, v: F.struct(g.alias("gap"), F.length(v).alias("n"), v.alias("value"))))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), x["value"].alias("value"))
        return F.struct((begin + x["n"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def placed(p: Column) -> Column:
        lengths = F.transform(_chunks(p), lambda c: F.aggregate(_chunk(p, c), F.lit(0), lambda acc, x: acc + x["gap"] + x["n"]))
        before = lambda own, c: F.aggregate(F.slice(own, F.lit(1), c), F.lit(0), lambda acc, x: acc + x)
        return bound(lengths, lambda own: F.flatten(F.transform(own, lambda _, c: F.aggregate(_chunk(p, c), F.struct(before(own, c).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))))

    return F.when(text.rlike(pattern), bound(pairs, placed)).otherwise(none)


def cut(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of spans; those that overlap are one. spans:
    array<struct<start, end>> by start, not empty."""

    def chunk(s: Column, ends: Column, own: Column, c: Column) -> Column:
        before = F.aggregate(F.slice(ends, F.lit(1), c), F.lit(0), lambda acc, x: F.greatest(acc, x))

        def of(b: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                gap = F.substring(b["part"], acc["at"] - b["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
                out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
                return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

            return F.aggregate(_chunk(s, c), F.struct(b["at"].alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        part = bound(before, lambda at: F.struct(at.alias("at"), F.substring(text, at + 1, F.greatest(own - at, F.lit(0))).alias("part")))
        return bound(part, of)

    def over(s: Column) -> Column:
        ends = F.transform(_chunks(s), lambda c: F.aggregate(_chunk(s, c), F.lit(0), lambda acc, x: F.greatest(acc, x["end"])))
        tail = lambda e: F.substring(text, F.array_max(e) + 1, F.length(text))
        return bound(ends, lambda e: F.concat(F.array_join(F.transform(e, lambda own, c: chunk(s, e, own, c)), ""), tail(e)))

    return bound(spans, over)


def listed(kind: Column, start: Column, end: Column) -> Column:
    """kind:start:end"""
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))
