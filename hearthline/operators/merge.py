"""Merges of a table with what was fetched anew, as DataFrames of the table to write.

One grouped aggregate over the union of both does each merge: no row is looked up one by one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: that with the greatest `version`; of equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*(F.col(c) for c in old.columns))
    best = both.groupBy(*keys).agg(F.max_by(row, F.struct(version, "_new")).alias("_row"))
    return best.select("_row.*").select(*old.columns)


def _newest(columns: list[str]) -> list:
    """Each column of the new row, or where that has none of the old one. A key has one row on each side at most."""
    of = lambda c, side: F.max(F.when(F.col("_new") == side, F.col(f"`{c}`")))
    return [F.coalesce(of(c, 1), of(c, 0)).alias(c) for c in columns]


def seen(old: DataFrame, now: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Snapshot of units: keys, first_seen, last_seen, and what else old holds of a unit, as now tells it where it
    does. now: the units found on day; rows that repeat a key count once."""
    rest = [c for c in old.columns if c not in [*keys, "first_seen", "last_seen"]]
    today = now.select(*keys, *(c for c in rest if c in now.columns)).dropDuplicates(keys).withColumns({"first_seen": F.lit(day), "last_seen": F.lit(day), "_new": F.lit(1)})
    both = old.withColumn("_new", F.lit(0)).unionByName(today, allowMissingColumns=True)
    per = both.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), *_newest(rest))
    return per.select(*old.columns)


def gone(units: DataFrame, before: DataFrame, today: DataFrame, part: str, day: str) -> DataFrame:
    """Units last seen before day, only in parts that were scanned before and on day, so that a part
    that wasn't scanned tells nothing. before, today: the parts scanned."""
    both = before.select(part).intersect(today.select(part))
    return units.where(F.col("last_seen") < day).join(both, part, "left_semi")


def filled(table: DataFrame, details: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """table with columns taken from details where it has them; a zero there is unknown."""
    known = details.select(*keys, *(F.when(F.col(c) != 0, F.col(c)).alias(f"_{c}") for c in columns))
    return table.join(known, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def put(old: DataFrame, notes: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Notes by key: a new text replaces the old one, a blank text deletes it; other columns stay unless
    notes tell them anew."""
    both = old.withColumn("_new", F.lit(0)).unionByName(notes.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in old.columns if c not in [*keys, text]]
    best = both.groupBy(*keys).agg(F.max_by(text, "_new").alias(text), *_newest(rest))
    return best.where(F.trim(F.coalesce(text, F.lit(""))) != "").select(*old.columns)


def common(tables: list[DataFrame], key: str) -> DataFrame:
    """The keys that every table has."""
    return reduce(lambda a, b: a.intersect(b), (t.select(key) for t in tables))
