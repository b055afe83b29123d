"""Linear recursions along an order: x = a x' + b, with x' the value before.

Two steps in a row are one step of the same form, so steps of a block of rows are composed first, blocks
are put in order by their few composites, and each block then runs from the value that it begins with. A task
holds one block, or the composites of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearthline.operators.ranks import ranked

BLOCK = 256  # rows that are composed at once


def recursions(df: DataFrame, key: list[str], order: list[str], steps: dict[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """df with a column for each step, name: (a, b), that holds x after the row; x is zero before
    the first row. order makes rows of a key definite. a and b may use `at`, the row's place in its key from 0."""
    columns, names = df.columns, list(steps)
    placed = ranked(df, key, order, "at").withColumn("at", F.col("at") - 1)
    pair = F.struct(*(x.cast("double").alias(f"{side}{k}") for k, ab in enumerate(steps.values()) for side, x in zip("ab", ab, strict=True)))
    rows = placed.select(*key, F.floor(F.col("at") / block).alias("block"), F.struct("at", F.struct(*columns).alias("row"), pair.alias("s")).alias("r"))
    blocks = rows.groupBy(*key, "block").agg(F.array_sort(F.collect_list("r")).alias("rows"))

    def composed(acc: Column, r: Column) -> Column:
        s = r["s"]
        return F.struct(*(x.alias(f"{side}{k}") for k in range(len(names)) for side, x in (("a", s[f"a{k}"] * acc[f"a{k}"]), ("b", s[f"a{k}"] * acc[f"b{k}"] + s[f"b{k}"]))))

    one = F.struct(*(F.lit(v).alias(f"{side}{k}") for k in range(len(names)) for side, v in (("a", 1.0), ("b", 0.0))))
    whole = blocks.withColumn("c", F.aggregate("rows", one, composed))
    # a key's composites before a block, few as they are
    before = F.collect_list("c").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.struct(*(F.lit(0.0).alias(f"x{k}") for k in range(len(names))))
    start = F.aggregate("before", zero, lambda acc, c: F.struct(*((c[f"a{k}"] * acc[f"x{k}"] + c[f"b{k}"]).alias(f"x{k}") for k in range(len(names)))))
    begun = whole.withColumn("before", before).withColumn("start", start)

    def run(acc: Column, r: Column) -> Column:
        x = F.struct(*((r["s"][f"a{k}"] * acc["x"][f"x{k}"] + r["s"][f"b{k}"]).alias(f"x{k}") for k in range(len(names))))
        return F.struct(x.alias("x"), F.concat(acc["out"], F.array(x)).alias("out"))

    kind = "array<struct<" + ",".join(f"x{k}:double" for k in range(len(names))) + ">>"
    out = F.aggregate("rows", F.struct(F.col("start").alias("x"), F.expr(f"cast(array() as {kind})").alias("out")), run, lambda acc: acc["out"])
    each = begun.select(F.explode(F.zip_with("rows", out, lambda r, x: F.struct(r["row"].alias("row"), r["at"].alias("at"), x.alias("x")))).alias("e"))
    return each.select("e.row.*", F.col("e.at").alias("at"), *(F.col(f"e.x.x{k}").alias(name) for k, name in enumerate(names)))
