"""Repair of conversations by signature deduplication.

A conversation is its rows by turn (nulls first, ties by role and text). Each row becomes one
character, its role's initial and first fault; the characters of a conversation, in pieces of
bounded length, are its signature. Each distinct signature is solved once, by a memoised recursion
over its halves: for every role that may stand before it and after it, the cheapest edits. Audits
(the edits' initials in order) are joined back by signature and replayed over the rows.

Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert of an empty text of user or
assistant 3; a truncated row that stays costs 3 more. Blank and duplicate rows must be deleted.
What is left is empty, or user and assistant in turn from user to assistant, with at most a system
row before them. Of equally cheap audits the least in ASCII order counts.

Rows: a null role or text is one space; a null turn comes before the others; a null conv_id is a
conversation like others. An empty role has no initial, so its row can't be kept. Roles count by
their first character. Rows that tie on turn come by role and then in an order that their texts
fix; equal rows are adjacent. Other columns than conv_id, turn, role and text are not read. Empty
tables give empty ones. A conversation of any length is ranked, solved and composed in pieces;
only its replay is one task's, as a stream, since a text's hash is one sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.memory import released
from hearthline.operators.ranks import ranked
from hearthline.storage import written

PIECE = 1024  # rows in a signature
FAN = 1024  # pieces that one composition takes

SPACE = r"\x20\x09-\x0D"
START, SYSTEM, USER, ASSISTANT = range(4)  # what stands last: nothing, or a row of this role
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
#: The role that an inserted or reroled row takes after each of these, by what then stands last.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: What has to follow the last row: edits and their cost.
TAIL = {START: ("", 0), SYSTEM: ("II", 2 * INSERT), USER: ("I", INSERT), ASSISTANT: ("", 0)}


# ---- faults and signatures


def damage(rows: DataFrame) -> DataFrame:
    """A noise model: rows dropped, emptied, without full stops, repeated or given to the user, by
    crc32 of conv_id:turn. Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    kept = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    worn = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return kept.select("conv_id", "turn", role.alias("role"), worn.alias("text"), times.alias("copy")).drop("copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv (never null), turn, role, digest (which orders texts and tells them apart), text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    digest = F.substring(F.unhex(F.sha2("text", 256)), 1, 16)
    return rows.select(text("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).select("conv", "turn", "role", digest.alias("digest"), "text")


def signatures(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each piece of a conversation: conv, piece, its signature, whether more follow, its
    first row's key, and counts of its faults. Each piece also sees the row after it."""
    said = F.col("text").rlike(f"[^{SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    facts = _keyed(rows).select("conv", "turn", "role", "digest", F.when(~said, "blank").when(~ended, "truncated").alias("fault"))
    placed = written(ranked(facts, ["conv"], ["turn", "role", "digest"], "at"), "placed")
    first = placed.groupBy("conv", "role", "digest").agg(F.min("at").alias("first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("at") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    known = placed.join(first, ["conv", "role", "digest"]).withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    own = F.floor((F.col("at") - 1) / piece)
    both = F.when((own > 0) & ((F.col("at") - 1) % piece == 0), F.array(own, own - 1)).otherwise(F.array(own))
    seen = known.select("conv", "turn", "role", "digest", "fault", "initial", "at", mark.alias("mark"), own.alias("own"), F.explode(both).alias("piece"))
    mine = F.col("own") == F.col("piece")
    items = F.sort_array(F.collect_list(F.struct("at", "initial", "turn", F.when(mine, F.col("mark")).otherwise("").alias("mark"))))
    count = lambda kind: F.count_if(mine & (F.col("fault") == kind)).alias(kind)
    per = seen.groupBy("conv", "piece").agg(
        items.alias("items"), F.bool_or(~mine).alias("more"), count("blank"), count("duplicate"), count("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.min_by(F.struct("turn", "role", "digest"), F.col("at")).alias("key"),
    )
    pairs = F.zip_with(F.slice("items", F.lit(1), F.size("items") - 1), F.slice("items", F.lit(2), F.size("items") - 1), lambda a, b: F.struct(F.concat(a["initial"], b["initial"]).alias("roles"), (a["turn"] < b["turn"]).alias("later")))
    return per.withColumn("pairs", pairs).select(
        "conv", "piece", F.array_join(F.transform("items", lambda x: x["mark"]), "").alias("signature"), "more", "blank", "duplicate", "truncated", "low", "high", "key.*",
        F.size(F.filter("pairs", lambda p: ~p["roles"].isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.size(F.filter("pairs", lambda p: F.coalesce(p["later"], F.lit(False)))).cast("long").alias("steps"),
    )


# ---- the cheapest edits

Table = tuple[tuple[tuple[int, str] | None, ...], ...]  # by what stands before and after: cost and audit


@lru_cache(maxsize=64)
def _single(mark: str) -> Table:
    """The edits of one row. Inserts come before the row; after the last row comes the tail."""
    role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(mark.lower())
    extra = TRUNCATED if mark.isupper() else 0
    out = []
    for before in range(4):
        found: dict[int, tuple[int, str]] = {}
        at = before
        for inserts in range(3):  # a third insert would only come back to what stood last
            ways = [(DELETE, "D", at)]
            if mark != "x":
                ways.append((REROLE + extra, "R", TURN[at]))
                if role == TURN[at] or (role == SYSTEM and at == START):
                    ways.append((extra, "K", role))
            for cost, edit, after in ways:
                way = (inserts * INSERT + cost, "I" * inserts + edit)
                found[after] = min(found.get(after, way), way)
            at = TURN[at]
        out.append(tuple(found.get(after) for after in range(4)))
    return tuple(out)


def _then(left: Table, right: Table) -> Table:
    """Audits of equal cost end with a row's edit and have the same rows, so none begins another
    and the least of each part is in the least whole."""
    return tuple(
        tuple(min(((a[0] + b[0], a[1] + b[1]) for mid in range(4) if (a := left[i][mid]) and (b := right[mid][j])), default=None) for j in range(4)) for i in range(4)
    )


@lru_cache(maxsize=8192)
def solve(signature: str) -> Table:
    """The cheapest edits of a signature, for each state before and after it."""
    if len(signature) == 1:
        return _single(signature)
    half = len(signature) // 2
    return _then(solve(signature[:half]), solve(signature[half:]))


def _finish(costs: list[int | None], orders: list[int | None]) -> int:
    """What stands last in the cheapest whole, from the costs and orders of audits that begin at START."""
    return min((costs[j] + TAIL[j][1], orders[j], j) for j in range(4) if costs[j] is not None)[2]


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for signature in batch["signature"]:
            flat = [x for row in solve(signature) for x in row]
            order = {a: k for k, a in enumerate(sorted({x[1] for x in flat if x}))}
            costs, orders = [x and x[0] for x in flat], [x and order[x[1]] for x in flat]
            rows.append((signature, costs, orders, [x and x[1] for x in flat], _finish(costs, orders)))
        yield pd.DataFrame(rows, columns=["signature", "costs", "orders", "audits", "last"])


SOLVED = "signature string, costs array<long>, orders array<int>, audits array<string>, last int"


def _chain(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    """The cheapest ways through consecutive nodes, as the states between them."""
    nodes = nodes.sort_values("node")
    costs, orders, paths = [], [], []
    for i in range(4):
        best = {i: (0, 0, str(i))}
        for cost, order in zip(nodes["costs"], nodes["orders"], strict=True):
            found: dict[int, tuple] = {}
            for mid, (c, o, path) in best.items():
                for j in range(4):
                    k = 4 * mid + j
                    if cost[k] is not None and cost[k] == cost[k]:
                        way = (c + int(cost[k]), (o, int(order[k])), path + str(j))
                        found[j] = min(found.get(j, way), way)
            rank = {o: k for k, o in enumerate(sorted({x[1] for x in found.values()}))}
            best = {j: (c, rank[o], path) for j, (c, o, path) in found.items()}
        for j in range(4):
            c, o, path = best.get(j, (None, None, None))
            costs.append(c), orders.append(o), paths.append(path)
    return pd.DataFrame([(key[0], key[1], costs, orders, paths)], columns=["conv", "node", "costs", "orders", "paths"])


def _states(pieces: DataFrame, fan: int) -> DataFrame | None:
    """conv, piece, before, after: the states around each piece of conversations that have several.
    pieces: conv, piece, more, costs, orders. Levels of compositions, each of at most `fan` nodes."""
    nodes = written(pieces.where("piece > 0 or more").select("conv", F.col("piece").alias("node"), "costs", "orders"), "nodes")
    if nodes.isEmpty():
        return None
    levels = []
    while True:
        groups = nodes.withColumn("up", F.floor(F.col("node") / fan))
        nodes = written(groups.groupBy("conv", "up").applyInPandas(_chain, "conv string, node long, costs array<long>, orders array<int>, paths array<string>"), "nodes")
        levels.append(nodes)
        if nodes.agg(F.max("node")).first()[0] == 0:
            break
    total = lambda j: F.col("costs")[j] + TAIL[j][1]
    ends = F.array_min(F.filter(F.array(*(F.when(F.col("costs")[j].isNotNull(), F.struct(total(j).alias("c"), F.col("orders")[j].alias("o"), F.lit(j).alias("j"))) for j in range(4))), lambda x: x.isNotNull()))
    picks = nodes.select("conv", F.lit(0).cast("long").alias("node"), F.lit(START).alias("before"), ends["j"].alias("after"))
    for level in reversed(levels):
        path = F.expr("paths[4 * before + after]")
        way = level.join(picks, ["conv", "node"]).select("conv", "node", path.alias("path"))
        steps = way.select("conv", "node", "path", F.posexplode(F.expr("sequence(1, length(path) - 1)")))
        state = lambda k: F.expr(f"cast(substring(path, pos + {k}, 1) as int)")
        picks = steps.select("conv", (F.col("node") * fan + F.col("pos")).alias("node"), state(1).alias("before"), state(2).alias("after"))
    return picks.withColumnRenamed("node", "piece")


def audits(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> DataFrame:
    """One row for each piece of a conversation: conv, piece, the key of its first row, counts of
    faults, and its audit with its cost."""
    pieces = written(signatures(rows, piece), "pieces")
    solved = written(pieces.select("signature").distinct().mapInPandas(_solved, SOLVED), "solved")
    known = pieces.join(solved, "signature").withColumn("before", F.lit(START))
    states = _states(known, fan)
    if states is None:
        known = known.withColumn("after", F.col("last"))
    else:
        known = known.drop("before").join(states, ["conv", "piece"], "left").withColumns({"after": F.coalesce("after", "last"), "before": F.coalesce("before", F.lit(START))})
    tail = lambda k: F.when(F.col("more"), F.lit(("", 0)[k])).otherwise(F.element_at(F.create_map(*(F.lit(x) for j in TAIL for x in (j, TAIL[j][k]))), F.col("after")))
    at = F.col("before") * 4 + F.col("after")
    return known.select(
        "conv", "piece", "turn", "role", "digest", "more", "blank", "duplicate", "truncated", "illegal", "low", "high", "steps",
        F.concat(F.get("audits", at), tail(0)).alias("audit"), (F.get("costs", at) + tail(1)).alias("cost"),
    )


def report(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, for each conversation of rows."""
    total = lambda c: F.sum(c).alias(c)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "audit"))), lambda x: x["audit"]), "")
    gaps = F.coalesce(F.max("high") - F.min("low") - F.sum("steps"), F.lit(0))
    per = found.groupBy("conv").agg(gaps.alias("gaps"), *map(total, ("blank", "duplicate", "truncated", "illegal", "cost")), whole.alias("audit"))
    ids = rows.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return ids.join(per, "conv", "left").select("conv_id", "conv", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"))


# ---- replay

REPAIRED = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])
NAMES = {USER: "user", ASSISTANT: "assistant"}


@released
def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of conversations in order, with audits before the rows that they begin at."""
    conv, state, seq, pending, at = None, START, 0, "", 0
    out: list[tuple] = []

    def put(role: str, text: str) -> None:
        nonlocal seq
        out.append((conv, seq, role, text))
        seq += 1

    def inserts() -> None:
        nonlocal state, at
        while at < len(pending) and pending[at] == "I":
            state = TURN[state]
            put(NAMES[state], "")
            at += 1

    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "role", "text", "audit")]
        for c, role, text, audit in zip(*columns, strict=True):
            if c != conv:
                inserts()
                conv, state, seq, pending, at = c, START, 0, "", 0
            if audit is not None:
                pending, at = pending[at:] + audit, 0
                continue
            inserts()
            edit, at = pending[at], at + 1
            if edit == "K":
                state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                put(role, text)
            elif edit == "R":
                state = TURN[state]
                put(NAMES[state], text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), REPAIRED, strict=True)], schema=REPAIRED)
            out.clear()
    inserts()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), REPAIRED, strict=True)], schema=REPAIRED)


def replay(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv, seq (from 0), role, text of the repaired conversations. Rows of a conversation lie
    together, in order."""
    nothing = F.lit(None).cast("string")
    texts = _keyed(rows).select("conv", "turn", "role", "digest", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("piece"), "text", nothing.alias("audit"))
    edits = found.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), "piece", nothing.alias("text"), "audit")
    order = ["conv", "turn", "role", "digest", "kind", "piece"]
    lines = texts.unionByName(edits).repartition("conv").sortWithinPartitions(*order)
    return lines.select("conv", "role", "text", "audit").mapInArrow(_replay, "conv string, seq long, role string, text string")


@released
def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running = None, None
    for batch in batches:
        done = []
        for c, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256(line)
            else:
                running.update(b"\n")
                running.update(line)
        if done:
            yield pa.RecordBatch.from_pydict({"conv": [x[0] for x in done], "repaired_sha256": [x[1] for x in done]})
    if running is not None:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [running.hexdigest()]})


def digest(repaired: DataFrame) -> DataFrame:
    """conv, repaired_sha256: of role:text, newline-joined, from rows that lie as replay leaves them."""
    line = F.concat("role", F.lit(":"), "text").cast("binary")
    return repaired.select("conv", line.alias("line")).mapInArrow(_hash, "conv string, repaired_sha256 string")


def repair(rows: DataFrame, piece: int = PIECE, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(a report of each conversation, the repaired rows)."""
    found = written(audits(rows, piece, fan), "audits")
    return report(rows, found), replay(rows, found)
