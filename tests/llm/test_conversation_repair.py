"""Repair of conversations against a search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from hearthline.llm import conversation_repair as cr
from hearthline.llm.queries import op13_conversation_repair

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def worn(rows):
    """conv_id -> rows after damage, by turn, from (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        lines = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        lines += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for lines in out.values():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).digest()[:16]))
    return out


def plain(lines):
    """The contract, row by row; the cheapest edits by a search that grows whole audits."""
    seen, faults = set(), []
    for _, role, text in lines:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in lines if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, r, _ in lines]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    best = {"": (0, "", ())}  # by what stands last

    def add(to, state, way):
        if state not in to or way[:2] < to[state][:2]:
            to[state] = way

    def follows(last, role):
        return role in {"": "su", "s": "u", "u": "a", "a": "u"}[last]

    def inserted(ways):
        for _ in range(3):
            for last, (c, a, t) in list(ways.items()):
                for name in ("user", "assistant"):
                    if follows(last, name[0]):
                        add(ways, name[0], (c + 3, a + "I", (*t, f"{name}:")))
        return ways

    for (_, role, text), fault in zip(lines, faults):
        to = {}
        for last, (c, a, t) in inserted(best).items():
            add(to, last, (c + 4, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            if role[:1] in ("s", "u", "a") and follows(last, role[:1]):
                add(to, role[:1], (c + more, a + "K", (*t, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if follows(last, name[0]):
                    add(to, name[0], (c + 3 + more, a + "R", (*t, f"{name}:{text}")))
        best = to
    cost, audit, kept = min(way for last, way in inserted(best).items() if last in ("", "a"))
    kinds = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *kinds, illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def got(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    worn_rows = cr.damage(df)
    found = cr.written(cr.audits(worn_rows, **sizes), "audits")
    per = cr.report(df, found).toPandas().set_index("conv")
    hashes = dict(map(tuple, cr.digest(cr.replay(worn_rows, found)).collect()))
    none = hashlib.sha256(b"").hexdigest()
    return {None if k == " " else int(k): (*r[["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]], hashes.get(k, none)) for k, r in per.iterrows()}


def talks(seed, conversations, longest):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"]
    texts = ["Yes.", "No!", "Why", "  ", "", None, "Well?\n", "a.b", "x. y", " ", "\U0001f600."]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rng.randint(0, longest)):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.5 else f"Line {turn}."
            rows.append((conv, turn + rng.randint(0, 3) if rng.random() < 0.9 else None, role, text))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("sizes", [{}, {"piece": 4, "fan": 2}, {"piece": 1, "fan": 3}])
def test_random_conversations(spark, sizes):
    rows = talks(5, 60, 30)
    want = {c: plain(lines) for c, lines in worn(rows).items()}
    assert got(spark, rows, **sizes) == want


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Text {k}.") for k in range(6000)] + [(2, 0, "user", "Hello."), (3, None, None, None)]
    want = {c: plain(lines) for c, lines in worn(rows).items()}
    assert got(spark, rows) == want


def test_halves_of_a_signature_solve_it():
    rng = random.Random(2)
    for _ in range(200):
        mark = "".join(rng.choices("suaoxSUAO", k=rng.randint(2, 12)))
        whole = cr.solve(mark)
        for cut in range(1, len(mark)):
            assert cr._then(cr.solve(mark[:cut]), cr.solve(mark[cut:])) == whole


def test_query_against_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain(lines) for c, lines in worn(rows).items()}
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r[c] for c in columns) for r in op13_conversation_repair(spark, DATA).collect()} == want


def test_sql(same):
    from hearthline.llm.queries import oracle_sql

    same(op13_conversation_repair, oracle_sql()["op13_conversation_repair"])


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, rows = cr.repair(empty)
    assert report.count() == rows.count() == 0
    lines = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes"), (2, 0, "assistant", "So.")]
    plain_rows = spark.createDataFrame(lines, "conv_id long, turn long, role string, text string")
    from pyspark.sql import functions as F

    clashing = plain_rows.withColumns({c: F.lit(9.0) for c in ("conv", "piece", "digest", "kind", "at", "audit", "mark", "own", "costs", "node")})
    a, b = cr.repair(plain_rows), cr.repair(clashing)
    assert [sorted(map(tuple, x.collect())) for x in a] == [sorted(map(tuple, x.collect())) for x in b]
    assert sorted(map(tuple, b[1].collect())) == [("1", 0, "user", "Hi."), ("1", 1, "assistant", "Yes"), ("2", 0, "user", ""), ("2", 1, "assistant", "So.")]
