"""Pastes that are split as a stream of chunks, wherever a chunk ends."""

import datetime
import random

import pyarrow as pa

from hearthline.operators import blocks
from hearthline.plans import matching
from tests.test_matching import CARD, LATE, WANT

TODAY = (datetime.date(2026, 10, 15) - datetime.date(1970, 1, 1)).days
#: a note of many lines, cut at 300 letters, a second note that doesn't count, and a day that isn't one
LONG = "긴 9동\n매매 5억\n84㎡ 5/10층\n\"\n" + "\n".join(f"줄 {k} 확정" for k in range(80)) + '\n"\n둘째\n"\n세째\n"\n집주인확인 26.02.30\n등록 2026.01.02'
HEADS = "광고 문구\n이름 1동\n매매 1억\n매매 2억\n매매 3억"


def _split(pastes, rng):
    rows = [(p, no, line, row) for p, text in pastes for row, (no, line) in enumerate([(k, x) for k, x in enumerate(text.split("\n")) if x.strip(" \r\t")], 1)]
    table = pa.table({"paste": [r[0] for r in rows], "no": [r[1] for r in rows], "line": [r[2] for r in rows], "row": [r[3] for r in rows]})
    batches, at = [], 0
    while at < len(rows):
        n = rng.randint(0, 4)
        batches += [table.to_batches()[0].slice(at, n)]
        at += n
    return [r for b in blocks.splitter(matching.MARKS, TODAY)(iter(batches)) for r in b.to_pylist()]


def test_listings_go_on_from_chunk_to_chunk(monkeypatch):
    rng = random.Random(11)
    want_long = (*LONG.split("\n")[:3], None, " ".join(f"줄 {k} 확정" for k in range(80))[:300])
    want = {c: (*(t.split("\n") + [None] * 3)[:3], datetime.date.fromisoformat(d) if d else None, m) for c, (t, d, m) in WANT.items()} | {LONG: want_long}
    for lines in (0, 1, 2, 3, 7, 1 << 14):
        monkeypatch.setattr(blocks, "LINES", lines)
        cards = [(p, rng.choices(list(want), k=rng.randint(0, 6))) for p in range(25)]
        got = _split([(p, "\n\n".join(["광고 문구", *own])) for p, own in cards], rng)
        assert [(r["paste"], r["block"], r["name"], r["price"], r["spec"], r["confirmed_on"], r["memo"]) for r in got] == [(p, k, *want[c]) for p, own in cards for k, c in enumerate(own, 1)]
        got = _split([(7, HEADS), (8, "매매 1억"), (9, HEADS)], rng)
        assert [(r["paste"], r["block"], r["name"], r["price"], r["spec"]) for r in got] == [(p, k, a, b, None) for p in (7, 9) for k, (a, b) in enumerate([("이름 1동", None), ("매매 1억", None), ("매매 2억", "매매 3억")], 1)]


def test_lines_are_read_in_one_pass(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate((CARD + "\n" + LATE).split("\n"))], "paste long, no long, line string")
    plan = matching.split(lines, "2026-10-15")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" not in plan
