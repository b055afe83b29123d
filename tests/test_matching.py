"""Pastes that split back, and names against every pair."""

import random

from pyspark.sql import functions as F

from hearthline.plans import matching

CARD = '수원센트럴아이파크자이 129동\n매매 4억 2,000\n아파트17평 (전용12)3/25층남서향\n"\n달리는 황소 입주가능,시에2대 대중교통용이\n"\n집주인확인매물 2026.09.23'
NOISY = '임광 8동\n매매 3억\n84㎡ 5/10층\n임대분양가27,000 홍보문구\n"\n"\n세끼고 피3000 확정가500할인됨\n"'
OPEN = 'X 101동\n매매 4억\n84㎡ 5/10층\n"\n닫지 않은 메모'
LATE = 'Y 3동\n\n전세 2억\n공유하기\n알림\n59㎡ 저/9층\n등록 2027.01.01'
AGO = 'Z 4동\n월세 1억\n30평 4/9층\n5일 전'
BARE = '이름만\n매매 억단위'


def _split(spark, text):
    lines = [(1, k, x) for k, x in enumerate(text.split("\n"))]
    found = matching.split(spark.createDataFrame(lines, "paste long, no long, line string").repartition(3), "2026-10-15").orderBy("block").collect()
    return [(r["text"], str(r["confirmed_on"]) if r["confirmed_on"] else None, r["memo"]) for r in found]


WANT = {
    CARD: ("\n".join(CARD.split("\n")[:3]), "2026-09-23", "달리는 황소 입주가능,시에2대 대중교통용이"), NOISY: ("\n".join(NOISY.split("\n")[:3]), None, "세끼고 피3000 확정가500할인됨"),
    OPEN: ("\n".join(OPEN.split("\n")[:3]), None, None), LATE: ("Y 3동\n전세 2억\n59㎡ 저/9층", None, None), AGO: ("\n".join(AGO.split("\n")[:3]), "2026-10-10", None), BARE: (BARE, None, None),
}


def test_shuffled_layouts_split_back(spark):
    rng = random.Random(3)
    for n in (1, 4, 25):
        cards = rng.choices([c for c in WANT if c != BARE] + [BARE], k=n)
        assert _split(spark, "광고 문구\n\n" + "\n\n".join(cards) + "\n") == [WANT[c] for c in cards]
    assert _split(spark, "가격이 없는 글\n\n두 줄") == []


def test_names_against_every_pair(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(2, 7)))
    names = [(k, word()) for k in range(120)]
    texts = [(1000 + k, word() + rng.choice(names)[1] + word() if k % 2 else word() + word()) for k in range(80)]
    found = matching.candidates(spark.createDataFrame(texts, "id long, key string").repartition(3), spark.createDataFrame(names, "complex_id long, key string").repartition(2))
    got = {}
    for r in found.orderBy("id", "place").collect():
        got.setdefault(r["id"], []).append((r["matched"], r["complex_id"], r["exact"]))
    for i, text in texts:
        want = sorted(((-len(n), k) for k, n in names if len(n) >= 3 and n in text))
        exact = bool(want)
        if not exact:
            shared = lambda n: next((m for m in range(min(len(n), len(text)), 3, -1) if n[:m] == text[:m]), 0)
            want = sorted((-shared(n), k) for k, n in names if shared(n))
        assert got.get(i, []) == [(-m, k, exact) for m, k in want[:6]]


def test_a_building_tells_namesakes_apart(spark):
    found = spark.createDataFrame([(1, 10, 4, True, 1), (1, 11, 4, True, 2), (2, 10, 4, True, 1), (2, 11, 4, True, 2), (3, 12, 5, False, 1), (4, 13, 6, True, 1), (4, 10, 4, True, 2)], "id long, complex_id long, matched int, exact boolean, place int")
    texts = spark.createDataFrame([(1, 101), (2, 999), (3, 101), (4, None)], "id long, building long")
    buildings = spark.createDataFrame([(10, 101), (11, 102)], "complex_id long, building long")
    got = {r["id"]: (r["candidates"], r["matched"], r["exact"], r["complex_id"]) for r in matching.resolved(found, texts, buildings).collect()}
    assert got == {1: ("10,11", 4, True, 10), 2: ("10,11", 4, True, None), 3: ("12", 5, False, None), 4: ("13,10", 6, True, 13)}
    assert matching.candidates(texts.select("id", F.lit("abc").alias("key")).limit(0), buildings.select("complex_id", F.lit("abc").alias("key"))).count() == 0


def test_one_order_of_a_paste_serves_all_counts(spark):
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(CARD.split("\n"))], "paste long, no long, line string")
    plan = matching.split(lines, "2026-10-15")._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(paste" in plan and not any("block#" in spec.split("no#")[0] for spec in plan.split("windowspecdefinition(")[1:])
