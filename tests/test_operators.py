"""Operators, parsers, signals and streams against plain loops and known values."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.functions import listings, scalars
from hearthline.operators import asof, merge, ranks
from hearthline.plans import signals
from hearthline.streaming import events

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_ranks_and_quantiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(None if k % 9 == 0 else "big" if k % 5 else "small", float(rng.integers(40)), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, id long").repartition(7)
    got = {r["id"]: r["rank"] for r in ranks.ranked(df, ["g"], ["v", "id"]).collect()}
    frame = pd.DataFrame(rows, columns=["g", "v", "id"]).sort_values(["v", "id"])
    want = frame.groupby("g", dropna=False).cumcount() + 1
    assert got == dict(zip(frame["id"], want, strict=True))
    q = {r["g"]: (r["n"], *r["q"]) for r in ranks.quantiles(df.where("g is not null"), ["g"], "v", [0.25, 0.5, 0.9]).collect()}
    for g, own in frame.dropna().groupby("g"):
        assert q[g] == pytest.approx((len(own), *np.quantile(own["v"], [0.25, 0.5, 0.9])))
    assert ranks.ranked(df.limit(0), ["g"], ["v"]).count() == 0


def test_as_of_with_reach_and_without_a_match(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5), (None, 5)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, None), ("c", 1, 1.0)], "k string, known long, v double")
    got = {(r["k"], r["t"]): (r["known"], r["v"]) for r in asof.as_of(left, right, ["k"], "t", "known", 3).collect()}
    assert got == {("a", 1): (None, None), ("a", 5): (5, None), ("a", 9): (None, None), ("b", 5): (None, None), (None, 5): (None, None)}


def test_within_is_that_of_a_theta_join(spark):
    rng = np.random.default_rng(2)
    a = [(int(rng.integers(3)), int(x), int(x + rng.integers(0, 9))) for x in rng.integers(-50, 50, 60)]
    b = [(int(rng.integers(3)), int(x)) for x in rng.integers(-60, 60, 80)]
    got = sorted(map(tuple, asof.within(spark.createDataFrame(a, "k int, low int, high int"), spark.createDataFrame(b, "k int, t int"), ["k"], "low", "high", "t", 8).select("k", "low", "high", "t").collect()))
    assert got == sorted((k, x, y, t) for k, x, y in a for j, t in b if j == k and x < t <= y)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5), (3, "c", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(1, "A", 1), (2, "B", 4), (4, "D", 1)], "id int, v string, version int")
    assert {tuple(r) for r in merge.upsert(old, new, ["id"], "version").collect()} == {(1, "A", 1), (2, "b", 5), (3, "c", 1), (4, "D", 1)}
    assert {tuple(r) for r in merge.upsert(old.limit(0), new, ["id"], "version").collect()} == {tuple(r) for r in new.collect()}
    units = spark.createDataFrame([(1, "p", "d1", "d1"), (2, "q", "d1", "d2")], "id int, part string, first_seen string, last_seen string")
    now = spark.createDataFrame([(2, "q"), (3, "q"), (3, "q")], "id int, part string")
    after = merge.seen(units, now, ["id", "part"], "d3")
    assert {tuple(r) for r in after.select("id", "first_seen", "last_seen").collect()} == {(1, "d1", "d1"), (2, "d1", "d3"), (3, "d3", "d3")}
    assert merge.gone(after, units, now, "part", "d3").count() == 0  # p wasn't scanned again
    assert [r["id"] for r in merge.gone(after, units, now.union(spark.createDataFrame([(9, "p")], now.schema)), "part", "d3").collect()] == [1]
    notes = spark.createDataFrame([(1, "x"), (2, "y")], "id int, note string")
    put = merge.put(notes, spark.createDataFrame([(1, " "), (3, "z")], "id int, note string"), ["id"], "note")
    assert {tuple(r) for r in put.collect()} == {(2, "y"), (3, "z")}


@pytest.mark.parametrize("text, want", [
    ("매매 8억 5,000", 85000), ("12억 3000 / 전용 84.9㎡ / 15층", 123000), ("매매 9억", 90000), ("9,500만", 9500), ("전세 500만", None), ("매매 13억\n112.9/84.9㎡", 130000), ("3억 84.9㎡", 30000), ("없음", None),
    ("매매 3억 2,500 ~ 3억 8,000\n84㎡ 5/10층", 32500), ("매매 3억 9,000\n평당가 2,100만원", 39000), ("3,360만원/3.3㎡평당가", None), ("매매 3억\n84㎡ 5/10층\n임대분양가27,000", 30000),
])
def test_prices(spark, text, want):
    assert one(spark, listings.price(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [
    ("아파트88B㎡ (전용59B)8/15층남향", (59.0, 88.0, True)), ("아파트 · 112.9/84.97㎡, 중층", (84.97, 112.9, True)), ("59.94/84.97㎡", (59.94, 84.97, True)), ("84.97㎡", (84.97, None, False)), ("34평/25.7평", (84.96, 112.4, True)), ("30평대", (None, None, False)), ("전용 112.40㎡", (112.4, None, True)),
    ("아파트17평 (전용12)3/25층남서향", (39.67, 56.2, True)), ("아파트49㎡ (전용36)3/15층", (36.0, 49.0, True)), ("전용14평 5/10층", (46.28, None, True)), ("전용 84㎡ / 15층", (84.0, None, True)), ("34평/25.7평 10/20층", (84.96, 112.4, True)),
    ("X\n매매 5억\n30평대 고층", (None, None, False)), ("매매 3억 9,000\n평당가 2,100만원\n84㎡ 5/10층", (84.0, None, False)), ("3,360만원/3.3㎡평당가\n84m2", (84.0, None, False)),
])
def test_areas(spark, text, want):
    assert tuple(one(spark, listings.areas(F.lit(text)))) == want


@pytest.mark.parametrize("text, want", [
    ("8/15층남향", (8, 15, None)), ("고/23층", (None, 23, "고층")), ("탑/9층", (None, 9, "최상층")), ("15층", (15, None, None)), ("중층, 남향", (None, None, "중층")), ("탑층", (None, None, "최상층")), ("없음", (None, None, None)),
    ("84㎡ 고/23층", (None, 23, "고층")), ("84㎡ 5/10층남동향", (5, 10, None)), ("아파트17평 (전용12)3/25층남서향", (3, 25, None)),
])
def test_floors(spark, text, want):
    assert tuple(one(spark, listings.floors(F.lit(text)))) == want


def test_buildings_facings_names_and_tags(spark):
    at = lambda f, *x: [one(spark, f(F.lit(t))) for t in x]
    assert at(listings.building, "힐스테이트푸르지오수원 103동\n매매", "인계동", "현대 가동", "이름\n12동", "A동 남동향", "X 가동", "X\n5/10층남동향", "현대 104동 3층") == ["103", None, "가", None, "A", "가", None, "104"]
    assert at(listings.facing, "11/12층동향", "메모 정남향", "3층 남서향") == ["동향", None, "남서향"]
    assert at(listings.facing_group, "남서향", "북동", "남향", "") == ["서", "북", "남", None]
    assert at(listings.name_key, "래미안 영통 마크원 제2단지 아파트", "A-B (1차)") == ["래미안영통마크원2단지", "ab1차"]
    assert at(listings.stated_price, "3,360만원/3.3㎡평당가", "100만원") == [3360, None]
    rules = [("cheap", "급매"), ("open", "즉시?\\s*입주"), ("view", "전망|뷰")]
    assert one(spark, listings.tags(F.lit("전망 좋은 급매"), rules)) == ["cheap", "view"]
    assert one(spark, listings.all_tags(F.array(F.lit("뷰"), F.lit(None), F.lit("급매 뷰")), rules)) == ["cheap", "view"]


def test_rings_curves_and_growth(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)]))
    assert one(spark, scalars.ring_area(ring)) == 12
    assert [one(spark, scalars.inside_ring(F.lit(x), F.lit(y), ring)) for x, y in [(1.0, 1.0), (5.0, 1.0), (3.9, 2.9), (-0.1, 1.0)]] == [True, False, True, False]
    assert one(spark, scalars.segment_distance(*map(F.lit, (0.0, 5.0, -3.0, 1.0, 3.0, 1.0)))) == 4
    assert one(spark, scalars.segment_distance(*map(F.lit, (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)))) == 5
    xs, ys = F.array(*map(F.lit, (0.0, 1.0, 3.0))), F.array(*map(F.lit, (0.0, 10.0, 20.0)))
    assert [one(spark, scalars.interpolated(xs, ys, F.lit(x))) for x in (-1.0, 0.5, 2.0, 9.0)] == [0, 5, 15, 20]
    assert one(spark, scalars.dot(xs, ys)) == 70
    assert one(spark, scalars.implied_growth(F.lit(100.0), F.lit(0.09), scalars.dcf(F.lit(100.0), F.lit(0.123), F.lit(0.09)))) == pytest.approx(0.123, abs=1e-12)
    assert one(spark, scalars.implied_growth(F.lit(100.0), F.lit(0.09), F.lit(1e9))) is None
    assert one(spark, scalars.area_type_key(F.lit(84.5))) == 84 and one(spark, scalars.area_type_key(F.lit(85.5))) == 86


def _days(close):
    return pd.DataFrame({"symbol": "x", "day": [f"{k:04}" for k in range(len(close))], "close": close})


def test_turns_alternate_and_look_at_no_later_day(spark):
    turns = lambda days: signals.turns(spark.createDataFrame(days)).orderBy("i").toPandas()
    rng = np.random.default_rng(6)
    close = (100 * np.exp(rng.normal(0, 0.02, 400).cumsum())).tolist()
    whole = turns(_days(close))
    assert len(whole) > 10 and (whole["top"].to_numpy()[1:] != whole["top"].to_numpy()[:-1]).all()
    for r in whole.itertuples():
        back = close[r.seen] / r.value - 1
        assert (back <= -signals.TURN if r.top else back >= signals.TURN) and r.i < r.seen
        own = close[r.i : r.seen + 1]
        assert r.value == (max(own) if r.top else min(own))
    for cut in (50, 200, 333):  # what was known by a day doesn't change afterwards
        early = turns(_days(close[:cut]))
        assert early.equals(whole[whole["seen"] < cut].reset_index(drop=True))
    assert turns(_days([1.0] * 9)).empty


def test_chains_are_as_many_as_overlap_at_once(spark):
    chains = lambda rows: signals.chains(spark.createDataFrame(rows)).orderBy("chain").toPandas()
    rng = np.random.default_rng(7)
    rows = [(1, "k", float(p), int(a), int(a + d)) for p, a, d in zip(rng.integers(9, size=60), rng.integers(0, 90_000, 60), rng.integers(0, 9_000, 60), strict=True)]
    got = chains(pd.DataFrame(rows, columns=["user_id", "kind", "price", "first_seen", "last_seen"]))
    at_once = max(sum(a <= t < b + signals.TOGETHER for *_, a, b in rows) for *_, t, _ in rows)
    assert len(got) == at_once and got["seen"].sum() == 60
    apart = pd.DataFrame([(1, "k", 5.0, 0, 10), (1, "k", 4.0, 2000, 2010), (1, "k", 3.0, 2005, 2010)], columns=["user_id", "kind", "price", "first_seen", "last_seen"])
    assert chains(apart)[["seen", "first_price", "last_price", "unsure"]].values.tolist() == [[2, 5.0, 4.0, False], [1, 3.0, 3.0, False]]


def test_stream_of_events_gives_the_rows_of_the_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in" / "a.parquet")
    shutil.copy(f"{DATA}/events.parquet", tmp_path / "in" / "b.parquet")  # delivered twice
    seen = events.once(events.stream(spark, str(tmp_path / "in")))
    query = seen.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    table = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.select("event_id").distinct().count()
    windows = events.by_window(events.stream(spark, str(tmp_path / "in")), late="400 days")
    query = windows.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r["kind"], r["start"]): 2 * r["n"] for r in events.by_window(table).collect()}
    assert {(r["kind"], r["start"]): r["n"] for r in spark.table("hours").collect()} == want


def test_quantiles_of_large_and_small_groups(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("big", float(x)) for x in rng.normal(size=30_000).round(3)] + [("tied", float(k % 3 == 0)) for k in range(25_000)] + [("small", float(k)) for k in range(7)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    at = [0.0, 0.05, 0.5, 0.66, 0.975, 1.0]
    want = {g: np.percentile([v for h, v in rows if h == g], [100 * q for q in at]) for g in {g for g, _ in rows}}
    for accuracy in (10_000, 1_000):
        monkeypatch.setattr(ranks, "ACCURACY", accuracy)
        got = {r["g"]: r["q"] for r in ranks.quantiles(df, ["g"], "v", at, hold=accuracy < 10_000).collect()}
        assert {g: pytest.approx(q, abs=1e-12) for g, q in want.items()} == got
    assert ranks.quantiles(df, [], "v", at).first()["q"] == pytest.approx(np.percentile([v for _, v in rows], [100 * q for q in at]), abs=1e-12)
    assert ranks.quantiles(df.limit(0), ["g"], "v", at).count() == 0


def test_median_beside_rows(spark):
    rows = [(k % 4, float((k * 37) % 11)) for k in range(27)]
    got = ranks.beside_median(spark.createDataFrame(rows, "g long, v double").repartition(3), ["g"], "v", "mid", "n").collect()
    for r in got:
        own = [v for g, v in rows if g == r["g"]]
        assert (r["n"], r["mid"]) == (len(own), np.median(own))
    assert len(got) == len(rows)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_recursions_equal_plain_loops(spark, block):
    from hearthline.operators.recursions import recursions

    rng = np.random.default_rng(9)
    rows = [(g, k, float(a), float(b)) for g, n in (("x", 40), ("y", 1), ("z", 7)) for k, (a, b) in enumerate(rng.uniform(-1, 1, (n, 2)))]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double").repartition(5)
    got = {(r["g"], r["k"]): (r["at"], r["x"], r["z"]) for r in recursions(df, ["g"], ["k"], {"x": (F.col("a"), F.col("b")), "z": (F.lit(1.0), F.col("at") * 1.0)}, block).collect()}
    x = z = 0.0
    for g, k, a, b in rows:
        x, z = (a * x + b, z + k) if k else (b, 0.0)
        assert got[g, k] == (k, pytest.approx(x, abs=1e-12), z)
    assert len(got) == len(rows)


def test_shapes_break_without_looking_ahead(spark):
    """Planted shapes break where they should, and what was known by a day doesn't change afterwards."""

    def days(close):
        return spark.createDataFrame([("x", f"{k:04}", float(v)) for k, v in enumerate(close)], "symbol string, day string, close double")

    leg = lambda a, b, n=25: list(np.linspace(a, b, n))
    double = leg(110, 100) + leg(100, 108) + leg(108, 100.5) + leg(100.5, 112)
    got = {r["kind"]: r for r in signals.breaks(days(double)).collect()}
    hit = got["double"]
    assert hit["side"] == 1 and hit["level"] == 108 and double[int(hit["day"])] > 108 >= max(double[int(hit["day"]) - 3 : int(hit["day"])])
    head = leg(90, 100) + leg(100, 95) + leg(95, 108) + leg(108, 95.5) + leg(95.5, 100.5) + leg(100.5, 88)
    assert any(r["kind"] == "head and shoulders" and r["side"] == -1 for r in signals.breaks(days(head)).collect())
    flag = leg(100, 112, 16) + leg(112, 107.5, 4) + leg(107.5, 118, 6)
    assert any(r["kind"] == "flag" and r["level"] == 112 for r in signals.breaks(days(flag)).collect())
    late = leg(100, 112, 16) + leg(112, 107.5, 8) + leg(107.5, 111.9, 30) + leg(111.9, 118, 12)
    assert not any(r["kind"] == "flag" for r in signals.breaks(days(late)).collect())  # waited longer than the pole
    rng = np.random.default_rng(12)
    close = (100 * np.exp(rng.normal(0, 0.015, 900).cumsum())).tolist()
    whole = {tuple(r) for r in signals.breaks(days(close)).collect()}
    assert len(whole) > 5
    for cut in (300, 650):
        assert {tuple(r) for r in signals.breaks(days(close[:cut])).collect()} == {r for r in whole if r[3] < f"{cut:04}"}


def test_normal_tail(spark):
    import math

    for z in (0.0, 0.5, -1.959963984540054, 4.0, 9.0):
        assert one(spark, scalars.normal_p(F.lit(z))) == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-9)


def test_merges_keep_what_else_is_known(spark):
    units = spark.createDataFrame([(1, "d1", "d1", "old", 5), (2, "d1", "d2", "kept", 6)], "id int, first_seen string, last_seen string, use string, n int")
    now = spark.createDataFrame([(1, "new"), (3, "fresh"), (3, "fresh")], "id int, use string")
    assert {tuple(r) for r in merge.seen(units, now, ["id"], "d3").collect()} == {(1, "d1", "d3", "new", 5), (2, "d1", "d2", "kept", 6), (3, "d3", "d3", "fresh", None)}
    notes = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (4, "w", "d")], "id int, note string, who string")
    told = spark.createDataFrame([(1, "z"), (2, " "), (3, "v")], "id int, note string")
    assert {tuple(r) for r in merge.put(notes, told, ["id"], "note").collect()} == {(1, "z", "a"), (3, "v", None), (4, "w", "d")}
