"""Listing texts that are sought through once for all readers."""

from pyspark.sql import functions as F

from hearthline.functions import listings
from hearthline.plans import formulas

TEXTS = ["현대 104동\n매매 5억 2,000\n아파트88B㎡ (전용59B)8/15층남향", " \t34평/25.7평 고/23층", "3,360만원/3.3㎡평당가\n84m2 중층", "9.99평 84/84㎡", "10평 전용 9㎡", "", None]


def test_shared_searches_read_as_each_reader_does(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, t string")
    alone = rows.select("k", listings.price(F.col("t")).alias("price"), listings.areas(F.col("t")).alias("area"), listings.floors(F.col("t")).alias("floor")).orderBy("k").collect()
    shared = listings.with_readings(rows, F.col("t"), "k").drop("laid").orderBy("k").collect()
    assert alone == shared
    assert [tuple(r["area"])[:2] for r in shared] == [(59.0, 88.0), (84.96, 112.4), (84.0, None), (84.0, 84.0), (29.75, 33.06), (None, None), (None, None)]
    assert [r["price"] for r in shared] == [52000, None, None, None, None, None, None]


def test_a_text_is_cut_into_tokens_once_for_all_readers(spark):
    plan = formulas.parsed_listings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z]+|[가-힣]+") == 1
