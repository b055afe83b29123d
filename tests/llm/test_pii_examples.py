"""The trees and thresholds of op8 come from every document."""

from pyspark.sql import functions as F

from hearthline.llm import pii


def test_examples_count_every_document(spark, monkeypatch):
    docs = spark.range(30_000).select("id", F.concat(F.lit("mail to user"), F.col("id").cast("string"), F.lit("@host.example.org or 10.0.0.7")).alias("text")).withColumnRenamed("id", "doc_id")
    seen, write = {}, pii.written
    monkeypatch.setattr(pii, "written", lambda df, name: seen.setdefault(name, write(df, name)))
    found = pii.candidates(docs)
    model, least = pii.train(found)
    assert model is not None and len(least) == 4
    got = seen["examples"]
    assert got.where("label = 1").agg(F.sum("weight")).first()[0] == found.where("base").count() == 60_000
