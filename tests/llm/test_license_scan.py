"""License scans against plain loops."""

import re

import pytest
from pyspark.sql import functions as F

from hearthline.llm import license_scan as ls
from hearthline.llm.license_rules import GRANT, MARK, NAME, SCORES, SPDX, TEXT, _names, rules
from hearthline.llm.queries import op11_license_scan, oracle_sql

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(ls.UPPER, ls.LOWER)


def plain(text):
    """(n_words, places, licenses): every rule over the whole text, once for each place of its keyword."""
    w = WORD.findall((text or "").translate(FOLD))
    places = [(i, label) for i in range(len(w)) for label, phrase in ls.PHRASES if w[i : i + len(phrase)] == phrase]
    found = []
    for order, rule in enumerate(rules()):
        for k in [i for i, x in enumerate(w) if x == rule.keyword]:
            line = " " + " ".join([*w[:k], MARK + w[k], *w[k + 1 :]]) + " "
            m = re.search(rule.pattern, line)
            if m:
                start = line[: m.start(1)].count(" ") - 1
                found.append((start, start + m.group(1).count(" ") + 1, rule.priority, order, rule.label))
    kept = [x for x in found if not any(y[0] <= x[0] and y[1] >= x[1] and y[2] <= x[2] and (y[1] - y[0] > x[1] - x[0] or y[2:4] < x[2:4]) for y in found)]
    return len(w), sorted(places), sorted((s, e, label, p) for s, e, p, _, label in kept)


TEXTS = [
    None, "", " \n--", "x", "MIT License", "mit-license MIT LICENSE mit license license", "The Apache License, Version 2.0 (the \"License\")", "GNU Lesser General Public License v2.1 or later",
    "SPDX-License-Identifier: Apache-2.0 OR MIT", "Licensed under CC BY-NC 4.0.", "under the GNU General Public License, version 3.", "BSD 3-Clause; new BSD license; 2 clause BSD",
    "Redistribution and use in source and binary forms, with or without modification, are permitted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "K MITé license MIT\u0085 license İ general public license ", "all rights reserved. Mozilla Public Licence 2.0, MPL v1.1 agplv3 LGPLv2", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "a" * 100_000, "general public license " * 3000, "licensed under the license mit mit license",
]


def rows_of(df):
    return [(r["n_words"], sorted((p["start"], p["label"]) for p in r["places"]), sorted((d["start"], d["end"], d["label"], d["priority"]) for d in r["licenses"])) for r in df.orderBy("doc_id").collect()]


def test_scan_against_plain_loops(spark):
    short = [t for t in TEXTS if len(t or "") < 5000]
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string").repartition(3)
    assert rows_of(ls.scan(df)) == [plain(t) for t in short]


def test_long_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").where("length(text) > 5000")
    got = rows_of(ls.scan(df))
    assert got[0] == (1, [], [])
    assert got[1][0] == 9000 and got[1][1] == [(3 * k, "gpl") for k in range(3000)] and got[1][2] == [(3 * k, 3 * k + 3, "gpl", NAME) for k in range(3000)]


def test_labels_and_scores(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS[6:12])], "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in ls.digest(ls.scan(df)).collect()}
    assert got == {
        0: ("apache,apache-2.0", SCORES[NAME]), 1: ("gpl,lgpl-2.1", SCORES[NAME]), 2: ("apache-2.0", SCORES[SPDX]), 3: ("cc-by-nc-4.0", SCORES[GRANT]), 4: ("gpl,gpl-3.0", SCORES[NAME]), 5: ("bsd-2-clause,bsd-3-clause", SCORES[NAME]),
    }


def test_rules_are_gated_and_bounded():
    every = rules()
    assert len(every) > 400 and len({r.label for r in every}) > 100
    for r in every:
        assert r.pattern.count(MARK) == 1 and MARK + r.keyword in r.pattern
        assert "*" not in r.pattern and "+)" not in r.pattern.replace("[^ ]+)", "")
    assert {r.priority for r in every} == {SPDX, TEXT, GRANT, NAME}


@pytest.mark.parametrize("label", ["mit", "apache-2.0", "gpl-3.0", "lgpl-2.1", "mpl-2.0", "cc-by-sa-4.0", "isc", "unlicense", "epl-2.0", "0bsd"])
def test_tag_of_a_label(label):
    assert (0, 3 + len(WORD.findall(label)), label, SPDX) in plain(f"SPDX-License-Identifier: {label}")[2]
    assert label in {x for x, _ in _names()}


def test_stronger_and_longer_intervals_suppress(spark):
    rows = [(0, -9, 3, 1, "a"), (0, -5, 1, 2, "b"), (1, -4, 2, 3, "c"), (1, -4, 0, 4, "d"), (2, -9, 3, 5, "e"), (10, -12, 3, 6, "f"), (10, -12, 3, 7, "g")]
    df = spark.createDataFrame([([dict(zip(("start", "rest", "priority", "order", "label"), r, strict=True)) for r in rows],)], "f array<struct<start:int,rest:int,priority:int,order:int,label:string>>")
    assert [d["label"] for d in df.select(ls.unsuppressed(F.array_sort("f")).alias("x")).first()["x"]] == ["a", "b", "d", "f"]


def test_query_against_plain_loops(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    for r in op11_license_scan(spark, DATA).collect():
        n, places, licenses = plain(texts[r["doc_id"]])
        starts = [s for s, _ in places]
        assert tuple(r)[1:7] == (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | {x[2] for x in licenses})))
        assert r["score"] == max([SCORES[p] for *_, p in licenses] + [SCORES[NAME]] * bool(places), default=0.0)


def test_sql(same):
    same(op11_license_scan, oracle_sql()["op11_license_scan"])


def test_odd_rows_and_clashing_columns(spark):
    rows = [(1, TEXTS[6]), (1, TEXTS[6]), (None, TEXTS[9]), (None, None), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ls.scan(df.limit(0)).count() == 0
    want = sorted(map(repr, ls.digest(ls.scan(df)).collect()))
    clashing = df.withColumns({c: F.lit(7.0) for c in ("words", "exact", "n_words", "places", "licenses", "at", "word", "start", "label")})
    found = ls.scan(clashing)
    assert sorted(map(repr, ls.digest(found).collect())) == want
    assert found.where("words <> 7 or exact <> 7 or at <> 7 or label <> 7").count() == 0 and len(found.columns) == 10
