"""Hashes of words, and joins and dedup of words made to collide in polynomial hashes."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import hashing, ngram_join, substring_dedup


def _thue_morse(length):
    word = "a"
    while len(word) < length:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_and_their_hashes():
    texts = ["Ab  c\tabcdefgh\n", "", "ab \x0bC é", "abcdefghi", " ", "abcdefgh"]
    w = hashing.words(pa.array(texts).cast(pa.large_string()), fold=True)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in texts]
    assert w.counts().tolist() == [len(x) for x in want]
    flat = [x for y in want for x in y]
    for family in (0, 1):
        found = dict(zip(flat, w.hashed(family).tolist(), strict=True))
        assert [found[x] for x in flat] == w.hashed(family).tolist() and len(set(found.values())) == len(set(flat))
    assert not set(w.hashed(0).tolist()) & set(w.hashed(1).tolist())


@pytest.mark.parametrize("length", [64, 1024, 2048, 4096])
def test_thue_morse_words_differ(length):
    w = hashing.words(pa.array(_thue_morse(length)).cast(pa.large_string()))
    for family in (0, 1):
        assert len(set(w.hashed(family).tolist())) == 2


@pytest.mark.parametrize("length", [1024, 4096])
def test_thue_morse_words_are_other_words_to_dedup_and_join(spark, length):
    t, u = _thue_morse(length)
    tail = " ".join(f"w{k}" for k in range(12))
    rows = [(1, f"{t} {tail}"), (2, f"{u} {tail}"), (3, t), (4, u), (5, f"{t} {tail}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring_dedup.dedup_substrings(docs).collect()}
    kept = {d: hashlib.sha256(x.encode()).hexdigest() for d, x in [*rows[:4], (5, "")]}
    assert got == {d: (13 if d == 5 else 0, kept[d]) for d in kept}
    nine = " ".join(f"w{k}" for k in range(9))  # 5 of 7 shingles in common
    rows = [(1, f"{t} {nine}"), (2, f"{u} {nine}"), (3, t), (4, u), (5, f"{t} {nine}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.linked(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_runs_of_words_are_told_by_order():
    h = np.array([1, 2, 3, 3, 2, 1], np.uint64)
    assert len(set(hashing.runs(h, 3).tolist())) == 4
