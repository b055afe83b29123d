"""The ten operators against SQL, brute force, round trips and held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hearthline.llm import decontaminate, html_extract, langid, ngram_join, packing, pii, queries, secret_scan, substring_dedup, topk_search, toxicity

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_are_those_of_the_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_language_is_right_on_held_out_documents(spark, docs):
    got = queries.op1_language_id(spark, DATA).toPandas().merge(docs, on="doc_id")
    assert len(got) == len(docs)
    held = got.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)
    assert (held == got.held_out).all() and got.score.between(0, 1).all()
    known = got[held & got.lang.notna() & (got.lang_pred != "und")]
    assert (known.lang_pred == known.lang).mean() >= 0.95


def test_forward_sums_all_segmentations():
    names = ["▁", "x", "▁x", "xx"]
    model = langid.Model(["a"], langid.Pieces(names), np.array([[0.5], [0.25], [0.125], [0.1]]))
    # ▁ x x, ▁x x, ▁ xx
    want = 0.5 * 0.25 * 0.25 + 0.125 * 0.25 + 0.5 * 0.1
    assert np.exp(langid.log_probabilities(["xx"], model)[0, 0]) == pytest.approx(want)
    assert np.exp(langid.long_word("xx", model)[0]) == pytest.approx(want)


def test_forward_is_that_of_all_segmentations_one_by_one():
    rng = np.random.default_rng(4)
    names = sorted({"▁", "a", "b", "ab", "ba", "▁a", "aab", "bb", "▁ab"})
    prob = rng.dirichlet(np.ones(len(names)), 2).T
    model = langid.Model(["x", "y"], langid.Pieces(names), prob)

    def brute(s):  # an unknown letter is a step of its own where no piece ends
        ahead = [np.ones(2)]
        for j in range(1, len(s) + 1):
            parts = [ahead[i] * prob[names.index(s[i:j])] for i in range(j) if s[i:j] in names]
            ahead.append(sum(parts) if parts else ahead[-1] * langid.UNKNOWN)
        return np.log(ahead[-1])

    words = ["a", "abba", "aabab", "xaby", "ba", "é", "ab" * 20, "q" * 10]
    got = langid.log_probabilities(words, model)
    for word, row in zip(words, got, strict=True):
        assert row == pytest.approx(brute("▁" + word)) and langid.long_word(word, model) == pytest.approx(row)
    long = "abx" * 1000
    assert np.isfinite(langid.long_word(long, model)).all()


def test_long_texts_ties_and_clashing_columns_of_language_id(spark):
    rows = [(k, f"{w} {w}", lang) for k, (w, lang) in enumerate([("haus", "de"), ("house", "en")] * 20)]
    rows += [(100, "haus " * 100_000, None), (101, "house\n" * 100_000, None), (102, "z" * 300_000, None), (103, "haus house", None), (103, "haus house", None), (104, None, None), (105, "12 -", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS word", "1 AS k", "7.0 AS score")
    got = langid.identify(docs, langid.train(docs)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "word", "k", "lang_pred", "score"}
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (by[100], by[101], by[104], by[105]) == ("de", "en", "und", "und") and by[102] in ("de", "en")


def test_top_k_ties_and_bad_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [0.5, None]), (6, [-1.0, 0.0]), (50, [2.0, 0.0])]
    v = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, score string")
    got = topk_search.top_k(v, v.vec_id % 50 == 0).where("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(50, 512 * 256), (1, 65536), (2, 65536), (6, -65536)]


def _brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = set()
    kept = [(i, words(t), bag(words(t))) for i, t in items if words(t)]
    at = defaultdict(set)
    for i, w, _ in kept:
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].add((i, k))
    by = {i: (w, b) for i, w, b in kept}
    for d, t in docs:
        w = words(t)
        tried = {(i, p - k) for p in range(len(w) - 4) for i, k in at.get(tuple(w[p : p + 5]), ())}
        for i, start in tried:
            n = len(by[i][0])
            if 0 <= start and start + n <= len(w):
                b = bag(w[start : start + n])
                common = sum((b & by[i][1]).values())
                if common / (sum(b.values()) + sum(by[i][1].values()) - common) >= 0.8:
                    out.add((d, i))
    return out


def test_decontamination_finds_what_brute_force_finds(spark, docs):
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in queries.op3_decontaminate(spark, DATA).collect()}
    assert got == _brute_leaks(docs[["doc_id", "text"]].values.tolist(), items[["item_id", "text"]].values.tolist()) and got


def test_edited_item_is_found_and_half_an_item_is_not(spark):
    item = [f"w{k}" for k in range(60)]
    edited = item[:30] + ["other"] + item[31:]
    rows = [(1, "a b c " + " ".join(edited) + " d"), (2, " ".join(item[:30])), (3, None), (4, ""), (None, " ".join(item))]
    d = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], DOC)
    b = spark.createDataFrame([(7, " ".join(item)), (8, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 7), (None, 7)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, b).collect()) == [2, 3, 4]


def _slide(docs, items, threshold=0.8):
    """(doc, item): (similarity, first start, words) over every start."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    bag = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    out = {}
    for i, b in ((i, words(t)) for i, t in items):
        for d, w in ((d, words(t)) for d, t in docs):
            if not b or not set(bag(b)) & set(bag(w)) and len(b) >= 5:
                continue
            for start in range(max(len(w) - len(b), 0) + 1):
                part = w[start : start + len(b)]
                common = sum((bag(part) & bag(b)).values())
                alike = common / (sum(bag(part).values()) + sum(bag(b).values()) - common)
                if part and alike >= threshold and alike > out.get((d, i), (0,))[0]:
                    out[d, i] = (alike, start, len(part))
    return out


def test_items_cut_at_an_edge_are_found_from_every_start(spark):
    item = [f"w{k}" for k in range(40)]
    long = [f"v{k}" for k in range(100)]
    short = ["one", "two", "three"]
    pad = [f"p{k}" for k in range(50)]
    texts = [pad + item[:39], item[1:] + pad, item[:39], item[1:], item[:38], pad + item[1:39] + pad, item[2:39] + ["x"], pad + long[1:50] + ["x", "y"] + long[50:99] + pad, pad + short, short[:2], item * 3]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(3, "nothing"), (None, " ".join(pad + item[:39]))]
    items = [(1, " ".join(item)), (2, " ".join(long)), (3, " ".join(short))]
    d = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], DOC)
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start_word"], r["n_words"]) for r in decontaminate.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = _slide(rows, items)
    assert got == want and {(0, 1), (1, 1), (2, 1), (3, 1), (7, 2), (None, 1)} <= set(want)


def test_decontamination_finds_what_sliding_over_every_start_finds(spark, docs):
    items = pd.read_parquet(f"{DATA}/benchmark.parquet")[["item_id", "text"]].values.tolist()
    got = {(r["doc_id"], r["item_id"]): (pytest.approx(r["similarity"]), r["start_word"], r["n_words"]) for r in queries.op3_decontaminate(spark, DATA).collect()}
    assert got == _slide(docs[["doc_id", "text"]].values.tolist(), items) and got


def test_simhash_counts_all_words(spark):
    frame = spark.createDataFrame([(1, 40_000, 60_000), (2, 10, 20), (3, 32_767, 1)], "k int, a int, b int")
    got = frame.selectExpr("k", "concat(array_repeat('x', a), array_repeat('y', b)) AS w", "xxhash64('x') AS x", "xxhash64('y') AS y").select("k", decontaminate.simhash(F.col("w")).alias("fp"), "x", "y")
    assert {r["k"]: r["fp"] in ([r["y"]], [r["x"]])[r["k"] == 3] for r in got.collect()} == {1: True, 2: True, 3: True}


def test_simhash_blocks_lose_none_within_the_radius(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(-(1 << 63), 1 << 63, 40)
    b = [int(x) ^ sum(1 << int(k) for k in rng.choice(63, 20, replace=False)) for x in a]
    f = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "k long, a long, b long")
    x, y = f.select("k", decontaminate.blocks(f.a, 20).alias("l"), decontaminate.blocks(f.b, 20).alias("r")).selectExpr("k", "size(array_intersect(l, r)) AS n").toPandas().values.T
    assert (y > 0).all()


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(s):
    x = [int(c) for c in reversed(s)]
    return (sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])) % 10 == 0


def _base_pii(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def _check_pii(rows, texts):
    for r in rows:
        want = _base_pii(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x.startswith(k) for x in want) for k in KINDS], r
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_personal_data_of_the_base_rules(spark, docs):
    texts = dict(docs[["doc_id", "text"]].values.tolist())
    rows = queries.op8_pii(spark, DATA).collect()
    assert len(rows) == len(docs)
    _check_pii(rows, texts)


def test_personal_data_in_odd_texts(spark):
    odd = [None, "", "a@b.c@d.e.f x@y z@-.- .@a.b", "a@b..c a.b.@c.d.", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.2.3.004", "4111 1111-1111 1111 4111111111111111 4111  1111", "+1 (555) 010-9999. +12 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
           "é😀 a@b.co 😀1.1.1.1", "99999999999.1.1.1", "a\x01b@c.d\x01e.f", "a" * 3000 + "@" + "b." * 500 + "c"]
    rows = spark.createDataFrame([(k, t, "s") for k, t in enumerate(odd)], "doc_id long, text string, spans string")
    _check_pii(pii.digest(pii.find_pii(rows)).collect(), dict(enumerate(odd)))


def test_ledger_scans_only_unseen_blobs(spark):
    old = spark.createDataFrame([(1, "token = abcdefghijkl1"), (2, "nothing")], "doc_id long, text string")
    _, ledger = secret_scan.update_ledger(old)
    new = spark.createDataFrame([(1, "token = abcdefghijkl1"), (3, "AKIA" + "A" * 16), (4, None)], "doc_id long, text string")
    paths, both = secret_scan.update_ledger(new, ledger)
    assert paths.count() == 3 and both.count() == 4
    found = {r["doc_id"]: [x["kind"] for x in r["findings"]] for r in secret_scan.find_secrets(new, ledger).collect()}
    assert found == {1: ["assign"], 3: ["access"], 4: []}


def test_redaction(spark):
    d = spark.createDataFrame([(1, "x password: abcdefghijklmno y", 3), (2, None, 0), (3, "clean", 5)], "doc_id long, text string, _x int")
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(d).collect()} == {1: "x [SECRET] y", 2: None, 3: "clean"}


def test_redaction_of_whole_keys_and_of_rows_without_doc_id(spark):
    body = "\n".join("QUJD-"[:4] * 16 for _ in range(3000))
    key = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY-----"
    rows = [(None, "x password: abcdefghijklmno y"), (None, "clean"), (1, f"a {key} b - c {key} d"), (2, f"a -----BEGIN PRIVATE KEY-----\n{body}\nplain words"), (3, "-----BEGIN PRIVATE KEY-----"), (None, None)]
    got = [(r["doc_id"], r["text"]) for r in secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, "x [SECRET] y"), (None, "clean"), (1, "a [SECRET] b - c [SECRET] d"), (2, "a [SECRET]\nplain words"), (3, "[SECRET]"), (None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_is_an_exact_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    got = queries.op7_packing(spark, DATA).toPandas()
    for doc, part in got.groupby("doc_id"):
        text = docs.loc[docs.doc_id == doc, "text"].iloc[0]
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert (part.doc_tokens == len(ids)).all()
        at = 0
        for r in part.sort_values("start").itertuples():
            assert r.start == at and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, sequence in got.groupby("sequence_id"):
        at = 0
        for r in sequence.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert set(got.doc_id) == set(docs.doc_id)


def test_patterns_place_every_piece():
    counts = {4096: 3, 3000: 5, 1096: 2, 500: 9, 1: 7}
    placed = Counter()
    for lengths, n in packing.patterns(counts, 4096):
        assert sum(lengths) <= 4096
        for x in lengths:
            placed[x] += n
    assert placed == counts


def test_toxic_documents_are_flagged_and_clean_ones_are_not(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id", suffixes=("_p", ""))
    flagged = got[got.toxic_p]
    assert (flagged.toxic == 1).mean() >= 0.95 and (got[got.toxic == 1].toxic_p).mean() >= 0.5


def test_chain_is_no_worse_than_its_last_link_alone():
    table = "/root/testdata/sf0.1"
    labels = pd.read_parquet(f"{table}/labels.parquet").groupby("doc_id").agg({"toxic": "max"})
    docs = pd.read_parquet(f"{table}/documents.parquet", columns=["doc_id", "text"]).set_index("doc_id").join(labels, how="inner").iloc[:3000]
    toxic = docs.toxic.to_numpy()
    args = [None if pd.isna(t) else t for t in docs.text], toxic, np.arange(len(docs)) % 3

    def f1(chain):
        flag = chain.scores >= chain.threshold
        return 2 * (flag & (toxic == 1)).sum() / (flag.sum() + toxic.sum())

    both, alone = f1(toxicity.train_chain(*args)), f1(toxicity.train_chain(*args, chained=False))
    print("F1 of the chain and of its last link alone:", both, alone)
    assert both > alone and both > 0.9


def test_threshold_is_set_at_the_prevalence_of_all_labelled_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(3000):  # the mark is in most toxic rows and in some clean ones
        toxic = k % 20 == 0
        mark = rng.random() < (0.9 if toxic else 0.1)
        rows.append((k, " ".join(["mark"] * mark + [f"w{x}" for x in rng.integers(0, 50, 8)]), int(toxic)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, x) for k, _, x in rows], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, rows_per_class=150)  # half of the sample is toxic, a twentieth of the table
    seen = []
    whole = toxicity.best_threshold
    monkeypatch.setattr(toxicity, "best_threshold", lambda p, a, b: seen.append((int(a.sum()), int(b.sum()))) or whole(p, a, b))
    assert toxicity.train(docs, labels, rows_per_class=150).threshold == chain.threshold
    assert seen[-1] == (150, 2850) and seen[0][1] < 400
    monkeypatch.setattr(toxicity, "BROADCAST_ROWS", 0)
    assert toxicity.train(docs, labels, rows_per_class=150).threshold == chain.threshold


def _brute_components(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return {d: (len(sets[d]), comp[d]) for d in sets}


def test_join_of_chains_copies_and_short_texts(spark):
    rng = np.random.default_rng(5)
    rows, text = [], [f"w{k}" for k in range(120)]
    for k in range(60):  # a chain: each differs from the one before in one word
        text = list(text)
        text[int(rng.integers(120))] = f"x{k}"
        rows.append((100 + k, " ".join(text)))
    rows += [(1, "A b"), (2, "a B"), (3, ""), (4, None), (5, "a b c"), (6, rows[10][1].upper()), (7, " ".join(f"z{k}" for k in range(30)))]
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, n int, comp int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.linked(d).collect()}
    assert got == _brute_components(rows)
    kept = {r["doc_id"] for r in ngram_join.keep_one(d).collect()}
    assert kept == {k for k, (_, c) in got.items() if k == c}


def test_histograms_bound_overlaps():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, int(rng.integers(1, 120))))
        b = np.unique(np.concatenate([a[: int(rng.integers(1, len(a) + 1))], rng.integers(0, 400, 3)]))
        alike = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert not alike or ngram_join.possible(ngram_join.histogram(a), ngram_join.histogram(b), 80)


def test_substrings_of_repeated_rows_and_nulls(spark):
    run = " ".join(f"w{k}" for k in range(20))
    rows = [(1, run), (2, "a " + run + " b"), (2, "a " + run + " b"), (3, None), (4, ""), (None, run)]
    d = spark.createDataFrame([(a, b, "p") for a, b in rows], "doc_id long, text string, places string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.dedup_substrings(d.drop("places")).collect())
    assert got == [(0, 20, 0, run), (1, 20, 0, run), (2, 22, 20, "a b"), (2, 22, 20, "a b"), (3, 0, 0, ""), (4, 0, 0, "")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOC)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert langid.identify(docs, langid.train(docs)).count() == 0
    assert topk_search.top_k(vectors, vectors.vec_id % 50 == 0).count() == 0
    assert decontaminate.contaminated(docs, bench).count() == 0
    assert substring_dedup.dedup_substrings(docs).count() == 0
    assert secret_scan.find_secrets(docs).count() == 0
    assert html_extract.extract(pages).count() == 0
    assert packing.pack(docs).count() == 0
    assert pii.find_pii(docs).count() == 0
    assert toxicity.classify(docs, toxicity.train(docs, labels)).count() == 0
    assert ngram_join.linked(docs).count() == 0


def test_null_rows_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "12 34", None, None, 5)], DOC)
    got = langid.identify(docs, langid.train(docs)).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 3
    labels = spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int")
    assert {r["toxic"] for r in toxicity.classify(docs, toxicity.train(docs, labels)).collect()} == {False}
    assert packing.pack(docs).count() == 3
    assert pii.find_pii(docs).count() == 3
    assert ngram_join.linked(docs).count() == 3
