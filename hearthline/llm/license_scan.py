"""License scans by ordered signature rules.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case. A text whose words
hold none of the rules' keywords is done. Elsewhere each occurrence of a keyword is matched, within
the words around it, with that keyword's rules only, and a match has to hold that occurrence. A
detection is an interval of words with a label and a priority; it is suppressed if an interval of
the same or a stronger priority contains it, and of equal ones the earlier rule stays. All of it is
DataFrame functions within a row: no shuffle, and work in proportion to the text.

Besides, every place of three fixed phrases is found, whatever the rules say.

Rows: a null text is empty, and has no words. Rows without an id or with a repeated one are rows like
others. Other columns are kept, but those named like results are replaced. An empty table gives an
empty one. Very long texts are whole; detections are folded in chunks.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.llm.license_rules import MARK, NAME, REACH, SCORES, SPDX, rules
from hearthline.llm.spans import _chunk, _chunks, bound, unused

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose every place counts, by their last word.
PHRASES = [("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])]
LEVELS = range(SPDX, NAME + 1)

PLACES = "array<struct<start:int,label:string>>"
TABLE = "map<string,array<struct<pattern:string,priority:int,order:int,label:string>>>"
DETECTIONS = "array<struct<start:int,end:int,label:string,priority:int,score:double>>"


def _rules_by_keyword() -> dict[str, list]:
    out = defaultdict(list)
    for order, rule in enumerate(rules()):
        out[rule.keyword].append((order, rule))
    return out


def _words(of: Iterable[str]) -> Column:
    return F.split(F.lit(" ".join(sorted(of))), " ")


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def _around(words: Column, at: Column, word: Column) -> Column:
    """The words around a keyword, with the mark before it."""
    left = F.array_join(F.slice(words, F.greatest(at - REACH, F.lit(0)) + 1, F.least(at, F.lit(REACH))), " ")
    return F.concat(F.lit(" "), left, F.when(at > 0, " ").otherwise(""), F.lit(MARK), word, F.lit(" "), F.array_join(F.slice(words, at + 2, F.lit(REACH)), " "), F.lit(" "))


def places(words: Column) -> Column:
    """Where the phrases stand."""

    def of(x: Column, i: Column) -> Column:
        out = F.lit(None).cast("struct<start:int,label:string>")
        for label, phrase in PHRASES:
            n = len(phrase) - 1
            here = x == phrase[-1]
            for k, word in enumerate(phrase[:-1]):
                here = here & F.get(words, i - n + k).eqNullSafe(word)
            out = F.when(here, F.struct((i - n).alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    return F.filter(F.transform(words, of), lambda p: p.isNotNull())


def detections(words: Column) -> Column:
    """What the rules find, before suppression: array<struct<start, rest, priority, order, label>>, by start and
    then the longest first; rest is minus the end."""
    known = _rules_by_keyword()
    # one foldable expression each: a plan with a node for every rule would take long to make
    table = F.from_json(F.lit(json.dumps({word: [{"pattern": r.pattern, "priority": r.priority, "order": order, "label": r.label} for order, r in own] for word, own in known.items()})), TABLE)
    each = _words(known)
    own = F.array_intersect(words, each)
    keys = bound(own, lambda k: F.filter(F.transform(words, lambda x, i: F.when(F.array_contains(k, x), F.struct(i.alias("at"), x.alias("word")))), lambda o: o.isNotNull()))

    def span(at: Column, r: Column, match: Column) -> Column:
        start = at - _spaces(F.substring_index(match, MARK, 1))
        return F.when(match != "", F.struct(start.alias("start"), (-start - _spaces(match) - 1).alias("rest"), r["priority"].alias("priority"), r["order"].alias("order"), r["label"].alias("label")))

    def tried(o: Column) -> Column:
        return bound(_around(words, o["at"], o["word"]), lambda text: F.transform(F.element_at(table, o["word"]), lambda r: bound(F.call_function("regexp_extract", text, r["pattern"], F.lit(1)), lambda m: span(o["at"], r, m))))

    return F.array_sort(F.filter(F.flatten(F.transform(keys, tried)), lambda d: d.isNotNull()))


def unsuppressed(found: Column) -> Column:
    """Detections that no interval of the same or a stronger priority contains. found: as detections gives them,
    so an interval that contains another stands before it, and the greatest end so far tells."""
    none = F.expr(f"cast(array() as {DETECTIONS})")
    zeros = F.array(*(F.lit(0) for _ in LEVELS))  # the greatest end so far, by priority or a stronger one

    def reach(ends: Column, d: Column) -> Column:
        return F.transform(ends, lambda e, level: F.when(d["priority"] <= level, F.greatest(e, -d["rest"])).otherwise(e))

    def step(acc: Column, d: Column) -> Column:
        score = F.element_at(F.create_map(*(F.lit(x) for p, s in SCORES.items() for x in (p, s))), d["priority"])
        own = F.struct(d["start"].alias("start"), (-d["rest"]).alias("end"), d["label"].alias("label"), d["priority"].alias("priority"), score.alias("score"))
        keeps = -d["rest"] > F.get(acc["ends"], d["priority"])
        return F.struct(reach(acc["ends"], d).alias("ends"), F.when(keeps, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    def over(f: Column) -> Column:
        tops = F.transform(_chunks(f), lambda c: F.aggregate(_chunk(f, c), zeros, reach))
        before = lambda own, c: F.aggregate(F.slice(own, F.lit(1), c), zeros, lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b)))
        return bound(tops, lambda own: F.flatten(F.transform(own, lambda _, c: F.aggregate(_chunk(f, c), F.struct(before(own, c).alias("ends"), none.alias("out")), step, lambda acc: acc["out"]))))

    return bound(found, lambda f: F.when(F.size(f) > 0, over(f)).otherwise(none))


def scan(docs: DataFrame) -> DataFrame:
    """docs without text, with n_words long, places array<struct<start, label>> of the phrases and
    licenses array<struct<start, end, label, priority, score>> that the rules find; places are words from 0."""
    rough, exact = unused(docs, "words"), unused(docs, "exact")
    text = F.coalesce("text", F.lit(""))
    keywords = _words({*_rules_by_keyword(), *(phrase[-1] for _, phrase in PHRASES)})
    # lower() may change other letters too, but never what separates words, and misses no keyword
    split = docs.withColumn(rough, F.split(F.lower(text), SEPARATORS, -1))
    blank = lambda k: F.when(F.element_at(rough, k) == "", 1).otherwise(0)
    n = F.when(F.size(rough) == 1, 1 - blank(1)).otherwise(F.size(rough) - blank(1) - blank(-1))
    some = split.withColumns({"n_words": n.cast("long"), exact: F.when(F.arrays_overlap(rough, keywords), F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), lambda w: w != ""))}).drop(rough)
    empty = lambda kind: F.expr(f"cast(array() as {kind})")
    return some.withColumns({
        "places": F.when(F.col(exact).isNotNull(), places(F.col(exact))).otherwise(empty(PLACES)),
        "licenses": F.when(F.col(exact).isNotNull(), unsuppressed(detections(F.col(exact)))).otherwise(empty(DETECTIONS)),
    }).drop(exact, "text")


def digest(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    base = F.transform("places", lambda p: p["label"])
    labels = F.concat(base, F.transform("licenses", lambda d: d["label"]))
    listed = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    scores = F.concat(F.transform("licenses", lambda d: d["score"]), F.transform("places", lambda _: F.lit(SCORES[NAME])))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        listed(base).alias("base_labels"), listed(labels).alias("labels"), F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )
