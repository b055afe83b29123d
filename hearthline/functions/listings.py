"""Parsers of listing texts, as column expressions: prices, areas, floors, building, facing, tags.

A text is what a listings page shows of one home, line by line; its first line names the complex. It is
cut into tokens once: numbers, runs of letters of one script, line ends, and single signs. A
number means what the tokens beside it say: its unit follows it, perhaps after a type letter, and a
word before it may name it. Nothing else of the layout matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hearthline.sources.tables import PYEONG

TOKEN = r"\d[\d,]*(?:\.\d+)?|[A-Za-z]+|[가-힣]+|\n|\S"
#: Words of listings, and what they say.
OWN = "전용"
EOK, MAN = "억", "만"
FLOOR, BUILDING = "층", "동"
BANDS = {"저": "저층", "중": "중층", "고": "고층", "탑": "최상층"}
DIRECTIONS = ["북동", "북서", "남동", "남서", "동", "서", "남", "북"]
FACINGS = ["남", "동", "서", "북"]  # from the best to the worst
LEAST_M2, LEAST_MAN, MAN_OF_EOK = 10, 1000, 10_000


#: Patterns of laid out tokens, each with the blank after it: a number below 1,000, one of 10 and more, one below 10; a
#: type letter; units; a price for each pyeong after its number. A number of a price has 18 digits at most.
ANY, BIG, SMALL = r"0*\d{1,3}(?:\.\d+)? ", rf"0*[1-9]\d{{{len(str(LEAST_M2)) - 1},2}}(?:\.\d+)? ", r"0*\d(?:\.\d+)? "
LETTER, M2, FLAT = "(?:[A-Za-ln-z] )?+", "(?:㎡ |[mM] [2²] )", "평(?![대당])[^ ]* "
STATED = rf"{MAN}[^ ]* / (?:3\.3 |평)"
IN_M2, IN_PYEONG = f"{BIG}{LETTER}{M2}", f"{ANY}{LETTER}{FLAT}"
KNOWN = rf"\b(?=\d)(?<= )(?:{IN_M2}|{IN_PYEONG})"  # what begins a token is seen first, as that costs least
PAIR = f" (?={BIG}|{IN_PYEONG}|{ANY}{LETTER}{M2}?+/ {IN_PYEONG})({ANY}){LETTER}((?:{FLAT}|{M2})?+)/ (?:({BIG}){LETTER}{M2}|({ANY}){LETTER}{FLAT})"
BLANK = " \t\r\f\v"


def laid(text: Column) -> Column:
    """The text as its tokens, a blank before and after each, as a token holds none. What readers look at is a pattern of
    whole tokens, found from the left. A reader searches once and takes what it found apart."""
    return F.concat(F.lit(" "), F.regexp_replace(F.ltrim(text, F.lit(BLANK)), rf"({TOKEN})[ \t\x0B\f\r]*+", "$1 "))


def _found(t: Column, pattern: str, group: int = 0) -> Column:
    """What is found first, or an empty text."""
    return F.regexp_extract(t, pattern, group)


def _part(found: Column, k: int) -> Column:
    """The token at k (from 1) of what was found."""
    return F.get(F.split(found, " "), F.lit(k))


def _number(x: Column, kind: str = "double") -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast(kind)


def _metres(value: Column, pyeong: Column) -> Column:
    return F.when(pyeong, F.round(value * PYEONG, 2)).otherwise(value)


def _price_found(t: Column) -> Column:
    return _found(t, rf" \d{{1,2}} {EOK}[^ ]* (?:\d[\d,]{{2,}} (?!{LETTER}(?:{M2}|{FLAT}))(?!/ \d))?+")


def _price(t: Column, found: Column) -> Column:
    more = _number(_part(found, 3), "long")
    least = r"(?=[\d,]*[1-9]" + r",*\d" * (len(str(LEAST_MAN)) - 1) + ")"
    small = _found(t, rf"(?:^|(?<= )(?!{EOK})[^ ]+) {least}(?=\d+,)(\d(?:,*\d){{0,17}},*) (?!{STATED})", 1)
    return F.when(found != "", _part(found, 1).try_cast("long") * MAN_OF_EOK + F.when(more < MAN_OF_EOK, more).otherwise(0)).otherwise(_number(small, "long"))


def price(text: Column) -> Column:
    """In units of ten thousand: eok and what follows on the line, or a number with a comma."""
    return _price(laid(text), _price_found(laid(text)))


def _bare(t: Column) -> Column:
    """Without the number that a price is for, which is no area."""
    return F.when(t.contains(" / 3.3 "), F.regexp_replace(t, rf" ({MAN}[^ ]* / )3\.3 ", " $1. ")).otherwise(t)


def _named(t: Column) -> Column:
    return _found(t, f" {OWN} (?:{BIG}|{ANY}(?={LETTER}{FLAT}))(?:{LETTER}{FLAT}|{LETTER}{M2})?+")


def _known(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(KNOWN), 0)


def _own(t: Column, named: Column) -> Column:
    """The number called exclusive has its own unit, or that of the last area before it; one below 10 is in pyeong."""
    before = F.when(named != "", F.concat(F.call_function("substring_index", t, named, F.lit(1)), F.lit(" "))).otherwise(t)
    last = before.contains("평") & (_found(before, f"(?s)^.* (?:{BIG}{LETTER}{M2}|{ANY}{LETTER}({FLAT}))", 1) != "")
    own = _metres(_part(named, 2).try_cast("double"), F.when(_part(named, 4).isNotNull(), named.contains("평")).otherwise(last))
    late = f"(?<= ){IN_PYEONG}(?:(?!{IN_M2}|{IN_PYEONG})[^ ]+ )*?{OWN} ({SMALL})"
    return F.coalesce(F.when(t.contains("평") & t.rlike(f" {OWN} {SMALL}"), _metres(F.trim(_found(before, late, 1)).try_cast("double"), F.lit(True))), own)


def _areas(t: Column, own: Column, known: Column) -> Column:
    part = lambda k: F.when(own.isNull() & t.contains(" / "), F.trim(_found(t, PAIR, k)))
    left, in_m2, in_pyeong = (part(k).try_cast("double") for k in (1, 3, 4))
    a = _metres(left, F.when(part(2).startswith("평"), True).when((part(2) != "") & (left >= LEAST_M2), False).otherwise(in_pyeong.isNotNull()))
    b = F.coalesce(in_m2, _metres(in_pyeong, F.lit(True)))
    size = lambda x: _metres(F.substring_index(x, " ", 1).try_cast("double"), x.contains("평"))
    one = size(F.get(known, F.lit(0)))
    larger = F.when(F.size(known) == 1, F.when(one > own, one)).otherwise(F.array_min(F.filter(F.transform(known, size), lambda x: x > own)))
    supply = F.when(own.isNotNull(), larger).when(left.isNotNull(), F.greatest(a, b))
    exclusive = F.coalesce(own, F.when(left.isNotNull(), F.least(a, b)), one)
    return F.struct(exclusive.alias("exclusive"), supply.alias("supply"), (own.isNotNull() | left.isNotNull()).alias("explicit"))


def areas(text: Column) -> Column:
    """struct<exclusive, supply, explicit>: a number called exclusive, or the smaller of a pair, or
    a number alone, which may be either. A number without a unit has that of its pair, or of the area before it."""
    t = _bare(laid(text))
    return _areas(t, _own(t, _named(t)), _known(t))


def _floor_found(t: Column) -> Column:
    return _found(t, rf" (?:(?:\d{{1,2}}|[{''.join(BANDS)}]) / \d{{1,2}}|(?<! / )\d{{1,2}}) {FLOOR}")


def _floors(t: Column, found: Column) -> Column:
    word = lambda x: F.coalesce(*(F.when(x == k, v) for k, v in BANDS.items()))
    first = _part(found, 1)
    band = F.when(found != "", word(first)).otherwise(word(_found(t, rf" ([{''.join(BANDS)}]){FLOOR}", 1)))
    return F.struct(first.try_cast("long").alias("floor"), F.when(_part(found, 2) == "/", _part(found, 3)).try_cast("long").alias("top"), band.alias("band"))


def floors(text: Column) -> Column:
    """struct<floor, top, band>: of a pair the first is the floor, or the word for its height; a word alone where no number is."""
    return _floors(laid(text), _floor_found(laid(text)))


def with_readings(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The kept columns with laid (the text's tokens, which the other readers take), price, area and floor: what
    price(), areas() and floors() give, but what several of them need is sought once."""
    c = F.col
    out = rows.select(*keep, laid(text).alias("laid")).withColumn("bare", _bare(c("laid")))
    out = out.withColumns({"named": _named(c("bare")), "known": _known(c("bare")), "at_price": _price_found(c("laid")), "at_floor": _floor_found(c("laid"))}).withColumn("own", _own(c("bare"), c("named")))
    return out.select(*keep, "laid", _price(c("laid"), c("at_price")).alias("price"), _areas(c("bare"), c("own"), c("known")).alias("area"), _floors(c("laid"), c("at_floor")).alias("floor"))


# A reader below takes a text, or one that is laid already.


def building(text: Column, is_laid: bool = False) -> Column:
    """The building's number or letter, on the first line only."""
    line = F.substring_index(text if is_laid else laid(text), "\n", 1)
    return F.nullif(_found(line, rf" (\d{{1,4}}(?= {BUILDING} )|[A-Za-z](?= {BUILDING} )|[가-하](?={BUILDING} ))", 1), F.lit(""))


def stated_price(text: Column, is_laid: bool = False) -> Column:
    """The price a pyeong that the text states."""
    return _number(_found(text if is_laid else laid(text), rf" (\d(?:,*\d){{0,17}},*) {STATED}", 1), "long")


def facing(text: Column, is_laid: bool = False) -> Column:
    """Right after the floor; elsewhere it is the agent's word."""
    two, one = ("|".join(d for d in DIRECTIONS if len(d) == k) for k in (2, 1))
    return F.nullif(_found(text if is_laid else laid(text), f" {FLOOR}(?: (?=(?:{two}|{one})향 )|(?=(?:{two})향|(?:{one})향 ))((?:{two}|{one})향)", 1), F.lit(""))


def facing_group(x: Column) -> Column:
    """Of two directions the worse."""
    return F.coalesce(*(F.when(x.contains(f), f) for f in reversed(FACINGS)))


def name_key(name: Column) -> Column:
    """A complex's name without blanks, punctuation, and what sources write differently."""
    s = F.regexp_replace(F.lower(name), r"[()\[\]{}·,.\-_/'\"\s]", "")
    return F.regexp_replace(F.regexp_replace(s, r"제(\d+)(단지|차)", "$1$2"), "아파트$", "")


def tags(memo: Column, rules: list[tuple[str, str]]) -> Column:
    """The names of the rules whose pattern is in the memo, in the order of the rules."""
    hits = F.array(*(F.when(memo.rlike(p), F.lit(name)) for name, p in rules))
    return F.filter(hits, lambda x: x.isNotNull())


def all_tags(memos: Column, rules: list[tuple[str, str]]) -> Column:
    """Tags of several memos, each once, in the order of the rules."""
    found = F.flatten(F.transform(memos, lambda m: tags(m, rules)))
    return F.filter(F.array(*(F.lit(name) for name, _ in rules)), lambda x: F.array_contains(found, x))
