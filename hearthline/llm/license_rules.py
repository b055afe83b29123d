"""Signature rules of licenses: hand-written regular expressions over words.

A rule sees words in lower case with one space between them. Its pattern holds one word marked by
``@``: the keyword that gates it. Patterns have no loops without bounds and reach at most REACH
words to either side of the keyword.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

REACH = 40
MARK = "\x01"  # stands before the keyword in what a pattern is matched with

SPDX, TEXT, GRANT, NAME = range(4)  # priorities, the first is the strongest
SCORES = {SPDX: 1.0, TEXT: 0.95, GRANT: 0.9, NAME: 0.7}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


#: Families with versions, the name's pattern, and the versions that labels tell apart.
VERSIONED = [
    ("apache", "@apache(?: software)?(?: foundation)? licen[cs]e", ["2.0", "1.1", "1.0"]),
    ("gpl", "general @public licen[cs]e", ["3.0", "2.0", "1.0"]),
    ("gpl", "@gpl", ["3.0", "2.0", "1.0"]),
    ("lgpl", "(?:lesser|library) general @public licen[cs]e", ["3.0", "2.1", "2.0"]),
    ("lgpl", "@lgpl", ["3.0", "2.1", "2.0"]),
    ("agpl", "@affero general public licen[cs]e", ["3.0", "1.0"]),
    ("agpl", "@agpl", ["3.0", "1.0"]),
    ("mpl", "@mozilla public licen[cs]e", ["2.0", "1.1", "1.0"]),
    ("mpl", "@mpl", ["2.0", "1.1", "1.0"]),
    ("epl", "@eclipse public licen[cs]e", ["2.0", "1.0"]),
    ("cddl", "common development and @distribution licen[cs]e", ["1.1", "1.0"]),
    ("cddl", "@cddl", ["1.1", "1.0"]),
    ("artistic", "@artistic licen[cs]e", ["2.0", "1.0"]),
    ("afl", "@academic free licen[cs]e", ["3.0", "2.1", "2.0", "1.2", "1.1"]),
    ("osl", "open @software licen[cs]e", ["3.0", "2.1", "2.0", "1.1", "1.0"]),
    ("eupl", "european union @public licen[cs]e", ["1.2", "1.1", "1.0"]),
    ("eupl", "@eupl", ["1.2", "1.1", "1.0"]),
    ("ofl", "open @font licen[cs]e", ["1.1", "1.0"]),
    ("lppl", "latex project @public licen[cs]e", ["1.3", "1.2", "1.0"]),
    ("bsl", "@boost software licen[cs]e", ["1.0"]),
    ("upl", "universal @permissive licen[cs]e", ["1.0"]),
    ("cecill", "@cecill", ["2.1", "2.0", "1.1", "1.0"]),
    ("mulanpsl", "@mulan (?:permissive software licen[cs]e|psl)", ["2.0", "1.0"]),
    ("gfdl", "free @documentation licen[cs]e", ["1.3", "1.2", "1.1"]),
    ("busl", "@business source licen[cs]e", ["1.1"]),
    ("sspl", "server side @public licen[cs]e", ["1.0"]),
    ("elastic", "@elastic licen[cs]e", ["2.0"]),
    ("php", "@php licen[cs]e", ["3.01", "3.0"]),
    ("zpl", "@zope public licen[cs]e", ["2.1", "2.0"]),
    ("odbl", "open @database licen[cs]e", ["1.0"]),
    ("cpl", "common @public licen[cs]e", ["1.0"]),
    ("polyform", "@polyform (?:noncommercial|small business|shield|strict)(?: licen[cs]e)?", ["1.0"]),
]

#: Names without versions.
NAMES = [
    ("mit", "mit @license"), ("mit", "mit @licence"), ("mit", "@expat licen[cs]e"), ("mit-0", "mit no @attribution"),
    ("bsd-2-clause", "@bsd 2 clause"), ("bsd-2-clause", "2 clause @bsd"), ("bsd-2-clause", "(?:simplified|freebsd) @bsd licen[cs]e"),
    ("bsd-3-clause", "@bsd 3 clause"), ("bsd-3-clause", "3 clause @bsd"), ("bsd-3-clause", "(?:new|revised|modified) @bsd licen[cs]e"),
    ("bsd-4-clause", "@bsd 4 clause"), ("bsd-4-clause", "(?:original|old|4 clause) @bsd"), ("0bsd", "(?:zero|0) clause @bsd"), ("bsd", "@bsd(?: style)? licen[cs]e"),
    ("gpl-3.0", "@gplv3"), ("gpl-2.0", "@gplv2"), ("lgpl-3.0", "@lgplv3"), ("lgpl-2.1", "@lgplv2"), ("agpl-3.0", "@agplv3"),
    ("isc", "@isc licen[cs]e"), ("zlib", "@zlib licen[cs]e"), ("zlib", "zlib @libpng licen[cs]e"), ("libpng", "@libpng licen[cs]e"),
    ("unlicense", "@unlicense"), ("wtfpl", "@wtfpl"), ("wtfpl", "do what the @fuck you want to public licen[cs]e"),
    ("psf", "@python software foundation licen[cs]e"), ("psf", "psf @license"), ("ruby", "@ruby licen[cs]e"), ("perl", "same terms as @perl"),
    ("ms-pl", "@microsoft public licen[cs]e"), ("ms-rl", "@microsoft reciprocal licen[cs]e"), ("ncsa", "university of @illinois ncsa open source licen[cs]e"),
    ("postgresql", "@postgresql licen[cs]e"), ("x11", "@x11 licen[cs]e"), ("openssl", "@openssl licen[cs]e"), ("curl", "@curl licen[cs]e"), ("vim", "@vim licen[cs]e"),
    ("tcl", "@tcl(?: tk)? licen[cs]e"), ("qpl", "q @public licen[cs]e"), ("ipl", "@ibm public licen[cs]e"), ("json", "@json licen[cs]e"), ("beerware", "@beerware"),
    ("beerware", "beer @ware licen[cs]e"), ("sleepycat", "@sleepycat licen[cs]e"), ("w3c", "@w3c software (?:notice and )?licen[cs]e"), ("unicode", "@unicode licen[cs]e"),
    ("hpnd", "@historical permission notice"), ("ftl", "@freetype licen[cs]e"), ("ijg", "independent @jpeg group licen[cs]e"), ("naist", "@naist licen[cs]e"),
    ("commons-clause", "commons @clause"), ("pddl", "public domain @dedication and licen[cs]e"), ("cc0-1.0", "@cc0"), ("cc0-1.0", "creative commons @zero"),
    ("public-domain", "(?:dedicated|released|placed|put) (?:to|into|in) the public @domain"), ("public-domain", "this (?:work|file|code|software) is in the public @domain"),
    ("proprietary", "all rights @reserved"), ("proprietary", "@proprietary and confidential"), ("proprietary", "confidential and @proprietary"), ("proprietary", "not for @redistribution"),
]

#: The parts of Creative Commons licenses and how their long names say them.
COMMONS = {"by": "", "by-sa": " share ?alike", "by-nc": " non ?commercial", "by-nd": " no ?deriv(?:ative|ativ)?(?:e?s)?(?: works)?", "by-nc-sa": " non ?commercial share ?alike", "by-nc-nd": " non ?commercial no ?deriv(?:ative|ativ)?(?:e?s)?(?: works)?"}
COMMONS_VERSIONS = ["4.0", "3.0", "2.5", "2.0", "1.0"]

#: Sentences of license texts.
TEXTS = [
    ("mit", "permission is @hereby granted free of charge to any person obtaining a copy of this software"),
    ("x11", "except as contained in this notice the names? of [^ ]+(?: [^ ]+){0,6} shall not be used in @advertising"),
    ("isc", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is @hereby granted"),
    ("bsd", "@redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the names? of [^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to @endorse or promote products"),
    ("bsd-4-clause", "all @advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is @basis"),
    ("gpl", "this program is free software you can @redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("gpl-3.0", "this program is free software you can @redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3"),
    ("gpl-2.0", "this program is free software you can @redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2"),
    ("lgpl", "this library is free software you can @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e"),
    ("agpl", "this program is free software you can @redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("mpl-2.0", "this source code form is subject to the terms of the @mozilla public licen[cs]e v 2 0"),
    ("zlib", "this software is provided as is without any @express or implied warranty in no event will the authors be held liable"),
    ("unlicense", "this is free and @unencumbered software released into the public domain"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization @obtaining a copy of the software and accompanying documentation"),
    ("cc0-1.0", "has @waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "this font software is @licensed under the sil open font licen[cs]e version 1 1"),
    ("openssl", "this product includes software developed by the @openssl project"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written @agreement is hereby granted"),
    ("php", "this product includes @php software freely available"),
    ("json", "the software shall be used for good not @evil"),
    ("psf", "grants licensee a @nonexclusive royalty free world wide license to reproduce"),
    ("epl", "the accompanying @materials are made available under the terms of the eclipse public licen[cs]e"),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and without fee)? is @hereby granted"),
]

GIVEN = "(?:licensed|released|distributed|available|published|provided|covered|shared) (?:to you )?under(?: the)?(?: terms of(?: the)?)?(?: gnu| creative commons| sil)? "


def numbers(version: str) -> str:
    """A version as words: 2.0 is ``2``, ``2 0`` or ``v2 0``."""
    first, _, rest = version.partition(".")
    return f"v?{first}" + (f"(?: {rest})?" if rest == "0" else f" {rest}")


def _names() -> list[tuple[str, str]]:
    """(label, pattern) of every way to name a license."""
    out = list(NAMES)
    for family, body, versions in VERSIONED:
        out.append((family, body))
        out += [(f"{family}-{v}", f"{body}(?: licen[cs]e)?(?: version| ver)? {numbers(v)}(?: only| or(?: any)? later(?: version)?)?") for v in versions]
    for parts, said in COMMONS.items():
        short, long = "@cc " + parts.replace("-", " "), f"creative @commons attribution{said}"
        for body in (short, long):
            out.append((f"cc-{parts}", body))
            out += [(f"cc-{parts}-{v}", f"{body}(?: licen[cs]e| international| unported| generic)?(?: version)? {numbers(v)}(?: international| unported| generic)?") for v in COMMONS_VERSIONS]
    return out


def _rule(label: str, priority: int, body: str) -> Rule:
    keyword = re.search("@([a-z0-9]+)", body).group(1)
    return Rule(label, priority, keyword, f" ({body.replace('@', MARK)}) ")


def rules() -> list[Rule]:
    """All rules, strongest first; of equal rules the first counts."""
    names = _names()
    tags = dict.fromkeys(label for label, _ in names)
    tagged = [_rule(label, SPDX, "spdx licen[cs]e @identifier " + re.sub("[-.]", " ", label) + "(?: only| or later)?") for label in tags]
    texts = [_rule(label, TEXT, body) for label, body in TEXTS]
    return [*tagged, *texts, *(_rule(label, GRANT, GIVEN + body) for label, body in names), *(_rule(label, NAME, body) for label, body in names)]
