"""License scans by ordered signature rules, in DataFrame expressions only.

A text becomes its words (ASCII letters lower-cased; digits, letters and everything beyond ASCII make words), joined by
single spaces. Rules are patterns of two sorts: sentences of licenses, headers and notices (TEXTS), and identifiers,
references and names of license families and versions in the forms that they are written in. A rule is tried only where
one of its keywords stands in the text. A detection is an interval of words. One that lies within a longer one is
suppressed, and of equal intervals the one of the highest priority (then the first rule) stays; one pass over detections
in order of their starts finds them.

The base phrases are found by position besides and always count. Null and empty texts have no words, no labels, score 0.
Repeated rows are scanned one by one. Columns of the input that have an output's name give way to it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioq.llm.common import let, table, without

#: Fixed values of the contract: what the base looks for.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The rarest word of each base phrase: a text without any has none of them.
BASE_KEYS = ("mit", "apache", "cc")
#: Between words: every ASCII character that is no digit or letter.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Marks of a match's first and last word, which no word can hold, and the size of a fold's block.
FROM, TO, BLOCK = "\x01", "\x02", 64
FOUND = "struct<n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,detections:array<struct<start:int,stop:int,label:string,priority:int,id:int,score:double>>>"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")

#: label: (keywords of which one must stand in the text, pattern of the names). Versions of a family are made below.
FAMILIES: dict[str, tuple[str, str]] = {
    "mit": ("mit expat", r"(?:mit|expat|mit x11|x11 mit)"),
    "x11": ("x11", r"x11"),
    "isc": ("isc", r"isc"),
    "zlib": ("zlib", r"(?:zlib|zlib libpng)"),
    "bsl-1.0": ("boost", r"boost(?: software)?"),
    "wtfpl": ("wtfpl", r"wtfpl"),
    "unlicense": ("unlicense", r"(?:the )?unlicense"),
    "bsd-0-clause": ("bsd 0bsd", r"(?:0bsd|bsd 0 clause|zero clause bsd)"),
    "bsd-2-clause": ("bsd freebsd", r"(?:bsd 2 clause|(?:2|two) clause bsd|simplified bsd|freebsd)"),
    "bsd-3-clause": ("bsd", r"(?:bsd 3 clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)"),
    "bsd-4-clause": ("bsd", r"(?:bsd 4 clause|(?:4|four) clause bsd|original bsd)"),
    "bsd": ("bsd", r"bsd"),
    "artistic": ("artistic", r"artistic"),
    "artistic-2": ("artistic", r"artistic(?: license)?(?: version)? 2(?: 0)?"),
    "python-2": ("psf python", r"(?:python 2 0|psf 2 0|psf)"),
    "php-3": ("php", r"php(?: 3 01| 3 0)?"),
    "ruby": ("ruby", r"ruby"),
    "openssl": ("openssl", r"openssl"),
    "postgresql": ("postgresql", r"postgresql"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?"),
    "ms-pl": ("microsoft", r"microsoft public"),
    "ms-rl": ("microsoft", r"microsoft reciprocal"),
    "upl-1": ("upl permissive", r"(?:universal permissive|upl)(?: 1 0)?"),
    "ofl-1.1": ("ofl font", r"(?:sil )?(?:open font|ofl)(?: 1 1)?"),
    "odbl": ("odbl database", r"(?:open database|odbl)(?: 1 0)?"),
    "cc0": ("cc0", r"cc0(?: 1 0)?(?: universal)?"),
    "apache-1": ("apache", r"apache(?: software)? 1(?: [01])?"),
    "apache": ("apache", r"apache"),
}
#: Families with versions: label stem, keyword, names, versions; the fullest spelling comes first.
VERSIONED: list[tuple[str, str, str, tuple[str, ...]]] = [
    ("apache", "apache", r"apache(?: software)?", ("2", "2.0")),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3")),
    ("gpl", "general", r"gnu general public", ("1", "2", "3")),
    ("lgpl", "general", r"gnu (?:lesser|library) general public", ("2", "2.1", "3")),
    ("agpl", "general", r"(?:gnu )?affero general public", ("1", "3")),
    ("fdl", "documentation", r"(?:gnu )?free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla", r"mozilla public", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", r"mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse", r"eclipse public", ("1.0", "2.0")),
    ("epl", "epl", r"epl", ("1.0", "2.0")),
    ("eupl", "eupl", r"eupl", ("1.0", "1.1", "1.2")),
    ("cddl", "cddl", r"cddl", ("1.0", "1.1")),
    ("cpl", "common", r"common public", ("1.0",)),
    ("osl", "osl", r"osl", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "afl", r"afl", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("lppl", "lppl", r"lppl", ("1.0", "1.2", "1.3")),
]
CC_KINDS = {"by": "by", "by-sa": "by sa", "by-nd": "by nd", "by-nc": "by nc", "by-nc-sa": "by nc sa", "by-nc-nd": "by nc nd"}
CC_WORDS = {"by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:atives|s)", "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike", "by-nc-nd": "attribution non ?commercial no ?deriv(?:atives|s)"}
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

#: Sentences of licenses, of their headers and notices: label, keywords of which one stands in every match, pattern, priority, score.
TEXTS: list[tuple[str, str, str, int, float]] = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 4, 0.9),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies of the software", 4, 0.9),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", 4, 0.85),
    ("mit", "opensource", r"opensource org licenses mit", 5, 1.0),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind express or implied", 2, 0.6),
    ("x11", "advertising", r"except as contained in this notice the names? of (?:\w+ ){1,8}shall not be used in advertising", 4, 0.9),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 4, 0.9),
    ("isc", "permission", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", 4, 0.85),
    ("hpnd", "permission", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee", 4, 0.9),
    ("postgresql", "agreement", r"for any purpose without fee and without a written agreement is hereby granted", 4, 0.9),
    ("upl-1", "condition", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy", 4, 0.9),
    ("bsl-1.0", "accompanying", r"any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 4, 0.95),
    ("bsl-1.0", "boost", r"www boost org license 1 0", 5, 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 4, 0.8),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 3, 0.75),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 3, 0.7),
    ("bsd-3-clause", "endorse", r"neither the names? of (?:\w+ ){1,10}may be used to endorse or promote products derived from this software", 4, 0.95),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 4, 0.95),
    ("bsd-2-clause", "freebsd", r"views and conclusions contained in the software and documentation are those of the authors (?:\w+ ){1,8}freebsd project", 4, 0.85),
    ("ncsa", "disclaimers", r"must retain the above copyright notice this list of conditions and the following disclaimers", 4, 0.85),
    ("sleepycat", "accompanied", r"redistributions in any form must be accompanied by information on how to obtain complete source code", 4, 0.95),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 4, 0.9),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 4, 0.9),
    ("zlib", "altered", r"this notice may not be removed or altered from any source distribution", 3, 0.85),
    ("libpng", "png", r"the png reference library is supplied as is", 4, 0.9),
    ("ijg", "jpeg", r"based in part on the work of the independent jpeg group", 4, 0.9),
    ("ftl", "freetype", r"portions of this software are copyright (?:\w+ ){0,4}the freetype project", 4, 0.9),
    ("wtfpl", "fuck", r"do what the fuck you want to public license", 4, 0.95),
    ("unlicense", "unencumbered", r"free and unencumbered software released into the public domain", 4, 0.9),
    ("unlicense", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software", 4, 0.9),
    ("unlicense", "unlicense", r"unlicense org", 4, 0.8),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff", 4, 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 4, 0.95),
    ("vim", "charityware", r"vim is charityware", 4, 0.95),
    ("apache-2", "apache", r"www apache org licenses license 2 0", 5, 1.0),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license", 4, 0.9),
    ("apache-2", "basis", r"software distributed under the license is distributed on an as is basis", 4, 0.85),
    ("apache-2", "asf", r"licensed to the apache software foundation asf under one or more contributor license agreements", 4, 0.95),
    ("apache-2", "irrevocable", r"worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", 4, 0.9),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation", 4, 0.8),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl(?: \d 0)?)?", 4, 0.8),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 4, 0.85),
    ("gpl-1", "foundation", r"gnu general public license as published by the free software foundation (?:either )?version 1", 4, 0.95),
    ("gpl-2", "foundation", r"gnu general public license as published by the free software foundation (?:either )?version 2", 4, 0.95),
    ("gpl-3", "foundation", r"gnu general public license as published by the free software foundation (?:either )?version 3", 4, 0.95),
    ("lgpl-2", "foundation", r"gnu library general public license as published by the free software foundation (?:either )?version 2", 4, 0.95),
    ("lgpl-2.1", "foundation", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1", 4, 0.95),
    ("lgpl-3", "foundation", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3", 4, 0.95),
    ("agpl-3", "foundation", r"gnu affero general public license as published by the free software foundation (?:either )?version 3", 4, 0.95),
    ("gpl", "received", r"you should have received a copy of the gnu general public license", 4, 0.8),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 4, 0.8),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license", 4, 0.8),
    ("gpl", "extent", r"there is no warranty for the program to the extent permitted by applicable law", 3, 0.75),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document", 3, 0.7),
    ("lgpl", "linked", r"a work that uses the library (?:\w+ ){0,8}compiled or linked with it", 3, 0.7),
    ("fdl", "documentation", r"copy distribute and or modify this document under the terms of the gnu free documentation license", 4, 0.9),
    ("fdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 4, 0.85),
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public license v(?:ersion)? 2 0", 4, 0.95),
    ("mpl-2.0", "mpl", r"if a copy of the mpl was not distributed with this file", 4, 0.95),
    ("mpl-1.1", "mozilla", r"contents of this file are subject to the mozilla public license version 1 1", 4, 0.95),
    ("mpl-1.0", "mozilla", r"contents of this file are subject to the mozilla public license version 1 0", 4, 0.95),
    ("npl", "netscape", r"netscape public license", 3, 0.8),
    ("epl-1.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", 4, 0.95),
    ("epl-2.0", "eclipse", r"accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2 0", 4, 0.95),
    ("cddl", "development", r"subject to the terms of the common development and distribution license", 4, 0.9),
    ("cddl", "development", r"common development and distribution license", 2, 0.7),
    ("ipl", "ibm", r"ibm public license", 3, 0.8),
    ("artistic", "intent", r"the intent of this document is to state the conditions under which a package may be copied", 4, 0.9),
    ("perl", "perl", r"under the same terms as perl itself", 4, 0.9),
    ("ruby", "verbatim", r"make and give away verbatim copies of the source form of the software without restriction", 3, 0.7),
    ("python-2", "psf", r"psf is making python available to licensee on an as is basis", 4, 0.9),
    ("php-3", "php", r"this product includes php software freely available from", 4, 0.9),
    ("openssl", "openssl", r"software developed by the openssl project for use in the openssl toolkit", 4, 0.95),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young", 4, 0.95),
    ("ms-pl", "accept", r"if you use the software you accept this license if you do not accept the license do not use the software", 4, 0.85),
    ("ofl-1.1", "collaborative", r"stimulate worldwide development of collaborative font projects", 4, 0.9),
    ("ofl-1.1", "typefaces", r"individual typefaces may be sold by itself", 3, 0.7),
    ("ofl-1.1", "scripts", r"scripts sil org ofl", 5, 1.0),
    ("lppl", "latex", r"latex project public license", 3, 0.85),
    ("odbl", "opendatacommons", r"opendatacommons org licenses odbl", 5, 1.0),
    ("odc-by", "commons", r"open data commons attribution license", 3, 0.85),
    ("pddl", "commons", r"open data commons public domain dedication and licen[cs]e", 3, 0.85),
    ("cc0", "deed", r"the person who associated a work with this deed has dedicated the work to the public domain", 4, 0.95),
    ("cc0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives", 4, 0.95),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 5, 1.0),
    ("cc", "commons", r"this work is licensed under a creative commons", 2, 0.6),
    ("cc-by", "medium", r"free to share copy and redistribute the material in any medium or format", 2, 0.6),
    ("cc-by-nc", "commercial", r"you may not use the material for commercial purposes", 3, 0.7),
    ("cc-by-nd", "remix", r"if you remix transform or build upon the material you may not distribute the modified material", 3, 0.8),
    ("cc-by-sa", "remix", r"if you remix transform or build upon the material you must distribute your contributions under the same license", 3, 0.8),
    ("blueoak-1.0.0", "oak", r"blue oak model license", 4, 0.9),
    ("blueoak-1.0.0", "infringe", r"each contributor licenses you to do everything with this software that would otherwise infringe", 4, 0.9),
    ("sspl", "server", r"server side public license", 4, 0.9),
    ("busl", "business", r"business source license", 4, 0.85),
    ("elastic", "elastic", r"elastic license(?: 2 0)?", 3, 0.8),
    ("commons-clause", "clause", r"commons clause license condition", 4, 0.9),
    ("w3c", "w3c", r"w3c software notice and license", 4, 0.9),
    ("unicode", "unicode", r"unicode (?:inc )?license agreement", 4, 0.9),
    ("zpl", "zope", r"zope public license", 4, 0.9),
    ("afl", "academic", r"academic free license", 3, 0.85),
    ("osl", "software", r"open software license", 3, 0.8),
    ("rpl", "reciprocal", r"reciprocal public license", 3, 0.8),
    ("nasa", "nasa", r"nasa open source agreement", 4, 0.9),
    ("opl", "publication", r"open publication license", 3, 0.85),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[cs]e)?", 2, 0.7),
    ("public-domain", "domain", r"(?:dedicated to|released into|in) the public domain", 3, 0.7),
    ("proprietary", "reserved", r"(?:copyright(?: \w+){0,6} )?all rights reserved", 1, 0.4),
    ("proprietary", "confidential", r"confidential and proprietary information of", 2, 0.6),
    ("proprietary", "unauthorized unauthorised", r"unauthori[sz]ed copying of this file via any medium is strictly prohibited", 2, 0.6),
    ("proprietary", "reproduced", r"no part of this (?:publication|book|work|document) may be reproduced", 2, 0.6),
]


@dataclass(frozen=True)
class Signature:
    """A rule: where one of the words of keyword stands in a text, pattern is tried; every match has one of them, and whole words."""

    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def signatures() -> list[Signature]:
    """All rules in their order: identifiers, references, notices, names, from the most to the least certain."""
    said = lambda v: v.replace(".", " ")
    names = [(f"{stem}-{v}", key, rf"{name}(?: licen[cs]e)?(?: version| v)? v?{re.escape(said(v)).replace(chr(92) + ' ', ' ')}(?: 0)?" if "." not in v else rf"{name}(?: licen[cs]e)?(?: version| v)? v?{said(v)}") for stem, key, name, versions in VERSIONED for v in reversed(versions)]
    names += [(stem, key, name) for stem, key, name, _ in VERSIONED if stem not in ("apache",)]
    names += [(f"cc-{k}-{v}", "cc", rf"cc {w} {said(v)}") for k, w in CC_KINDS.items() for v in CC_VERSIONS]
    names += [(f"cc-{k}-{v}", "commons", rf"creative commons {w}(?: \w+)? {said(v)}") for k, w in CC_WORDS.items() for v in CC_VERSIONS]
    names += [(f"cc-{k}", "cc", rf"cc {w}") for k, w in CC_KINDS.items()]
    names += [(f"cc-{k}", "commons", rf"creative commons {w}") for k, w in CC_WORDS.items()]
    names += [(label, key, name) for label, (key, name) in FAMILIES.items()]
    short = {label for label, keys, _ in names if (key := keys.split()[0]) == "cc" or key.endswith("pl") or key in ("wtfpl", "cddl", "cc0", "commons", "unlicense")}
    out = [Signature(f"cc-{k}-{v}", "creativecommons", rf"creativecommons org licenses {w} {said(v)}", 5, 1.0) for k, w in CC_KINDS.items() for v in CC_VERSIONS]
    for label, key, name in names:
        out.append(Signature(label, key, rf"spdx licen[cs]e identifier {name}(?: only| or later)?", 5, 1.0))
        out.append(Signature(label, key, rf"(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?{name}(?: public)?(?: licen[cs]e)?", 4, 0.95))
        out.append(Signature(label, key, rf"under (?:the )?(?:terms of )?(?:the )?{name}(?: licen[cs]e)?(?: version \d)?", 3, 0.85))
        out.append(Signature(label, key, rf"{name}(?: public)? licen[cs]e", 2, 0.7))
        if label in short:
            out.append(Signature(label, key, name, 1, 0.5))
    out += [Signature(*x) for x in TEXTS]
    return list(dict.fromkeys(out))


def _by_keyword(rules: list[Signature]) -> Column:
    """array<struct<keys, rules>>: keywords are looked up once for all their rules. One literal, folded when the plan is made."""
    keys: dict[str, list[dict]] = {}
    for k, r in enumerate(rules):
        keys.setdefault(r.keyword, []).append({"id": k, "label": r.label, "rx": f" ({r.pattern})(?= )", "priority": r.priority, "score": r.score})
    table_ = json.dumps([{"keys": [f" {k} " for k in key.split()], "rules": own} for key, own in keys.items()])
    return F.from_json(F.lit(table_), "array<struct<keys:array<string>,rules:array<struct<id:int,label:string,rx:string,priority:int,score:double>>>>")


def words_of(text: Column) -> Column:
    """The words of a text, in order.

    lower() maps no letter beyond ASCII to a gap and no gap to a letter, so it leaves words and their places as they are.
    """
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def base_places(words: Column) -> Column:
    """array<struct<start, label>> of the base phrases, overlaps included."""

    def at(w: Column) -> Column:
        found = []
        for phrase, label in BASE.items():
            parts = phrase.split()

            def place(x: Column, i: Column) -> Column:
                same = x == parts[0]  # noqa: B023  the lambda is built before the loop goes on
                for k, p in enumerate(parts[1:], 1):  # noqa: B023
                    same = same & (F.get(w, i + k) == p)
                return F.when(same, F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))  # noqa: B023

            found.append(F.filter(F.transform(w, place), lambda x: x.isNotNull()))
        return F.concat(*found)

    return at(words)


def _folded(parts: Column, kind: str) -> Column:
    """Of detections in the order of `_ordered`, those that none before reaches past: they lie in no other.

    A fold that grows an array copies it at each step, so it runs over blocks: the work grows far slower than the square.
    """
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        beaten = x["stop"] <= acc["far"]
        return F.struct(F.greatest(acc["far"], x["stop"]).alias("far"), F.when(beaten, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).cast(kind).alias("kept"))

    def block(acc: Column, k: Column) -> Column:
        own = F.aggregate(F.slice(parts, k * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["far"].alias("far"), none.alias("kept")), step)
        return let(own, lambda o: F.struct(o["far"].alias("far"), F.concat(acc["kept"], o["kept"]).cast(kind).alias("kept")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
    return F.when(F.size(parts) == 0, none).otherwise(F.aggregate(blocks, F.struct(F.lit(-1).alias("far"), none.alias("kept")), block, lambda acc: acc["kept"]))


def detections(norm: Column, rules: list[Signature]) -> Column:
    """array<struct<start, stop, label, priority, id, score>> left after suppression, by start; start and stop count words."""
    kind = "array<struct<start:int,stop:int,label:string,priority:int,id:int,score:double>>"

    def intervals(t: Column, r: Column) -> Column:
        """Matches are put between marks, which stick to their first and last words, so those words' places tell them."""

        def places(words: Column) -> Column:
            at = lambda hit, shift: F.filter(F.transform(words, lambda w, i: F.when(hit(w), i + shift)), lambda i: i.isNotNull())
            both = F.struct(at(lambda w: w.startswith(FROM), -1).alias("a"), at(lambda w: w.endswith(TO), 0).alias("b"))
            return let(both, lambda x: F.transform(x["a"], lambda start, k: F.struct(start.alias("start"), F.get(x["b"], k).alias("stop"), r["label"].alias("label"), r["priority"].alias("priority"), r["id"].alias("id"), r["score"].alias("score"))))

        return F.when(F.rlike(t, r["rx"]), let(F.split(F.regexp_replace(t, r["rx"], F.lit(f" {FROM}$1{TO}")), " "), places).cast(kind)).otherwise(F.array().cast(kind))

    def scan(t: Column) -> Column:
        tried = F.filter(_by_keyword(rules), lambda k: F.exists(k["keys"], lambda x: F.contains(t, x)))
        found = F.flatten(F.transform(tried, lambda k: F.flatten(F.transform(k["rules"], lambda r: intervals(t, r)))))
        # by start, then the longest, the highest priority and the first rule: whatever beats a detection stands before it
        keyed = F.transform(found, lambda x: F.struct(x["start"].alias("s"), (-x["stop"]).alias("e"), (-x["priority"]).alias("p"), x["id"].alias("i"), x.alias("x")))
        return let(F.transform(F.array_sort(keyed), lambda k: k["x"]), lambda f: _folded(f, kind))

    return scan(norm)


def licenses(df: DataFrame, text: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """df with ADDED: the words, the base phrases' places, both kinds of labels, the score and the detections themselves."""
    rules = signatures() if rules is None else rules

    keywords = F.array(*[F.lit(k) for k in sorted({k for r in rules for k in r.keyword.split()} | set(BASE_KEYS))])

    def told(x: Column) -> Column:
        starts = F.transform(x["base"], lambda b: b["start"])
        base = F.array_sort(F.array_distinct(F.transform(x["base"], lambda b: b["label"])))
        own = F.transform(x["found"], lambda d: d["label"])
        score = F.greatest(F.coalesce(F.array_max(F.transform(x["found"], lambda d: d["score"])), F.lit(0.0)), F.when(F.size(base) > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
        return F.struct(
            F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
            F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"), score.alias("score"), x["found"].alias("detections"))

    def scanned(words: Column) -> Column:
        norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        found = let(F.struct(base_places(words).alias("base"), let(norm, lambda t: detections(t, rules)).alias("found")), told)
        none = F.from_json(F.lit('{"n_base":0,"base_labels":"","labels":"","score":0.0,"detections":[]}'), FOUND)
        return F.struct(F.size(words).cast("long").alias("n_words"), F.when(F.arrays_overlap(words, keywords), found.cast(FOUND)).otherwise(none).alias("f"))

    return without(df, *ADDED).withColumn("_s", let(words_of(F.col(text)), scanned)).select("*", "_s.n_words", "_s.f.*").drop("_s")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")
