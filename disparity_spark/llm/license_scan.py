"""License scans by ordered signature rules.

A text becomes its words (letters, digits and everything beyond ASCII, with A-Z in lower case) joined by single
spaces. Some hundreds of regexes run over that line, each only when its keyword starts a word of it; every alternative
of a rule holds the keyword so. Detections are taken in order of priority, then length, then place; one whose interval
lies inside an interval already taken is suppressed (containment passes on, so it doesn't matter whether that one was
itself suppressed, and a sweep by start finds all of them).
The three base phrases are rules of the first priority and are never suppressed.

Edge cases: a null or empty text has no words, labels or places; repeated rows are scanned one by one; an empty table
gives no rows; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes that separate words; the rest, upper case included before lowering, belongs to them.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
TO_WORDS = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))
#: label, keyword, words of the base phrases.
BASE = (("mit", "mit", "under the mit license"), ("apache-2", "apache", "apache license version 2"), ("cc-by-nc", "cc by", "cc by nc"))

#: label, keyword that gates its rules, and the ways its name is written, as words.
NAMES = (
    ("mit", "mit", r"mit|mit x11"),
    ("mit", "expat", r"expat"),
    ("mit-0", "mit", r"mit no attribution|mit 0"),
    ("apache-1", "apache", r"apache 1 [01]|apache (?:software )?licen[sc]e(?: version)? 1 [01]"),
    ("apache-1", "asl", r"asl 1 [01]"),
    ("apache-2", "asl", r"asl 2 0"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[sc]e)?(?: version| ?v)? ?2(?: 0)?"),
    ("bsd-0", "0bsd", r"0bsd"),
    ("bsd-0", "bsd", r"bsd zero clause|zero clause bsd"),
    ("bsd-2", "bsd", r"bsd 2(?: clause)?|2 clause bsd|two clause bsd|simplified bsd"),
    ("bsd-2", "freebsd", r"freebsd"),
    ("bsd-3", "bsd", r"bsd 3(?: clause)?|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd"),
    ("bsd-4", "bsd", r"bsd 4(?: clause)?|4 clause bsd|four clause bsd|original bsd"),
    ("bsd", "bsd", r"bsd"),
    ("gpl-1", "gpl", r"gnu gpl ?v?1|gpl(?: version| ?v)? ?1(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl(?: version| ?v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("gpl", "general", r"gnu general public licen[sc]e"),
    ("gpl-2", "general", r"gnu general public licen[sc]e(?: version| ?v)? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "general", r"gnu general public licen[sc]e(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl-2", "lgpl", r"(?:gnu )?lgpl(?: version| ?v)? ?2(?: 0)?(?: only| or later)?"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| ?v)? ?2 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[sc]e"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[sc]e(?: version| ?v)? ?2 1(?: only| or later)?"),
    ("lgpl-3", "lesser", r"gnu lesser general public licen[sc]e(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl(?: version| ?v)? ?3?(?: 0)?(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e"),
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version| ?v)? ?3(?: 0)?(?: only| or later)?"),
    ("mpl-1.1", "mpl", r"mpl(?: version| ?v)? ?1 [01]"),
    ("mpl-2", "mpl", r"mpl(?: version| ?v)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e(?: version| ?v)? ?2(?: 0)?"),
    ("epl-1", "epl", r"epl(?: version| ?v)? ?1(?: 0)?"),
    ("epl-2", "epl", r"epl(?: version| ?v)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e(?: version| ?v)? ?2(?: 0)?"),
    ("cddl", "cddl", r"cddl(?: 1 [01])?"),
    ("cpl", "common", r"common public licen[sc]e"),
    ("cpal", "cpal", r"cpal(?: 1 0)?"),
    ("eupl", "eupl", r"eupl(?: version| ?v)? ?1? ?[0-2]?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib|zlib libpng"),
    ("libpng", "libpng", r"libpng(?: 2 0)?"),
    ("boost", "boost", r"boost(?: software)?(?: licen[sc]e)?(?: version| ?v)? ?1(?: 0)?"),
    ("boost", "bsl", r"bsl 1 0"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("artistic-1", "artistic", r"artistic(?: licen[sc]e)? 1(?: 0)?"),
    ("artistic-2", "artistic", r"artistic(?: licen[sc]e)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("psf", "psf", r"psf"),
    ("psf", "python", r"python software foundation"),
    ("php", "php", r"php(?: 3(?: 0[01]?)?)?"),
    ("ruby", "ruby", r"ruby"),
    ("openssl", "openssl", r"openssl"),
    ("postgresql", "postgresql", r"postgresql"),
    ("ofl", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl", "font", r"sil open font licen[sc]e"),
    ("bsl", "business", r"business source licen[sc]e(?: 1 1)?"),
    ("bsl", "busl", r"busl(?: 1 1)?"),
    ("sspl", "sspl", r"sspl(?: ?v?1(?: 0)?)?"),
    ("elastic-2", "elastic", r"elastic(?: licen[sc]e)?(?: 2 0)?"),
    ("afl", "academic", r"academic free licen[sc]e(?: v3 0| 3 0)?"),
    ("afl", "afl", r"afl [1-3] [0-2]|afl ?v[1-3] [0-2]"),
    ("osl", "osl", r"osl(?: 3 0)?"),
    ("mulan", "mulan", r"mulan ?psl(?: ?v?2(?: 0)?)?"),
    ("upl", "upl", r"upl(?: 1 0)?"),
    ("upl", "universal", r"universal permissive licen[sc]e"),
    ("odbl", "odbl", r"odbl(?: 1 0)?"),
    ("odbl", "database", r"open database licen[sc]e"),
    ("gfdl", "gfdl", r"gfdl(?: 1 [123])?"),
    ("gfdl", "documentation", r"gnu free documentation licen[sc]e"),
    ("ms-pl", "ms pl", r"ms pl"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "ms rl", r"ms rl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("ecl-2", "ecl", r"ecl 2 0"),
    ("ncsa", "ncsa", r"ncsa"),
    ("cecill", "cecill", r"cecill(?: [bc])?(?: [12] [01])?"),
    ("hpnd", "hpnd", r"hpnd"),
    ("blueoak", "blueoak", r"blueoak 1 0 0"),
    ("openrail", "openrail", r"openrail(?: ?m)?"),
    ("cc0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by", "cc by", r"cc by(?: [1-4] 0)?"),
)
#: Full-name forms of the Creative Commons family: label and the words after "creative commons attribution".
COMMONS = (("cc-by-nc-nd", r" non ?commercial no ?deriv(?:s|atives)"), ("cc-by-nc-sa", r" non ?commercial share ?alike"), ("cc-by-nc", r" non ?commercial"), ("cc-by-nd", r" no ?deriv(?:s|atives)"), ("cc-by-sa", r" share ?alike"), ("cc-by", ""))
#: Stretches of license texts: label, keyword, words.
TEXTS = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "distribute", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", r"neither the names? of .{1,80}? may be used to endorse or promote products"),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public licen[sc]e"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("boost", "boost", r"distributed under the boost software licen[sc]e"),
    ("wtfpl", "fuck", r"do what the fuck you want to public licen[sc]e"),
    ("mit", "substantial", r"this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("zlib", "misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("boost", "accompanying", r"to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("gpl-2", "foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 2"),
    ("gpl-3", "foundation", r"gnu general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("lgpl-2.1", "foundation", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 2 1"),
    ("lgpl-3", "foundation", r"gnu lesser general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("agpl-3", "foundation", r"gnu affero general public licen[sc]e as published by the free software foundation (?:either )?version 3"),
    ("cc0", "waived", r"has waived all copyright and related or neighbou?ring rights"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project"),
    ("php", "php", r"this product includes php software"),
    ("commons-clause", "commons", r"commons clause licen[sc]e condition"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|in ?to|to) the public domain"),
    ("public-domain", "domain", r"in the public domain"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) .{0,40}?(?:is )?(?:strictly )?prohibited"),
    ("proprietary", "prior", r"without (?:the )?prior (?:written )?(?:consent|permission)"),
    ("proprietary", "express", r"without (?:the )?express (?:written )?(?:consent|permission)"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("noncommercial", "commercial", r"(?:for )?non commercial (?:use|purposes) only"),
    ("noncommercial", "personal", r"(?:for )?personal (?:use|purposes) only"),
    ("noncommercial", "noncommercial", r"(?:for )?noncommercial (?:use|purposes) only"),
    ("research-only", "research", r"for research (?:use|purposes) only"),
)
#: How a name is cited: priority, confidence, words before and after it.
FORMS = (
    (2, 0.95, r"spdx licen[sc]e identifier (?:", r")"),
    (3, 0.9, r"(?:licen[sc]ed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:", r")(?: licen[sc]e)?"),
    (4, 0.8, r"under (?:the )?(?:terms of )?(?:the )?(?:", r") licen[sc]e"),
    (5, 0.7, r"(?:", r") licen[sc]ed?"),
    (6, 0.6, r"licen[sc]e (?:is |type )?(?:the )?(?:", r")"),
)


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    gate: bytes
    words: str
    confidence: float
    base: bool = False

    @property
    def pattern(self) -> re.Pattern:
        return re.compile(rb"(?<![^ ])(?:" + self.words.encode() + rb")(?![^ ])")


def rules() -> list[Rule]:
    out = [Rule(0, label, gate.encode(), words, 1.0, True) for label, gate, words in BASE]
    out += [Rule(1, label, gate.encode(), words, 0.95) for label, gate, words in TEXTS]
    for label, gate, words in NAMES:
        out += [Rule(p, label, gate.encode(), before + words + after, c) for p, c, before, after in FORMS]
        if len(words) > 8 and "|" not in words and " " in words:
            out.append(Rule(7, label, gate.encode(), words, 0.5))
    for label, words in COMMONS:
        out.append(Rule(2, label, b"creative", rf"creative commons attribution{words}(?: [1-4] 0)?(?: international| unported)?(?: licen[sc]e)?", 0.9))
    out.append(Rule(2, "cc0", b"creative", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", 0.9))
    return out


def words_of(text: str) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").lower().translate(TO_WORDS).split())


def detect(line: bytes, compiled) -> list[tuple[int, int, Rule]]:
    """Kept detections (start, end, rule), in bytes of the line of words."""
    found, gates, led = [], {}, b" " + line
    for rule, pattern in compiled:
        here = gates.get(rule.gate)
        if here is None:
            here = gates[rule.gate] = b" " + rule.gate in led  # keywords start a word
        if here:
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(line)]
    return unsuppressed(found)


def unsuppressed(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that no detection of a higher priority, or a longer or equal one before it of the same, contains."""
    kept: list[tuple[int, int, Rule]] = []
    above: list[tuple[int, int]] = []  # starts of higher priorities, each with the furthest end up to it
    for priority in sorted({rule.priority for _, _, rule in found}):
        own = sorted((x for x in found if x[2].priority == priority), key=lambda x: (x[0], -x[1], x[2].label, x[2].words))
        reach = -1
        for a, b, rule in own:
            i = bisect_right(above, (a, math.inf))
            if rule.base or b > reach and (not i or b > above[i - 1][1]):
                kept.append((a, b, rule))
            reach = max(reach, b)
        merged, reach = [], -1
        for a, b in sorted(above + [(a, b) for a, b, _ in own]):
            reach = max(reach, b)
            merged.append((a, reach))
        above = merged
    return kept


def summarized(line: bytes, kept) -> tuple:
    base = sorted(a for a, _, rule in kept if rule.base)
    at = [line.count(b" ", 0, a) for a in (base[:1] + base[-1:])] or [None, None]
    miss = 1.0
    for confidence in sorted(rule.confidence for rule in {rule for _, _, rule in kept}):
        miss *= 1 - confidence
    labels = [",".join(sorted({rule.label for _, _, rule in kept if rule.base or not only})) for only in (True, False)]
    return line.count(b" ") + 1 if line else 0, len(base), at[0], at[1], *labels, 1 - miss


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (noisy-or of the rules' confidences)."""

    def batches(it):
        import pyarrow as pa

        compiled = [(rule, rule.pattern) for rule in rules()]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in common.sliced(it):
            lines = [words_of(t or "") for t in batch.column(1).to_pylist()]
            rows = [summarized(line, detect(line, compiled)) for line in lines]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir):
    return scan(common.table(spark, sf_dir, "documents"))
