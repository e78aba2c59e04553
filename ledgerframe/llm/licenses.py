"""License scan: ordered signature rules behind a keyword gate, with overlaps resolved by priority.

A text is normalised to its words (A-Z lowered, words
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``). One Aho-Corasick pass per text
looks for the gate words; only the rules whose gate was seen run their
regex. Detections are spans of words. A span inside a span of a rule of
higher priority (or of the same priority and longer) is suppressed, so
"gnu lesser general public license" is not also reported as a bare
"general public license". Base phrases are counted beside the rules and
never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame

from .common import _LOWER, map_texts

_WORD_BYTE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in _LOWER)

#: fixed phrases and their labels
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


@dataclass(frozen=True)
class Rule:
    """``gate``: words of which every match holds one at least; ``weight``: certainty of one hit, 0 to 1."""

    label: str
    pattern: str
    gate: str
    priority: int
    weight: float


#: label, name as normalised words (a regex), gate words
FAMILIES = [
    ("gpl-2.0", r"gnu (?:general public license|gpl)(?: as published by the free software foundation)? (?:version |v ?)?2(?: 0)?", "gnu"),
    ("gpl-3.0", r"gnu (?:general public license|gpl)(?: as published by the free software foundation)? (?:version |v ?)?3(?: 0)?", "gnu"),
    ("gpl", r"gnu (?:general public license|gpl)", "gnu"),
    ("gpl-2.0", r"gpl ?v?2(?: 0)?", "gpl gplv2 gpl2"),
    ("gpl-3.0", r"gpl ?v?3(?: 0)?", "gpl gplv3 gpl3"),
    ("lgpl-2.1", r"gnu (?:lesser|library) general public license (?:version |v ?)?2(?: 1| 0)?", "gnu"),
    ("lgpl-3.0", r"gnu lesser general public license (?:version |v ?)?3(?: 0)?", "gnu"),
    ("lgpl", r"gnu (?:lesser|library) general public license", "gnu"),
    ("lgpl", r"lgpl(?: ?v?[23](?: [01])?)?", "lgpl lgplv2 lgplv3 lgpl2 lgpl3"),
    ("agpl-3.0", r"gnu affero general public license(?: (?:version |v ?)?3(?: 0)?)?", "affero"),
    ("agpl-3.0", r"agpl(?: ?v?3(?: 0)?)?", "agpl agplv3 agpl3"),
    ("gfdl", r"gnu free documentation license(?: (?:version |v ?)?1 [0-9])?", "documentation"),
    ("apache-2.0", r"apache (?:software )?license (?:version |v ?)?2(?: 0)?", "apache"),
    ("apache-1.1", r"apache (?:software )?license (?:version |v ?)?1 1", "apache"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"mit(?: x11)? license", "mit"),
    ("mit", r"expat license", "expat"),
    ("mit-0", r"mit no attribution(?: license)?", "attribution"),
    ("x11", r"x11 license", "x11"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd freebsd"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd"),
    ("bsd", r"bsd(?: style)? license", "bsd"),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)(?: license)?", "bsd 0bsd"),
    ("isc", r"isc license", "isc"),
    ("mpl-2.0", r"mozilla public license (?:version |v ?)?2(?: 0)?", "mozilla"),
    ("mpl-1.1", r"mozilla public license (?:version |v ?)?1 1", "mozilla"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("epl-2.0", r"eclipse public license (?:version |v ?)?2(?: 0)?", "eclipse"),
    ("epl-1.0", r"eclipse public license(?: (?:version |v ?)?1 0)?", "eclipse"),
    ("cddl-1.0", r"common development and distribution license(?: (?:version |v ?)?1 0)?", "distribution"),
    ("cpl-1.0", r"common public license(?: (?:version |v ?)?1 0)?", "common"),
    ("eupl-1.2", r"european union public licen[cs]e(?: (?:version |v ?)?1 [12])?", "european"),
    ("artistic-2.0", r"artistic license(?: (?:version |v ?)?2(?: 0)?)?", "artistic"),
    ("zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", r"libpng license", "libpng"),
    ("bsl-1.0", r"boost software license(?: (?:version |v ?)?1 0)?", "boost"),
    ("busl-1.1", r"business source license(?: (?:version |v ?)?1 1)?", "business"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license", "what"),
    ("wtfpl", r"wtfpl", "wtfpl"),
    ("psf-2.0", r"python software foundation license(?: (?:version |v ?)?2)?", "python"),
    ("php-3.0", r"php license(?: (?:version |v ?)?3(?: 0[01]?)?)?", "php"),
    ("ruby", r"ruby license", "ruby"),
    ("openssl", r"openssl license", "openssl"),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:version |v ?)?1 1)?", "font"),
    ("odbl-1.0", r"open (?:data commons open )?database license(?: (?:version |v ?)?1 0)?", "database"),
    ("odc-by-1.0", r"open data commons attribution license(?: (?:version |v ?)?1 0)?", "commons"),
    ("pddl-1.0", r"public domain dedication and license", "dedication"),
    ("ms-pl", r"microsoft public license", "microsoft"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft"),
    ("upl-1.0", r"universal permissive license(?: (?:version |v ?)?1 0)?", "universal"),
    ("sspl-1.0", r"server side public license(?: (?:version |v ?)?1)?", "server"),
    ("elastic-2.0", r"elastic license(?: (?:version |v ?)?2(?: 0)?)?", "elastic"),
    ("osl-3.0", r"open software license(?: (?:version |v ?)?3 0)?", "open"),
    ("afl-3.0", r"academic free license(?: (?:version |v ?)?3 0)?", "academic"),
    ("ncsa", r"(?:university of illinois )?ncsa open source license", "ncsa"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("vim", r"vim license", "vim"),
    ("json", r"json license", "json"),
    ("beerware", r"beer ?ware license", "license"),
    ("openrail", r"(?:creativeml )?open ?rail(?: m)?(?: license)?", "rail openrail"),
    ("llama", r"llama [23](?: [0-9])? community license", "llama"),
    ("ogl-uk-3.0", r"open government licen[cs]e(?: v?(?:ersion )?[123](?: 0)?)?", "government"),
]
_CC = {"by": "by", "by-sa": "by sa", "by-nd": "by nd", "by-nc": "by nc", "by-nc-sa": "by nc sa", "by-nc-nd": "by nc nd"}
_CC_LONG = {
    "by": "attribution", "by-sa": "attribution share ?alike", "by-nd": "attribution no ?deriv(?:ative)?s",
    "by-nc": "attribution non ?commercial", "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s",
}
#: phrases that name no license but are its text: label, words, gate word
TEXTS = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("mit", "the software is provided as is without warranty of any kind express or implied", "warranty"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of .{1,60}? nor the names of its contributors may be used", "contributors"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "compliance"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license", "applicable"),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("gpl", "you should have received a copy of the gnu general public license", "received"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "altered source versions must be plainly marked as such", "altered"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "organization"),
    ("public-domain", "(?:dedicated|released|placed) (?:in ?to|to|in) the public domain", "domain"),
    ("proprietary", "all rights reserved", "reserved"),
]
#: how a license is granted: words before the name, with the certainty and priority they add
GRANTS = [
    (r"spdx license identifier ", 60, 1.0),
    (r"(?:is |are )?(?:dual )?(?:re)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?", 50, 0.95),
    (r"(?:released|distributed|published|available|provided) under (?:the )?(?:terms of (?:the )?)?", 45, 0.9),
    (r"subject to (?:the )?(?:terms of (?:the )?)?", 40, 0.8),
    (r"", 20, 0.6),
]


#: ids of the SPDX list as normalised words (a regex), for names that elsewhere need the word license
SPDX_IDS = [
    ("mit", "mit"), ("mit-0", "mit 0"), ("x11", "x11"), ("isc", "isc"), ("0bsd", "0bsd"), ("zlib", "zlib"),
    ("libpng", "libpng(?: 2 0)?"), ("apache-2.0", "apache 2 0"), ("apache-1.1", "apache 1 1"), ("mpl-2.0", "mpl 2 0"),
    ("mpl-1.1", "mpl 1 1"), ("epl-2.0", "epl 2 0"), ("epl-1.0", "epl 1 0"), ("cddl-1.0", "cddl 1 0"), ("cpl-1.0", "cpl 1 0"),
    ("eupl-1.2", "eupl 1 2"), ("artistic-2.0", "artistic 2 0"), ("bsl-1.0", "bsl 1 0"), ("busl-1.1", "busl 1 1"),
    ("gfdl", "gfdl 1 [123]"), ("psf-2.0", "(?:psf|python) 2 0"), ("php-3.0", "php 3 01?"), ("ruby", "ruby"),
    ("openssl", "openssl"), ("ofl-1.1", "ofl 1 1"), ("odbl-1.0", "odbl 1 0"), ("odc-by-1.0", "odc by 1 0"), ("pddl-1.0", "pddl 1 0"),
    ("ms-pl", "ms pl"), ("ms-rl", "ms rl"), ("upl-1.0", "upl 1 0"), ("sspl-1.0", "sspl 1 0"), ("elastic-2.0", "elastic 2 0"),
    ("osl-3.0", "osl 3 0"), ("afl-3.0", "afl 3 0"), ("ncsa", "ncsa"), ("postgresql", "postgresql"), ("vim", "vim"),
    ("json", "json"), ("beerware", "beerware"), ("ogl-uk-3.0", "ogl uk 3 0"),
]
#: any id that may stand before another one in an SPDX expression
_SPDX_ANY = "(?:" + "|".join([p for _, p in SPDX_IDS] + [
    "[al]?gpl [123] [01]", "bsd [234] clause", "cc by(?: nc| sa| nd)* [1-4] [05]", "cc0 1 0", "unlicense", "wtfpl"]) + ")(?: only| or later)?"


def rules() -> list[Rule]:
    """The ordered rules: every license name under every form of grant, then full-text phrases."""
    names = list(FAMILIES)
    for code, short in _CC.items():
        names.append((f"cc-{code}", rf"cc {short}(?! (?:sa|nd|nc)\b)(?: [1-4] [05])?", "cc"))
        names.append((f"cc-{code}", rf"creative commons {short}(?! (?:sa|nd|nc)\b)(?: [1-4] [05])?", "creative"))
        names.append((f"cc-{code}", rf"creative commons {_CC_LONG[code]}(?! (?:share|non|no))(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?", "commons"))
    names.append(("cc0-1.0", r"cc0(?: (?:version |v ?)?1 0)?(?: universal)?", "cc0"))
    names.append(("cc0-1.0", r"creative commons zero(?: (?:version |v ?)?1 0)?(?: universal)?", "zero"))
    out = []
    for before, priority, weight in GRANTS:
        for i, (label, name, gate) in enumerate(names):
            finer = 1 if re.search(r"-\d", label) else 0
            out.append(Rule(label, before + name, gate, priority + finer, weight))
    for label, name in SPDX_IDS:
        finer = 1 if re.search(r"-\d", label) else 0
        out.append(Rule(label, rf"spdx license identifier (?:{_SPDX_ANY} (?:or|and) )*(?P<name>{name})", "spdx", 60 + finer, 1.0))
    for label, words, gate in TEXTS:
        out.append(Rule(label, words, gate, 30, 0.3 if label == "proprietary" else 0.85))
    return sorted(out, key=lambda r: -r.priority)


class Scanner:
    def __init__(self, ordered: list[Rule] | None = None, base: dict[str, str] = BASE):
        self.rules = rules() if ordered is None else ordered
        self.find = [re.compile(rf"(?<= )(?:{r.pattern})(?= )") for r in self.rules]
        self.base = base
        self.by_gate: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.gate.split():
                self.by_gate.setdefault(word, []).append(i)
        self.gates = ahocorasick.Automaton()
        for word in [*self.by_gate, *base]:
            self.gates.add_word(f" {word} ", word)
        self.gates.make_automaton()

    def detections(self, line: str, seen: set[str]) -> list[tuple[int, int, Rule]]:
        """Spans (character places in the normalised text) left after suppression, in text order."""
        found = []
        for i in sorted({i for g in seen if g in self.by_gate for i in self.by_gate[g]}):
            r = self.rules[i]
            name = "name" if "name" in self.find[i].groupindex else 0
            found += [(m.start(name), m.end(), i, r) for m in self.find[i].finditer(line)]
        found.sort(key=lambda x: (-x[3].priority, x[0] - x[1], x[0], x[2]))
        kept: list[tuple[int, int, Rule]] = []
        starts: list[int] = []  # the widest kept spans: none inside another, so starts and ends rise together
        ends: list[int] = []
        for a, b, _, r in found:
            at = bisect_right(starts, a) - 1
            if at >= 0 and ends[at] >= b:
                continue
            kept.append((a, b, r))
            low, high = bisect_left(starts, a), bisect_right(ends, b)
            starts[low:max(low, high)] = [a]
            ends[low:max(low, high)] = [b]
        return sorted(kept, key=lambda x: x[:2])

    def scan(self, text: bytes) -> dict:
        words = text.translate(_WORD_BYTE).split()
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None,
               "base_labels": "", "labels": "", "score": 0.0, "spans": []}
        if not words:
            return out
        line = " " + b" ".join(words).decode() + " "
        seen = {w for _, w in self.gates.iter(line)}
        if not seen:
            return out
        places, base_labels = [], set()
        for phrase, label in self.base.items():
            if phrase in seen:
                at = line.find(f" {phrase} ")
                while at >= 0:
                    places.append(at)
                    base_labels.add(label)
                    at = line.find(f" {phrase} ", at + 1)
        kept = self.detections(line, seen)
        spaces = [m.start() for m in re.finditer(" ", line)] if places or kept else []
        word_at = lambda c: bisect_left(spaces, c)
        doubt = 1.0
        for _, _, r in kept:
            doubt *= 1 - r.weight
        if places:
            out |= {"n_base": len(places), "first_word": word_at(min(places)), "last_word": word_at(max(places))}
        labels = base_labels | {r.label for _, _, r in kept}
        out |= {"base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(labels)),
                "score": max(1 - doubt, 0.5 if places else 0.0),
                "spans": [{"label": r.label, "first": word_at(a) - 1, "last": word_at(b) - 1} for a, b, r in kept]}
        return out


_SCANNER: list[Scanner] = []


def scanned(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns with the counts, labels, score and word spans of every row.

    Null or empty text, or one without words: no words, no labels, score 0.
    The whole text is one string of the task that reads it; rules see it whole.
    """

    def make():
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scan = _SCANNER[0].scan

        def work(texts):
            rows = [scan(t) for t in texts]
            return {k: [r[k] for r in rows] for k in
                    ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
        return work

    return map_texts(docs, keep, text, make,
                     "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
                     "labels string, score double, spans array<struct<label:string,first:bigint,last:bigint>>")
