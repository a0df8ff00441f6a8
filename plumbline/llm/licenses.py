"""License scans by ordered signature rules.

A text is read as words (runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case), so that line
ends, comment marks and punctuation do not count. Each rule is a regular expression over words with single spaces between
them, with a label, a priority, and one word (its gate) that all of its matches hold. A rule is run only where its gate
stands, ``REACH`` words to either side. Of what the rules find, a detection goes that lies within another of a better
priority, or of the same priority and longer (or of an earlier rule): "general public license" inside "licensed under
the GNU Lesser General Public License, version 3" is no detection of its own.

Rules come from two tables: ``FAMILIES`` of licenses (title, short name, versions), which ``rules()`` writes out as tags,
addresses, notices, titles and short names, and ``TEXTS``, sentences of the licenses themselves. ``PHRASES`` are the base
phrases: they are found at every place and are never suppressed.

The score is the chance that the text states a license, were the labels' weights independent.

A text is read in pieces of ``PIECE`` characters with ``REACH`` words carried over, so that a long text takes no more
memory than its words in one piece and its detections; no match is longer than that. Nulls: a null text is empty: no
words, no labels, score 0. Repeated rows and ids are scanned one by one. Ties: of two rules with one span and priority
the first in order stays. Matches of one rule do not overlap (within one window of its gate, from the left).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, steps, table

#: Fixed values of the contract: words (of lower-cased text), the base phrases and their labels.
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))

#: Words that a rule may reach to either side of its gate, and characters of a text that are read at a time.
REACH, PIECE = 64, 1 << 20

#: License families as label, gate, title, short name and versions ("" where there are none). Titles and
#: short names are patterns over lower-case words; "-" means that there is none.
FAMILIES = (
    ("0bsd", "bsd", "zero clause bsd(?: licen[cs]e)?", "bsd zero clause", ""),
    ("afl", "academic", "academic free licen[cs]e", "-", "1.1 1.2 2.0 2.1 3.0"),
    ("agpl", "affero", "(?:gnu )?affero general public licen[cs]e", "-", "1.0 3.0"),
    ("agpl", "agpl", "-", "(?:gnu )?agpl", "1.0 3.0"),
    ("apache", "apache", "apache(?: software(?: foundation)?)? licen[cs]e", "apache", "1.0 1.1 2.0"),
    ("apsl", "apple", "apple public source licen[cs]e", "-", "1.0 1.1 1.2 2.0"),
    ("artistic", "artistic", "(?:perl )?artistic licen[cs]e", "artistic", "1.0 2.0"),
    ("bsd", "bsd", "bsd(?: style)? licen[cs]e", "-", ""),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?", "-", ""),
    ("bsd-3-clause", "bsd", "(?:modified bsd|revised bsd|new bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", "-", ""),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?", "-", ""),
    ("bsl", "boost", "boost software licen[cs]e", "boost", "1.0"),
    ("busl", "business", "business source licen[cs]e", "-", "1.1"),
    ("cc-by", "attribution", "(?:creative commons )?attribution(?: licen[cs]e)?", "-", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "attribution", "(?:creative commons )?attribution non ?commercial(?: licen[cs]e)?", "-", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "attribution", "(?:creative commons )?attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?", "-", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "attribution", "(?:creative commons )?attribution non ?commercial share ?alike(?: licen[cs]e)?", "-", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "attribution", "(?:creative commons )?attribution no ?deriv(?:ative)?s(?: works)?(?: licen[cs]e)?", "-", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "attribution", "(?:creative commons )?attribution share ?alike(?: licen[cs]e)?", "-", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by", "cc", "-", "cc by", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc", "cc", "-", "cc by nc", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nc-nd", "cc", "-", "cc by nc nd", "2.0 2.5 3.0 4.0"),
    ("cc-by-nc-sa", "cc", "-", "cc by nc sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-nd", "cc", "-", "cc by nd", "1.0 2.0 2.5 3.0 4.0"),
    ("cc-by-sa", "cc", "-", "cc by sa", "1.0 2.0 2.5 3.0 4.0"),
    ("cc0", "cc0", "cc0 1 0 universal", "cc0", "1.0"),
    ("cddl", "cddl", "-", "cddl", "1.0 1.1"),
    ("cddl", "distribution", "common development and distribution licen[cs]e", "-", "1.0 1.1"),
    ("cdla-permissive", "community", "community data licen[cs]e agreement permissive", "-", "1.0 2.0"),
    ("cdla-sharing", "community", "community data licen[cs]e agreement sharing", "-", "1.0"),
    ("cecill", "cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill", "1.0 1.1 2.0 2.1"),
    ("cpal", "cpal", "common public attribution licen[cs]e(?: cpal)", "cpal", "1.0"),
    ("cpl", "common", "common public licen[cs]e", "-", "1.0"),
    ("curl", "curl", "curl licen[cs]e", "-", ""),
    ("ecl", "educational", "educational community licen[cs]e", "-", "1.0 2.0"),
    ("elastic", "elastic", "elastic licen[cs]e", "-", "2.0"),
    ("epl", "eclipse", "eclipse public licen[cs]e", "-", "1.0 2.0"),
    ("epl", "epl", "-", "epl", "1.0 2.0"),
    ("eupl", "european", "european union public licen[cs]e", "-", "1.0 1.1 1.2"),
    ("eupl", "eupl", "-", "eupl", "1.0 1.1 1.2"),
    ("gfdl", "documentation", "(?:gnu )?free documentation licen[cs]e", "-", "1.1 1.2 1.3"),
    ("gpl", "general", "(?:gnu )?general public licen[cs]e", "-", "1.0 2.0 3.0"),
    ("gpl", "gpl", "-", "(?:gnu )?gpl", "1.0 2.0 3.0"),
    ("hippocratic", "hippocratic", "hippocratic licen[cs]e", "-", "1.0 2.0 2.1"),
    ("icu", "icu", "icu licen[cs]e", "-", ""),
    ("isc", "isc", "isc licen[cs]e", "isc", ""),
    ("json", "json", "json licen[cs]e", "-", ""),
    ("lgpl", "general", "(?:gnu )?(?:lesser|library) general public licen[cs]e", "-", "2.0 2.1 3.0"),
    ("lgpl", "lgpl", "-", "(?:gnu )?lgpl", "2.0 2.1 3.0"),
    ("llama", "llama", "llama [0-9]+(?: [0-9]+)? community licen[cs]e(?: agreement)?", "-", ""),
    ("lppl", "latex", "latex project public licen[cs]e", "-", "1.0 1.1 1.2 1.3"),
    ("mit", "expat", "expat licen[cs]e", "-", ""),
    ("mit", "mit", "mit(?: style)? licen[cs]e", "mit", ""),
    ("mpl", "mozilla", "mozilla public licen[cs]e", "-", "1.0 1.1 2.0"),
    ("mpl", "mpl", "-", "mpl", "1.0 1.1 2.0"),
    ("ms-pl", "microsoft", "microsoft public licen[cs]e", "-", ""),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[cs]e", "-", ""),
    ("mulanpsl", "mulan", "mulan permissive software licen[cs]e", "mulan psl", "1.0 2.0"),
    ("nasa", "nasa", "nasa open source agreement", "-", "1.3"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "-", ""),
    ("odbl", "database", "open database licen[cs]e", "-", "1.0"),
    ("odbl", "odbl", "-", "odbl", "1.0"),
    ("odc-by", "commons", "open data commons attribution licen[cs]e", "-", "1.0"),
    ("ofl", "font", "(?:sil )?open font licen[cs]e", "-", "1.0 1.1"),
    ("openrail", "openrail", "(?:creativeml |bigscience )?openrail m?(?: licen[cs]e)?", "openrail", ""),
    ("openssl", "openssl", "openssl licen[cs]e", "-", ""),
    ("osl", "open", "open software licen[cs]e", "-", "1.0 1.1 2.0 2.1 3.0"),
    ("pddl", "dedication", "public domain dedication and licen[cs]e", "-", "1.0"),
    ("php", "php", "php licen[cs]e", "-", "3.0 3.01"),
    ("polyform-noncommercial", "polyform", "polyform noncommercial licen[cs]e", "-", "1.0"),
    ("postgresql", "postgresql", "postgresql licen[cs]e", "-", ""),
    ("psf", "python", "python software foundation licen[cs]e", "-", "2.0"),
    ("qpl", "public", "q public licen[cs]e", "-", "1.0"),
    ("rpl", "reciprocal", "reciprocal public licen[cs]e", "-", "1.1 1.3 1.5"),
    ("ruby", "ruby", "ruby(?: s)? licen[cs]e", "-", ""),
    ("sleepycat", "sleepycat", "sleepycat licen[cs]e", "-", ""),
    ("sspl", "server", "server side public licen[cs]e", "-", "1.0"),
    ("unicode", "unicode", "unicode(?: data files and software)? licen[cs]e(?: agreement)?", "-", ""),
    ("unlicense", "unlicense", "(?:the )?unlicense", "unlicense", ""),
    ("upl", "universal", "universal permissive licen[cs]e", "-", "1.0"),
    ("vim", "vim", "vim licen[cs]e", "-", ""),
    ("w3c", "w3c", "w3c(?: software)?(?: notice and)? licen[cs]e", "-", ""),
    ("wtfpl", "wtfpl", "-", "wtfpl", "2.0"),
    ("x11", "x11", "x11 licen[cs]e", "x11", ""),
    ("zlib", "zlib", "zlib(?: libpng)? licen[cs]e", "zlib", ""),
    ("zpl", "zope", "zope public licen[cs]e", "-", "1.1 2.0 2.1"),
)
#: Addresses as label, gate and words.
ADDRESSES = (
    ("agpl", "gnu", "gnu org licenses agpl"),
    ("apache-2.0", "apache", "apache org licenses license 2 0"),
    ("bsl-1.0", "boost", "boost org license 1 0"),
    ("bsd-2-clause", "opensource", "opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", "opensource", "opensource org licenses? bsd 3 clause"),
    *((f"{label}-{v}", "creativecommons", f"creativecommons org licenses {words} {v.replace('.', ' ')}") for label, words in (("cc-by", "by"), ("cc-by-nc", "by nc"), ("cc-by-nc-nd", "by nc nd"), ("cc-by-nc-sa", "by nc sa"), ("cc-by-nd", "by nd"), ("cc-by-sa", "by sa")) for v in ("2.0", "2.5", "3.0", "4.0")),
    ("cc0-1.0", "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("epl-2.0", "eclipse", "eclipse org legal epl (?:v20|2 0)"),
    ("gpl", "gnu", "gnu org licenses(?: old licenses)? gpl"),
    ("lgpl", "gnu", "gnu org licenses(?: old licenses)? lgpl"),
    ("mit", "opensource", "opensource org licenses? mit"),
    ("mpl-2.0", "mozilla", "mozilla org (?:en us )?mpl 2 0"),
    ("odbl-1.0", "opendatacommons", "opendatacommons org licenses odbl"),
    ("ofl-1.1", "scripts", "scripts sil org ofl"),
    ("public-domain", "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("unlicense", "unlicense", "unlicense org"),
)
#: Sentences of the licenses, as label, gate and words.
TEXTS = (
    ("apache-2.0", "grants", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[cs]e"),
    ("artistic", "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,16}may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsl-1.0", "obtaining", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e"),
    ("cc0-1.0", "affirmer", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("gpl", "copyleft", "the gnu general public licen[cs]e is a free copyleft licen[cs]e for software and other kinds of works"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("gpl-2.0", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version"),
    ("gpl-3.0", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version"),
    ("isc", "purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("mit", "obtaining", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "restriction", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("public-domain", "domain", "(?:(?:is|are) in|released into|dedicated to|placed in) the public domain"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl-2.0", "fuck", "do what the fuck you want to public licen[cs]e"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: What speaks of rights without naming a license, as label, gate and words.
GENERIC = (
    ("copyright", "copyright", "copyright(?: c| ©)?(?: ©?[0-9]{4}){1,4}"),
    ("license-notice", "under", "(?:licen[cs]ed|released|distributed|published) under(?: the| an?)?(?: terms of)?(?: the)?(?: [^ ]+){0,6}? licen[cs]e"),
    ("license-notice", "file", "see(?: the)?(?: accompanying)? licen[cs]e file"),
    ("non-commercial", "commercial", "(?:for )?non commercial use only"),
    ("proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "redistribution", "redistribution(?: or reproduction)? is (?:strictly )?prohibited"),
    ("reserved", "reserved", "(?:all|some) rights reserved"),
)
_VERB = "(?:(?:dual )?licen[cs]ed|released|distributed|published|available|provided|covered|shared|governed)(?: to you)? (?:under|by|by the terms of)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: gnu| creative commons)? "
_LATER = "(?: or (?:any )?later(?: version)?| only)?"
#: Weights of the priorities, from the best: tag, address, sentence, notice, title and short name with version, title, generic.
TAG, ADDRESS, SENTENCE, NOTICE, TITLE, SHORT, NAME, VAGUE = range(8)
WEIGHTS = (0.99, 0.95, 0.97, 0.95, 0.85, 0.75, 0.6, 0.3)
BASE_WEIGHTS = {"cc-by": 0.75, "gpl": 0.8, "reserved": 0.3}


@dataclass(frozen=True)
class Rule:
    """The span of a match is its group ``at`` where the pattern has one."""

    label: str
    gate: str
    pattern: re.Pattern
    priority: int

    def spans(self, line: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """Where each match begins, and its span."""
        group = "at" if "at" in self.pattern.groupindex else 0
        return ((m.start(), *m.span(group)) for m in self.pattern.finditer(line, lo, hi))


def _version(v: str) -> str:
    """A version in words: "2.0" is "2", "2 0", "v2", "version 2 0" and so on, but not the beginning of "2 1"."""
    major, _, minor = v.partition(".")
    return f"(?:version |v )?v?{major}" + (f"(?: {minor})?" if minor == "0" else f" {minor}") + "(?! [0-9](?![^ ]))"


def _rule(label: str, gate: str, words: str, priority: int) -> Rule:
    return Rule(label, gate, re.compile(f"(?<![^ ])(?:{words})(?![^ ])"), priority)


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order of their priority and then of the tables."""
    out = [_rule(label, gate, words, ADDRESS) for label, gate, words in ADDRESSES]
    out += [_rule(label, gate, words, SENTENCE) for label, gate, words in TEXTS]
    out += [_rule(label, gate, words, VAGUE) for label, gate, words in GENERIC]
    tags = set()
    for label, gate, title, short, versions in FAMILIES:
        names = [n for n in (title, short) if n != "-"]
        for v in versions.split() or [""]:
            full = f"{label}-{v}" if v else label
            if full not in tags:
                tags.add(full)
                out.append(_rule(full, "spdx", f"spdx licen[cs]e identifier (?:(?:[^ ]+ ){{1,6}}?(?:and|or|with) ){{0,3}}?(?P<at>{re.sub('[-.]', ' ', full)}{_LATER})", TAG))
            for name in names:
                place = f"{name} {_version(v)}(?: (?:international|unported|universal|generic))?(?: (?:public )?licen[cs]e)?{_LATER}" if v else name
                out.append(_rule(full, gate, _VERB + place, NOTICE))
                if v:
                    out.append(_rule(full, gate, place, TITLE if name == title else SHORT))
                    joined = f"{name}v?{v.replace('.0', '')}" if name == short and "." in v and v.endswith(".0") else ""
                    if joined:  # gplv3, and the like: a word of its own
                        word = f"{label}v{v.partition('.')[0]}"
                        out.append(_rule(full, word, word + _LATER, SHORT))
        for name in names:
            if versions:
                out.append(_rule(label, gate, _VERB + name, NOTICE + 1))
            if name == title or name == "cc0" or name.startswith("cc by"):
                out.append(_rule(label, gate, name, NAME))
    return tuple(sorted(out, key=lambda r: r.priority))


@lru_cache(1)
def _by_gate() -> dict[str, list[tuple[int, Rule]]]:
    out: dict[str, list[tuple[int, Rule]]] = {}
    for k, rule in enumerate(rules()):
        out.setdefault(rule.gate, []).append((k, rule))
    return out


_PHRASES = tuple((label, words.split()[0], re.compile(f"(?<![^ ]){words}(?![^ ])")) for label, words in PHRASES)
_FIRSTS = frozenset(first for _, first, _ in _PHRASES)


def pieces(text: str) -> Iterator[list[str]]:
    """The words of lower-cased text, some at a time."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):  # on to the end of the word
            gap = re.compile("[^0-9a-z\x80-\U0010ffff]").search(text, hi)
            hi = gap.start() if gap else len(text)
        yield WORD.findall(text, lo, hi)
        lo = hi


def _found(words: list[str], gates: set[str], upto: int) -> Iterator[tuple[int, int, int, str, bool]]:
    """(start, end, number of the rule or -1, label, whether base) of the matches that begin before the word ``upto``;
    places are counted in words.
    """
    line = " ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    before, at = starts[upto], lambda a, b: (bisect_right(starts, a) - 1, bisect_right(starts, b - 1))
    for label, first, pattern in _PHRASES:
        if first in gates:
            for m in pattern.finditer(line):
                if m.start() < before:
                    yield (*at(*m.span()), -1, label, True)
    places: dict[str, list[int]] = {}
    known = _by_gate()
    for k, w in enumerate(words):
        if w in known:
            places.setdefault(w, []).append(k)
    for gate, where in places.items():
        windows: list[list[int]] = []
        for k in where:
            if windows and k - REACH <= windows[-1][1]:
                windows[-1][1] = k + REACH
            else:
                windows.append([max(0, k - REACH), k + REACH])
        for lo, hi in windows:
            a, b = starts[lo], starts[min(hi, len(words))] - 1
            for number, rule in known[gate]:
                for begin, start, end in rule.spans(line, a, b):
                    if begin < before:
                        yield (*at(start, end), number, rule.label, False)


def kept(found: list[tuple[int, int, int, str, bool]]) -> list[tuple[int, int, int, str, bool]]:
    """What no other detection of as good a priority contains, by one pass in order of the starts."""
    reached = [-1] * len(WEIGHTS)
    out = []
    order = rules()
    for d in sorted(set(found), key=lambda d: (d[0], -d[1], d[2])):
        p = order[d[2]].priority
        if max(reached[: p + 1]) < d[1]:
            out.append(d)
            reached[p] = d[1]
    return out


def scan(text: str) -> tuple[int, list[tuple[int, int, int, str, bool]]]:
    """The number of words, and the detections (see ``_found``) that stay, base ones first by start, then the method's."""
    known, n, carried = _by_gate(), 0, []
    base, further = [], []

    def take(words: list[str], upto: int) -> None:
        gates = {w for w in words if w in known or w in _FIRSTS}
        for d in _found(words, gates, upto) if gates else ():
            (base if d[4] else further).append((d[0] + n, d[1] + n, *d[2:]))

    for words in pieces(text):
        held = carried + words
        upto = max(0, len(held) - REACH)  # what begins later is left to the next piece
        take(held, upto)
        n, carried = n + upto, held[upto:]
    take(carried, len(carried))
    return n + len(carried), sorted(set(base)) + kept(further)


def score(labels: dict[str, float]) -> float:
    """The chance that one label at least is right."""
    wrong = 1.0
    for w in labels.values():
        wrong *= 1.0 - w
    return 1.0 - wrong


_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.int32()), ("base", pa.bool_())])
_SPANS = "array<struct<label:string,start:bigint,end:bigint,rule:int,base:boolean>>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, spans (label, start and end in words, number of the rule or -1, whether base),
    score.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        weight = [WEIGHTS[r.priority] for r in rules()]
        for batch in batches:
            for part, data, at in steps(batch, "text"):
                low = data.tobytes().lower()  # of bytes: A-Z alone
                counts, spans, scores = [], [], []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    n, found = scan(low[lo:hi].decode())
                    best: dict[str, float] = {}
                    for _, _, rule, label, base in found:
                        best[label] = max(best.get(label, 0.0), BASE_WEIGHTS[label] if base else weight[rule])
                    counts.append(n)
                    spans.append([{"label": label, "start": a, "end": b, "rule": rule, "base": base} for a, b, rule, label, base in found])
                    scores.append(score(dict(sorted(best.items()))))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(scores, pa.float64())], names=["id", "n_words", "spans", "score"])
            release()

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, n_words long, spans {_SPANS}, score double").withColumnRenamed("id", id_col)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), "score",
    )
