"""License scans: base phrases against a plain version, rules by hand and without their gates, suppression by pairs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plumbline.llm import licenses as L

from .test_operators import docs_of


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(text):
    """Words, and places of the base phrases."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))
    base = []
    for label, phrase in (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")):
        p = phrase.split()
        base += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return words, base


def labels(text):
    return sorted({d[3] for d in L.scan(low(text))[1]})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc-4.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl", "gpl-3.0"]),
        ("# Licensed under the Apache\n#   License, Version 2.0 (the \"License\")", ["apache-2.0"]),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["apache-2.0", "mit"]),
        ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0"]),
        ("under the terms of the GNU Lesser General Public License v2.1 or later", ["gpl", "lgpl-2.1"]),
        ("it is GPLv3, not gpl v2", ["gpl-2.0", "gpl-3.0"]),
        ("see http://www.apache.org/licenses/LICENSE-2.0 for more", ["apache-2.0"]),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa-4.0"]),
        ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", ["cc-by-nc-sa-4.0"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files", ["mit"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]),
        ("Copyright (c) 2019 2020 A. Person. All rights reserved.", ["copyright", "reserved"]),
        ("Mozilla Public License 2.0, or the Eclipse Public License v 1.0", ["epl-1.0", "mpl-2.0"]),
        ("the version 2 10 of the apache license", ["apache"]),
        ("the general public went to the mit in a bsd way; admit it", []),
        ("CC- BY and ccby, GENERAL\tPUBLIC...LICENSE", ["gpl"]),
        ("", []),
    ],
)
def test_labels(text, want):
    assert labels(text) == want


def test_rules_are_many_ordered_and_linear_in_reach():
    order = L.rules()
    assert len(order) > 300 and [r.priority for r in order] == sorted(r.priority for r in order)
    assert len({(r.label, r.gate, r.pattern.pattern) for r in order}) > 0.98 * len(order)
    for label, gate, words in (*L.ADDRESSES, *L.TEXTS, *L.GENERIC):
        assert gate in re.findall("[0-9a-z]+", words), label  # every match holds the gate
        assert len(words.split()) < L.REACH
    for label, gate, title, short, _ in L.FAMILIES:
        assert gate in re.findall("[0-9a-z]+", f"{title} {short}"), label


def made(r, n):
    sentences = [
        "Licensed under the Apache License, Version 2.0", "GNU General Public License version 2 or later", "all rights reserved", "CC BY 4.0", "cc by cc by",
        "the MIT license", "3-clause BSD License", "SPDX-License-Identifier: MPL-2.0 AND MIT", "published under an open licence", "Copyright 2020", "licensed under lgpl 2.1",
        "general public license", "all rights", "license", "creative commons attribution 4.0 international license", "in the public domain", "é中 words",
    ]
    return " ".join(r.choice(sentences) if r.random() < 0.3 else r.choice(("and", "a", "word,", "–", "2", "0", "the")) for _ in range(n))


def test_base_places_equal_a_plain_search_in_pieces(spark, monkeypatch):
    """Also where texts are read some words at a time."""
    r = random.Random(3)
    texts = [made(r, r.choice((0, 3, 40, 400))) for _ in range(60)] + [None, "", "cc " * 50 + "by", "CC BY " * 400, "all rights" + " " * 5000 + "reserved"]
    for piece in (1 << 20, 50, 7):
        monkeypatch.setattr(L, "PIECE", piece)
        for t in texts:
            words, base = plain(t)
            n, found = L.scan(low(t or ""))
            assert n == len(words) and sorted((d[0], d[3]) for d in found if d[4]) == sorted(base)
    monkeypatch.undo()
    got = {x.doc_id: x for x in L.scan_licenses(docs_of(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        words, base = plain(t)
        assert got[k].n_words == len(words) and sorted((s.start, s.label) for s in got[k].spans if s.base) == sorted(base)
        assert 0 <= got[k].score <= 1 and (got[k].score > 0) == bool(got[k].spans)


def test_gates_lose_nothing_and_suppression_is_containment():
    """All rules over all words, and every pair of detections, give the same as windows around gates and one pass."""
    r, order = random.Random(5), L.rules()
    for _ in range(40):
        text = low(made(r, 60))
        words = L.WORD.findall(text)
        line = " ".join(words)
        everywhere = {(line.count(" ", 0, a), line.count(" ", 0, b) + 1, k, rule.label, False) for k, rule in enumerate(order) for _, a, b in rule.spans(line, 0, len(line))}
        rank = lambda d: (order[d[2]].priority, d[0] - d[1], d[2])
        better = lambda e, d: order[e[2]].priority < order[d[2]].priority or rank(e) < rank(d)
        want = {d for d in everywhere if not any(e != d and e[0] <= d[0] and d[1] <= e[1] and better(e, d) for e in everywhere)}
        assert {d for d in L.scan(text)[1] if not d[4]} == want


@pytest.mark.parametrize("unit", ["license ", "cc by ", "all rights reserved ", "gpl v3 ", "spdx license identifier mit or ", "released under the ", "x", "the general public license version 2 1 "])
def test_a_megabyte_of_each_pattern(unit):
    text = unit * (400_000 // len(unit))
    began = time.time()
    n, found = L.scan(text)
    assert n == len(L.WORD.findall(text)) and time.time() - began < 20


def test_query_and_odd_rows(spark, small, tmp_path):
    rows = [(1, None), (1, "cc by"), (1, "cc by"), (None, "All Rights RESERVED"), (7, "word " * 300_000 + "general public license"), (8, "1 2 3 cc by 4 CC-BY")]
    docs_of(spark, rows).withColumns({c: F.lit("z") for c in ("id", "spans", "n_words", "score")}).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, L.op11_license_scan(spark, str(tmp_path)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    assert got == sorted([(1, 0, 0, None, None, ""), (1, 2, 1, 0, 0, "cc-by"), (1, 2, 1, 0, 0, "cc-by"), (None, 3, 1, 0, 0, "reserved"), (7, 300_003, 1, 300_000, 300_000, "gpl"), (8, 8, 2, 3, 6, "cc-by")], key=str)
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for x in L.op11_license_scan(spark, small).collect():
        words, base = plain(docs[x.doc_id])
        assert (x.n_words, x.n_base, x.base_labels) == (len(words), len(base), ",".join(sorted({b for _, b in base})))
        assert (x.first_word, x.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and x.labels == ",".join(sorted(x.labels.split(",")))
