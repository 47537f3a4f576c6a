"""License scans against a plain version: all rules everywhere, intervals compared pair by pair."""

import random
import re

import numpy as np
import pytest

from gyre.llm import license_scan
from gyre.llm.license_rules import BASE, rules

SCHEMA = "doc_id long, text string, n_words string, found int, labels string"
NOTICES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc,cc-by-nc-4",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later",
    "It is GPL v2 or any later version": "gpl-2",
    "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4",
    "Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License": "cc-by-nc-sa-3",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd",
    "Neither the name of the Example Corp. nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "All rights reserved.": "all-rights-reserved",
    "Alle Rechte vorbehalten": "all-rights-reserved",
    "Wir gehen mit dir und ihm, apache oder nicht, under the sun": "",
    "the version 2 of a commons, by us: general, open, public": "",
    "apache license version 20": "apache",
    "İ under the MIT license": "mit",
}


def plain(text):
    """The query's columns but for the score, by loops over words and pairs."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    base = [(label, i) for label, phrase in BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    spaced = (" " + " ".join(w) + " ").encode()
    ordered = rules()
    found = []
    for k, rule in enumerate(ordered):
        for m in rule.pattern.finditer(spaced):
            a = spaced[: m.start()].count(b" ")
            found.append((k, a, a + m.group().count(b" ") - 1))
    kept = set()
    for k, a, b in found:
        over = [(j, c, d) for j, c, d in found if (j, c, d) != (k, a, b) and c <= a and b <= d and ordered[j].priority >= ordered[k].priority]
        if ordered[k].base or not any((c, d) != (a, b) or ordered[j].priority > ordered[k].priority or j < k for j, c, d in over):
            kept.add(ordered[k].label)
    starts = [i for _, i in base]
    return len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})), ",".join(sorted(kept))


def test_against_plain(spark):
    rnd = random.Random(5)
    pieces = [*NOTICES, "word", "mit", "license", "under the", "gpl", "3", "version 2", "cc by", "nc", "sa 4.0", "\n", "Ünïcode 中文", "or later", "apache", "bsd 3 clause"]
    texts = [None, "", "...", *NOTICES, *(" ".join(rnd.choices(pieces, k=rnd.randint(1, 25))) for _ in range(150)), "x " * 3000 + "under the mit license " * 40 + "y" * 5000]
    df = spark.createDataFrame([(i % 160 or None, t, "x", 1, "y") for i, t in enumerate(texts)], SCHEMA)
    out = license_scan.license_labels(df).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in out]
    assert sorted(got, key=repr) == sorted([(i % 160 or None, *plain(t)) for i, t in enumerate(texts)], key=repr)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in out)


@pytest.mark.parametrize("text, labels", NOTICES.items())
def test_notices(text, labels):
    scan = license_scan.scanner()
    _, found = scan.scan(text)
    got = {scan.rules[i].label for i, _, _, kept in found if kept}
    assert ",".join(sorted(got)) == labels


def test_rules_are_many_and_gated():
    ordered = rules()
    assert len(ordered) > 500 and all(r.needs and all(r.needs) and 0 < r.weight <= 1 for r in ordered)


def sample(parsed, rnd):
    """A random string that a parsed pattern matches."""
    out = ""
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "SUBPATTERN":
            out += sample(arg[-1], rnd)
        elif kind == "BRANCH":
            out += sample(rnd.choice(arg[1]), rnd)
        elif kind == "MAX_REPEAT":
            out += "".join(sample(arg[2], rnd) for _ in range(rnd.randint(arg[0], min(arg[1], 3))))
        elif kind == "NOT_LITERAL":
            out += "q"
        elif kind == "IN":
            literals = [chr(x) for o, x in arg if str(o) == "LITERAL" and x != 32]
            out += rnd.choice(literals or ["q"])
        else:
            assert kind.startswith("ASSERT"), kind
    return out


def test_words_that_a_rule_needs_stand_in_all_it_matches():
    rnd = random.Random(2)
    scan = license_scan.scanner()
    for i, rule in enumerate(scan.rules):
        for _ in range(10):
            text = sample(re._parser.parse(rule.words), rnd)
            assert i in scan.gated(scan.keywords.intersection(text.encode().split())), (rule.words, text)
            assert rule.pattern.search(f" {text} ".encode())


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(["lorem ipsum,"] * 300 + ["Licensed under the Apache License, Version 2.0."] * 30)
    whole = license_scan.scanner().scan(text)
    monkeypatch.setattr(license_scan, "PART", 64)
    assert license_scan.scanner().scan(text) == whole and whole[0] == 600 + 8 * 30


def test_intervals_stay_linear():
    n = 200_000
    scan = license_scan.scanner()
    first = np.arange(n)
    assert scan.unsuppressed(np.zeros(n, int) + len(BASE), first, first + 2).all()


def test_empty(spark):
    assert license_scan.license_labels(spark.createDataFrame([], SCHEMA)).count() == 0
