import random
import re

import pytest

from webframe.llm.license_scan import BASE, automaton, choices, postfix, scan, scan_licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    places = [i for i, _ in hits]
    return len(w), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


def test_base_against_word_by_word():
    rng, found = random.Random(9), automaton()
    parts = ["MIT", "license", "License,", "GNU general", "public", "cc", "BY", "cc-by-nc", "apache", "é", "\n", "xcc by", "gnu", "\x01", "ü3", "\x7f"]
    for _ in range(3000):
        text = rng.choice([" ", "\n", " - "]).join(rng.choices(parts, k=rng.randrange(0, 14)))
        assert scan(text.encode(), found)[:5] == brute(text), text


@pytest.mark.parametrize(
    "text,want",
    [
        ("MIT", [{"mit"}]),
        ("MIT or Apache-2.0", [{"apache"}, {"mit"}]),
        ("GPL-2.0-only with Classpath-exception-2.0 AND (BSD-3-Clause OR X-own)", [{"bsd", "gpl"}, {"gpl", "other"}]),
        ("a OR b AND c", [{"other"}]),
        ("(MIT AND ISC) OR MIT", [{"mit"}]),
        ("((MIT))", [{"mit"}]),
        ("MIT OR", []), ("(MIT", []), ("MIT)", []), ("MIT ISC", []), ("and", []), ("", []), ("()", []),
    ],
)
def test_expressions(text, want):
    assert choices(text) == [frozenset(x) for x in want]


def test_precedence():
    assert postfix("a or b and c with d or e") == "a b c d with and or e or".split()


def test_table(spark):
    tag = "# SPDX-License-Identifier: (MIT OR GPL-3.0)\nx"
    long = "word " * 50000 + "Apache License"
    rows = [(1, "Licensed under the Apache License, Version 2.0.", "a"), (2, tag, "b"), (None, None, "c"), (3, "", "d"), (4, long, "e"), (4, long, "e"), (5, "All rights reserved", "f")]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [brute(t) for _, t, _ in rows]
    assert [r.labels for r in got] == ["apache", "gpl,mit", "", "", "apache", "apache", "reserved"]
    assert got[1].expressions == ["gpl or mit"] and got[2].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert scan_licenses(spark.createDataFrame([], "text string, score int")).count() == 0


@pytest.mark.parametrize(
    "text,want",
    [
        ("<!-- SPDX-License-Identifier: MIT -->", ["mit"]),
        ("<!--SPDX-License-Identifier: MIT-->", ["mit"]),
        ("{# SPDX-License-Identifier: (MIT OR ISC) #}", ["isc or mit"]),
        ("SPDX-License-Identifier: GPL-2.0+ Copyright by us SPDX-License-Identifier: MIT. And so on", ["gpl", "mit"]),
        ("/* SPDX-License-Identifier: MIT OR */", ["mit"]),
        ("SPDX-License-Identifier: (MIT) AND (ISC", ["mit"]),
        ("<p>SPDX-License-Identifier: MIT</p>) SPDX-License-Identifier: MIT)", ["mit", "mit"]),
        ("SPDX-License-Identifier: MIT\nand ISC", ["mit"]),
        ("SPDX-License-Identifier: (MIT", []), ("SPDX-License-Identifier: -- MIT", []), ("SPDX-License-Identifier:", []),
    ],
)
def test_what_follows_an_expression(text, want):
    assert scan(text.encode(), automaton())[7] == want
