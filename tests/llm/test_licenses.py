"""The licence scan against plain readings of its contract."""

import random
import re

import pytest

from formline.llm import license_scan as L
from formline.llm.license_rules import BASE, LONGEST, NAMES, RULES, telling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LINES = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "under the MIT\tlicense", "licensed under CC BY-NC 4.0.", "cc by nc cc by nc",
    "SPDX-License-Identifier: GPL-2.0-or-later", "This work is licensed under the GNU General Public License, version 3.", "the İstanbul ünder the mit license", "under the mit", "license",
    "https://creativecommons.org/licenses/by-sa/4.0/", "All rights reserved.",
]


def plain(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = sorted((i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), places


def texts():
    rng = random.Random(5)
    out = [None, "", "  ", "\x00", "mit", "x" * 5000]
    for _ in range(60):
        out.append(" ".join(rng.choice([*LINES, "word", "é", "a-b_c", "The", "\x7f", " "]) for _ in range(rng.randrange(1, 40))))
    return out


def test_base_places(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "under the mit license", "y"), (3, "\x00", "z")]
    got = L.licenses(spark.createDataFrame(rows, "doc_id long, text string, n_words string")).collect()
    assert len(got) == len(rows)
    want = sorted(repr((doc, *plain(t))) for doc, t, _ in rows)
    have = []
    for r in got:
        places = plain(dict((d, t) for d, t, _ in rows)[r.doc_id])[1]
        have.append(repr((r.doc_id, r.n_words, places)))
        assert r.n_base == len(places)
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({p[1] for p in places}))
        assert {p[1] for p in places} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
    assert sorted(have) == want


@pytest.mark.parametrize("size", [40, 700])
def test_windows_see_what_one_pass_sees(size):
    for t in texts()[:30]:
        raw = ((t or "") + " ") * 4
        assert L.scan(raw.encode(), size=size) == L.scan(raw.encode())


def test_statements():
    def said(text):
        return [RULES[i].label for i, _, _ in L.resolve(L.scan(text.encode())[2])]

    assert said("SPDX-License-Identifier: LGPL-2.1-only") == ["lgpl-2.1"]
    assert said("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.") == ["gpl-2-or-later"]
    assert said("Licensed under the Mozilla Public License 2.0 and the ISC license") == ["mpl-2", "isc"]
    assert said("CC BY-NC-SA 3.0") == ["cc-by-nc-sa-3.0"]
    assert said("see https://www.gnu.org/licenses/gpl-3.0.html") == ["gpl-3"]
    assert said("a limited edition of the public version") == []


def test_resolution_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        found = sorted({(rng.randrange(5), a := rng.randrange(20), a + rng.randrange(1, 8)) for _ in range(rng.randrange(12))})
        free = [x for x in found if not any(y != x and y[1] <= x[1] and x[2] <= y[2] and ((y[1], y[2]) != (x[1], x[2]) or y[0] < x[0]) for y in found)]
        want = []
        for x in sorted(free):
            if not any(x[1] < y[2] and y[1] < x[2] for y in want):
                want.append(x)
        assert L.resolve(found) == sorted(want, key=lambda x: x[1])


def samples(pattern):
    """Strings that a simple pattern matches: each alternative of each group, optional parts left out and put in."""
    import re._parser as parser

    def grow(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                part = [chr(arg)]
            elif name == "IN":
                part = [chr(arg[0][1])]
            elif name == "SUBPATTERN":
                part = grow(arg[-1])
            elif name == "BRANCH":
                part = [s for b in arg[1] for s in grow(b)]
            else:
                part = [s * n for n in {arg[0], min(arg[1], arg[0] + 1)} for s in grow(arg[2])]
            out = [a + b for a in out for b in part][:400]
        return out

    return grow(parser.parse(pattern))


def test_prefilter_leaves_no_match_out():
    for line in NAMES.strip().splitlines():
        name = line.split(" | ")[2]
        for s in samples(name):
            assert set(telling(name).split()) & set(s.split()), (name, s)
    for r in RULES:
        assert r.every or r.some, r.label


def test_rules_are_many_and_bounded():
    assert len(RULES) > 300
    for r in RULES:
        gaps = sum(int(n) for n in re.findall(rb"\{0,(\d+)\}|\{1,(\d+)\}", r.pattern.pattern) for n in n if n)
        assert r.pattern.pattern.count(b" ") + gaps < LONGEST


def test_empty_table(spark):
    assert L.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
