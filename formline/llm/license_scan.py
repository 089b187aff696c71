"""Licence scans by ordered signature rules.

A text is read as words (ASCII letters in lower case, digits, other characters beyond ASCII).  The set
of its words decides which of the hundreds of rules are tried on it, so a text that speaks of no licence
costs one pass.  Matches are word intervals; where they overlap, the order of the rules and what lies
inside what decide.  Texts are scanned in windows that overlap by more than any rule can span.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id
from formline.llm.license_rules import BASE, LONGEST, RULES, Rule

#: Bytes of a window; a text of any length is held once, and its words only by the window.
WINDOW = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_BASE = tuple((re.compile(b"(?= " + phrase.encode() + b" )"), frozenset(phrase.encode().split()), label) for phrase, label in BASE)
_GATES = frozenset().union(*(g for _, g, _ in _BASE), *(r.every | r.some for r in RULES))


def _windows(raw: bytes, size: int) -> Iterator[tuple[int, bytes, int, int, int]]:
    """(number of the window's first word, its words between single spaces, first and end of the words whose matches it gives, new words)."""
    at, first, done, tail = 0, 0, 0, []
    while at < len(raw):
        end = min(at + size, len(raw))
        part = raw[at:end].translate(_LOWER)
        while end < len(raw) and b" " not in part:  # inside one very long word
            part, end = part + raw[end : end + size].translate(_LOWER), min(end + size, len(raw))
        if end < len(raw):
            part = part[: part.rfind(b" ") + 1]
        words = part.split()
        at += len(part)
        whole, begin, first = tail + words, first - len(tail), first + len(words)
        stop = first if at >= len(raw) else max(first - LONGEST, done)
        yield begin, b" ".join([b"", *whole, b""]), done, stop, len(words)
        tail, done = whole[max(stop - LONGEST - begin, 0) :], stop


def scan(raw: bytes, rules: Sequence[Rule] = RULES, size: int = WINDOW) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, int]]]:
    """(words, base places as (word, label), matches as (rule's place, first word, word after the last))."""
    total, places, found = 0, set(), set()
    for first, text, done, stop, n in _windows(raw, size):
        total += n
        said = _GATES.intersection(text.split())
        if not said:
            continue
        gaps = None
        for i, (pattern, every, gate, made) in enumerate([*((p, g, frozenset(), label) for p, g, label in _BASE), *((r.pattern, r.every, r.some, None) for r in rules)]):
            if not every <= said or (gate and gate.isdisjoint(said)):
                continue
            for m in pattern.finditer(text):
                if gaps is None:
                    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                a = first + int(np.searchsorted(gaps, m.start()))
                if not done <= a < stop:
                    continue
                if made:
                    places.add((a, made))
                else:
                    found.add((i - len(_BASE), a, first + int(np.searchsorted(gaps, m.end()))))
    return total, sorted(places), sorted(found)


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The matches that stand, by place: none that lies inside another (of the same words the earliest rule's stands), and
    of those that overlap in part the one whose rule comes first."""
    whole, far = [], -1
    for rule, a, z in sorted(found, key=lambda x: (x[1], -x[2], x[0])):  # what holds another comes before it
        if z > far:
            whole.append((rule, a, z))
            far = z
    stand: list[tuple[int, int]] = []
    rules: dict[tuple[int, int], int] = {}
    for rule, a, z in sorted(whole):
        at = bisect_left(stand, (a, z))
        if not (at and stand[at - 1][1] > a) and not (at < len(stand) and stand[at][0] < z):
            stand.insert(at, (a, z))
            rules[a, z] = rule
    return [(rules[s], *s) for s in stand]


def licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``,
    ``detections`` (label, first word, word after the last).

    ``n_base`` counts every place of a base phrase; ``first_word`` and ``last_word`` are the smallest and largest of
    their first words.  ``labels`` has the base labels and those of the detections that stand.  ``score`` is the
    weight of the surest statement, 1 for base phrases, 0 without any.  Null and empty texts have no words and no
    labels; repeated rows are judged each alike; of rules that match the same words the earlier one counts, so
    ties can't change a result.  A very long text is held once, with the words of one window.
    """

    def run(x):
        out = {n: [] for n in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")}
        for doc, raw in zip(x["doc_id"], x["text"], strict=True):
            n, places, found = scan(raw, rules)
            stand = resolve(found)
            base = {label for _, label in places}
            row = {
                "doc_id": doc, "n_words": n, "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {rules[i].label for i, _, _ in stand})),
                "score": 1.0 if base else max((rules[i].weight for i, _, _ in stand), default=0.0),
                "detections": [{"label": rules[i].label, "start": a, "stop": z} for i, a, z in stand],
            }
            for name, value in row.items():
                out[name].append(value)
        return out

    kinds = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    docs = narrow(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    done = map_batches(docs, run, kinds + ", detections array<struct<label: string, start: long, stop: long>>")
    return done.select(real_id(), *[c for c in done.columns if c != "doc_id"])
