"""Periodic runs against plain Python."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, runs
from quire.llm.hashing import words_of
from tests.llm.conftest import SF_DIR, odd_rows, unordered


def plain_runs(words, min_length=6, min_repeats=4):
    """Maximal stretches of every period, those with a smaller period left out."""
    found = []
    n = len(words)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, min_repeats * q):
                stretch = words[i : i + length]
                if all(stretch[d:] != stretch[:-d] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_planted(doc_id, text):
    words = split(text)
    n = len(words)
    if doc_id is None or n == 0 or zlib.crc32(str(doc_id).encode()) % 10:
        return words
    g = zlib.crc32(str(doc_id).encode()) // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def found_in(texts, **options):
    h, begin = words_of([t.encode() for t in texts])
    out = [[] for _ in texts]
    for i, *run in runs.runs_of(h, begin, **options).tolist():
        out[i].append(tuple(run))
    return out


PIECES = st.lists(
    st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 9)),
    max_size=5,
).map(lambda parts: [w for unit, times in parts for w in unit * times])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=5))
def test_runs_are_those_of_plain_python(texts):
    assert found_in([" ".join(t) for t in texts]) == [plain_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(PIECES)
def test_other_limits(words):
    got = found_in([" ".join(words)], min_length=9, min_repeats=5)
    assert got == [plain_runs(words, 9, 5)]


def test_least_lcp():
    assert runs.least_lcp() == 5
    assert runs.least_lcp(2, 4) == 3


def test_long_texts():
    many = ["a"] * 30_000 + ["b"] + ["c", "d", "e"] * 9_000 + ["b"]
    morse = [0]
    for _ in range(13):  # no stretch three times in a row, but equal polynomial hashes
        morse += [1 - x for x in morse]
    got = found_in([" ".join(many), " ".join(map(str, morse)), " ".join(["z y"] * 20_000)])
    assert got == [[(0, 30_000, 1), (30_001, 27_000, 3)], [], [(0, 40_000, 2)]]


def test_classes_of_random_words():
    words = np.random.default_rng(5).choice(["p", "q"], 3000).tolist()
    assert found_in([" ".join(words)]) == [plain_runs(words)]


def want_row(doc_id, text):
    words = plain_planted(doc_id, text)
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    printed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (
        doc_id, len(found), *(top or (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        hashlib.sha256(printed.encode()).hexdigest(),
        hashlib.sha256(plain_collapsed(words, found).encode()).hexdigest(),
    )


def test_odd_rows(odd, none):
    rows = [r for r in odd_rows() if len(r[1] or "") < 20_000]
    few = odd.where("coalesce(length(text), 0) < 20000")
    got = runs.digests(runs.periodic_runs(runs.planted(few))).collect()
    assert unordered(got) == unordered(want_row(r[0], r[1]) for r in rows)
    plain = runs.periodic_runs(few).collect()
    want = []
    for doc_id, text, *_ in rows:
        found = plain_runs(split(text))
        want.append((doc_id, found, plain_collapsed(split(text), found)))
    assert unordered((r[0], [tuple(x) for x in r[1]], r[2]) for r in plain) == unordered(want)
    assert runs.digests(runs.periodic_runs(runs.planted(none))).count() == 0
    long = runs.periodic_runs(odd.where("length(text) >= 20000")).collect()
    assert len(long) == 2 and all(len(r.collapsed.split()) >= 9_000 for r in long)


def test_query(spark):
    """All documents of fewer than 3,000 words, planted ones among them."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: want_row(*r) for r in rows if len(split(r.text)) < 3000}
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(rows) and len(want) > 0.9 * len(rows)
    assert {k: got[k] for k in want} == want
    assert any(w[1] for w in want.values())


def test_limits_are_checked(odd):
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, min_repeats=3)
