"""The Jaccard join, substring dedup and components against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import jaccard, substrings, trie
from quire.llm.components import components
from tests.llm.conftest import odd_rows, unordered

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowest_by_link(nodes, linked):
    above = {n: n for n in nodes}

    def find(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        above[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_classes(rows, percent=75):
    sets = []
    for _, text, *_ in rows:
        w = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [
        (i, j)
        for i in range(len(rows)) for j in range(i)
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    of = lowest_by_link(range(len(rows)), links)
    ids = defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            ids[of[i]].append(row[0])
    return [
        (row[0], len(sets[i]), min(ids[of[i]], default=None) if sets[i] else row[0])
        for i, row in enumerate(rows)
    ]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(odd, none, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    assert unordered(jaccard.near_duplicates(odd).collect()) == unordered(jaccard_classes(odd_rows()))
    assert jaccard.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_of_the_table(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    monkeypatch.setattr(jaccard, "HEAVY_LEAST", 4)
    monkeypatch.setattr(jaccard, "RANGE_SHINGLES", 20_000)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    want = jaccard_classes(rows)
    assert any(a != c for a, _, c in want)
    assert unordered(jaccard.near_duplicates(docs).collect()) == unordered(want)


def test_chains_over_many_blocks(spark, monkeypatch):
    """Each text is like the next only, so classes join through every block."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[5 * i : 5 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(w[8 * i : 8 * i + 60])) for i in range(20)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert unordered(got.collect()) == unordered(jaccard_classes(rows))


def kept_of_each(rows):
    """For every component the ids and texts of the rows that may stand for it; rows without words."""
    classes = defaultdict(list)
    numbered = [(i, r[1]) for i, r in enumerate(rows)]
    for row, (i, n, c) in zip(rows, jaccard_classes(numbered), strict=True):
        classes[c if n else (i, "wordless")].append(row)
    out = []
    for of in classes.values():
        low = min((r[0] is None, r[0] or 0) for r in of)
        out.append({(r[0], r[1]) for r in of if (r[0] is None, r[0] or 0) == low})
    return out


def assert_one_of_each(got, rows):
    """``got`` has exactly one of the rows that may stand for each component, and all without words."""
    want = kept_of_each(rows)
    rest = Counter((r[0], r[1]) for r in got)
    assert sum(rest.values()) == len(want)
    for of in sorted(want, key=len):
        chosen = next((x for x in of if rest[x]), None)
        assert chosen is not None, of
        rest[chosen] -= 1


def test_one_row_of_each(spark, odd):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(40))
    lone = " ".join(f"lone{i}" for i in range(40))
    rows = [(5, text, "s"), (5, text, "s"), (5, text, "t"), (None, text, "s"), (7, text + " end", "s")]
    rows += [(2, other, "s"), (5, other, "s"), (9, other + " end", "s")]  # 5 is in both components
    rows += [(None, lone, "s")] * 30 + [(None, lone + " end", "u")] * 3
    rows += [(11, None, "s"), (11, None, "s"), (None, " ", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    for given_rows, table in ((rows, docs), (odd_rows(), odd)):
        assert_one_of_each(jaccard.one_of_each(table).collect(), given_rows)
    again = [unordered(jaccard.one_of_each(docs.repartition(n)).collect()) for n in (1, 7)]
    assert again[0] == again[1]
    assert [r[0] for r in again[0] if (r[1] or "").startswith("other")] == [2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=14), min_size=1, max_size=14),
       st.integers(0, 13))
def test_tries_lose_no_link(sets, cut):
    arrays = [np.array(sorted(s), np.int64) for s in sets]
    sizes = [len(s) for s in sets]
    near = lambda i, j: 100 * len(sets[i] & sets[j]) >= 60 * len(sets[i] | sets[j])
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if near(i, j)]
    assert trie.linked(arrays, sizes, 60) == list(lowest_by_link(range(n), pairs).values())
    cut = min(cut, n)
    made = trie.linked_across(
        arrays[:cut], sizes[:cut], list(range(cut)), arrays[cut:], sizes[cut:],
        list(range(cut, n)), 60,
    )
    across = [(i, j) for i, j in pairs if j < cut <= i]
    got = lowest_by_link(range(n), [(i + cut, j) for i, j in made])
    assert got == lowest_by_link(range(n), across)


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(200, 100), (100, 300), (7, 7), (None, 3)]
    got = components(spark.createDataFrame(links, "a long, b long"))
    want = {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert {r.node: r.label for r in got.collect()} == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def repeats_removed(rows, length):
    texts = [WORDS.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[i : i + length]) for w in texts for i in range(len(w) - length + 1))
    out = []
    for row, w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone.update(range(i, i + length))
        out.append((row[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_substrings(odd, none, docs):
    want = repeats_removed(odd_rows(), 35)
    assert any(0 < n < w for _, w, n, _ in want)
    assert unordered(substrings.without_repeats(odd).collect()) == unordered(want)
    assert substrings.without_repeats(none).count() == 0
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert unordered(substrings.without_repeats(docs).collect()) == unordered(repeats_removed(rows, 35))


def test_substrings_of_few_words_and_short_windows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"], rng.integers(0, 60)))) for i in range(60)]
    made = substrings.without_repeats(
        spark.createDataFrame(rows, "doc_id long, text string"), length=12, k=3
    )
    assert unordered(made.collect()) == unordered(repeats_removed(rows, 12))


def test_first_lowest():
    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 5, 8, 13, 30):
        g = rng.integers(0, 6, 60).astype(np.uint64)
        want = [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]
        assert substrings.first_lowest(g, width).tolist() == want


