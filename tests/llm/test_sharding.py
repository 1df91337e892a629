"""Shards against a plain search for the least capacity."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries, sharding
from tests.llm.conftest import SF_DIR, odd_rows


def hash_of(text):
    unsigned = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def greedy(sizes, capacity):
    """How many of the sizes each shard takes, or None if one is too large."""
    out, room = [0], capacity
    for s in sizes:
        if s > capacity:
            return None
        if s > room:
            out.append(0)
            room = capacity
        out[-1] += 1
        room -= s
    return out


def plain_shards(groups, shards):
    """Hash to shard, by trying one capacity after the other where the greedy count changes."""
    left = dict(groups)
    own = []
    while len(own) < shards - 1 and left:
        top = min(left, key=lambda u: (-left[u], u))
        if left[top] * (shards - len(own)) <= sum(left.values()):
            break
        own.append(top)
        del left[top]
    shard_of = {u: i for i, u in enumerate(own)}
    order = sorted(left)
    sizes = [left[u] for u in order]
    if sizes:
        low, high = max(sizes), sum(sizes)
        while low < high:
            middle = (low + high) // 2
            if len(greedy(sizes, middle)) <= shards - len(own):
                high = middle
            else:
                low = middle + 1
        at = 0
        for i, n in enumerate(greedy(sizes, low)):
            for u in order[at : at + n]:
                shard_of[u] = len(own) + i
            at += n
    return shard_of


def check(got, rows, shards):
    groups = defaultdict(int)
    for _, text in rows:
        groups[hash_of(text or "")] += len((text or "").encode()) + 8
    want = plain_shards(groups, shards)
    expected = Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), want[hash_of(t or "")])
        for i, t in rows
    )
    assert Counter((r[0], r[1], r[2], r[3]) for r in got) == expected
    slots = defaultdict(list)
    for r in got:
        slots[r[3]].append(r[4])
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_odd_rows(odd, none):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for shards in (1, 2, 5, 24):
        check(sharding.sharded(odd, shards).collect(), rows, shards)
    assert sharding.sharded(none, 24).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(odd, 0)


@pytest.mark.parametrize("bits, more", [(12, 6), (2, 1), (1, 20)])
def test_all_documents(spark, docs, monkeypatch, bits, more):
    """Also where ranges are so few that many rounds are needed."""
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "MORE_BITS", more)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check(sharding.sharded(docs, 24).collect(), rows, 24)


def test_pieces_of_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE_BITS", 2)
    rows = [(i, f"text {i % 50}" if i % 3 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(sharding.sharded(docs, 3).collect(), rows, 3)


def test_query(spark, docs):
    got = queries.op13_sharding(spark, SF_DIR)
    assert got.columns == [
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard",
    ]
    rows = got.collect()
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    check(
        [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in rows],
        [(r.doc_id, r.text) for r in docs.collect()], 24,
    )


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 8), st.integers(1, 4)
)
def test_search_on_ranges(sizes, shards, bits):
    """The search over coarse ranges ends at the cuts of the plain one."""

    groups = dict(enumerate(sizes))

    def summed(units, at, within):
        out = {}
        for unit, size in units.items():
            if within is None or unit >> within[0] in within[1]:
                key = unit >> at
                total, n = out.get(key, (0, 0))
                out[key] = total + size, n + 1
        return [(k << at, s, n == 1) for k, (s, n) in out.items()]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sharding, "_summed", summed)
        patch.setattr(sharding, "FIRST_BITS", 64 - 3)
        patch.setattr(sharding, "MORE_BITS", bits)
        capacity, cuts = sharding.minimax_cuts(groups, shards, max(sizes))
    counts = greedy(sizes, capacity)
    assert len(counts) <= shards
    if capacity > max(sizes):
        assert len(greedy(sizes, capacity - 1)) > shards
    assert cuts == [sum(counts[: i + 1]) for i in range(len(counts) - 1)]
