"""Fingerprints, token counts, BPE and line dedup against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import bpe, fingerprints, hashing, lines, token_counts
from tests.llm.conftest import odd_rows, unordered

RANKS = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
OWN = bpe.Encoding(RANKS, public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)
TEXTS = st.text(alphabet=st.sampled_from("aabcei'st \n\t\x1c\x85  1٣é中🎉  .,_-\r"), max_size=60)


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_replayed_merges_are_the_library_s(texts):
    found = list(OWN.encode(texts))
    assert found == [LIBRARY.encode_ordinary(t) for t in texts]
    assert [OWN.decode(ids) for ids in found] == [t.encode() for t in texts]


def test_merges_that_bring_up_lower_ranks():
    """A vocabulary in which 'abc' ranks below 'ab', and 'ca' between them."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ca", b"ab", b"aba", b"cab", b"bcab"]
    for order in itertools.permutations(range(256, 263), 7):
        ranks = dict(zip(tokens[:256], range(256), strict=True))
        ranks |= dict(zip(tokens[256:], order, strict=True))
        if order[0] > 258:  # enough of them
            continue
        own = bpe.Encoding(ranks, public_tokenizers.PATTERN)
        library = tiktoken.Encoding(
            "some", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        texts = ["abcab", "cabcabca", "abababc", "bcabca abcabcabc", "aab"]
        assert list(own.encode(texts)) == [library.encode_ordinary(t) for t in texts]


def test_many_words_are_replayed_in_few_steps(monkeypatch):
    """Steps go by waves of ranks and by the merges of a word, not by the ranks in use (some 2,000 here)."""
    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(0, 12))) for _ in range(5000)]
    words += ["".join(rng.choices("etaoin", k=3000)), "ab" * 400, "é中" * 50]
    steps = []
    ranks_of = bpe.Encoding._ranks
    monkeypatch.setattr(bpe.Encoding, "_ranks", lambda self, a, b: steps.append(len(a)) or ranks_of(self, a, b))
    ids, upto = OWN.replay([w.encode() for w in words])
    assert len(steps) < 1000
    want = [LIBRARY.encode_ordinary(w) for w in words]
    assert [ids[a:b] for a, b in itertools.pairwise(upto)] == want


def test_long_runs_of_one_letter():
    for n in (2, 3, 17, 5000):
        assert next(OWN.encode(["a" * n])) == LIBRARY.encode_ordinary("a" * n)


def test_round_trip(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip(odd, path, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in odd_rows():
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or ""), True))
    assert unordered(got) == unordered(want)
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0
    ids = bpe.encode(odd, path, public_tokenizers.PATTERN)
    back = bpe.decode(ids, path).collect()
    assert unordered((r.doc_id, bytes(r.decoded)) for r in back) == unordered(
        (r[0], (r[1] or "").encode()) for r in odd_rows()
    )


def test_token_counts(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = token_counts.count_tokens(odd, path, max_tokens=30, batch_bytes=50).collect()
    want = [(r[0], len((r[1] or "").encode()), count(r[1]), count(r[1]) > 30) for r in odd_rows()]
    assert unordered(got) == unordered(want)
    assert token_counts.count_tokens(none, path).count() == 0


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_pieces_are_whole_and_safe(text):
    pieces = token_counts.safe_pieces(text)
    assert "".join(pieces) == text
    assert sum((LIBRARY.encode_ordinary(p) for p in pieces), []) == LIBRARY.encode_ordinary(text)


def test_batches_are_balanced_by_size():
    batches = list(token_counts.balanced(["aa"] * 10 + ["b" * 50] + ["c"], 6))
    assert [sum(map(len, b)) for b in batches] == [6, 6, 6, 2, 50, 1]


def test_fingerprints_are_sums_of_paragraphs():
    f = fingerprints.fingerprint
    whole, swapped = f("one two\nthree\nfour five"), f("four five\none two\nthree")
    assert fingerprints.printed(whole) == fingerprints.printed(swapped)
    less = fingerprints.deleted(whole, f("three"))
    assert fingerprints.printed(less) == fingerprints.printed(f("one two\nfour five"))
    assert fingerprints.printed(fingerprints.inserted(less, f("three"))) == fingerprints.printed(whole)
    assert fingerprints.printed(f("three one")) != fingerprints.printed(f("one three"))
    assert fingerprints.likeness(fingerprints.parsed(fingerprints.printed(whole)), swapped) == 1.0
    assert fingerprints.likeness(f(""), f("a")) == 0.0
    assert fingerprints.likeness(f(""), f("")) == 1.0


def text_hash(text):
    unsigned = xxhash.xxh64((text or "").encode(), seed=42).intdigest()
    return unsigned - (1 << 64) if unsigned >> 63 else unsigned


def edited(rows):
    """The rows of ``edited_fingerprints`` in plain Python."""
    low = -(1 << 63)
    key = lambda r: (low if r[0] is None else r[0], text_hash(r[1]), r[0] is not None, r[1] is not None)
    rows = sorted(rows, key=key, reverse=True)
    want = []
    for row, after in zip(rows, rows[1:] + rows[:1], strict=True):
        text, other = row[1] or "", after[1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        f, g, n = map(fingerprints.fingerprint, (text, changed, other))
        want.append((row[0], len(text), sha(changed), fingerprints.printed(f),
                     fingerprints.printed(g), fingerprints.likeness(f, g), fingerprints.likeness(f, n)))
    return want


def test_edited_fingerprints(spark, odd, none):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert unordered(got) == unordered(edited(odd_rows()))
    assert fingerprints.edited_fingerprints(none).count() == 0
    for n in (1, 2):
        few = spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string")
        assert fingerprints.edited_fingerprints(few).count() == n


@pytest.mark.parametrize("shared", [None, 0, 5000, -(1 << 63)])
def test_an_id_of_many_rows_fills_many_ranges(spark, shared):
    """A third of the rows share an id, or have none, and no task gets them all."""
    rows = [(shared if i % 3 == 0 else i, f"text number {i} of them") for i in range(1500)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        sizes = [len(p) for p in fingerprints.with_next(docs).rdd.glom().collect()]
        assert max(sizes) < 3 * 1500 / 12
        assert unordered(fingerprints.edited_fingerprints(docs).collect()) == unordered(edited(rows + rows[:9]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_likeness_of_texts_with_a_pair_very_often():
    f = fingerprints.fingerprint
    assert fingerprints.likeness(f("alpha " * 65_537), f("alpha " * 65_540)) > 0.999
    assert fingerprints.likeness(f("alpha " * 30_000), f("alpha " * 15_000)) > 0.5


def test_fingerprints_of_every_row(odd, none):
    want = [(r[0], fingerprints.printed(fingerprints.fingerprint(r[1] or ""))) for r in odd_rows()]
    assert unordered(fingerprints.fingerprints(odd).collect()) == unordered(want)
    assert fingerprints.fingerprints(none).count() == 0


def test_words_of_long_texts_in_blocks(monkeypatch):
    text = ("word " * 20 + "x" * 300 + "\n\tÉnd ").encode() * 20
    whole = hashing.words(text)
    monkeypatch.setattr(hashing, "BLOCK", 64)
    for a, b in zip(whole, hashing.words(text), strict=True):
        assert np.array_equal(a, b)


def lines_dropped(rows, least):
    key = lambda s: s.strip(" \t\n\v\f\r").translate(
        {i: i + 32 for i in range(65, 91)}
    )
    seen = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            seen.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if not key(x) or len(seen[key(x)]) < least]
        out.append((doc_id, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(odd, none):
    got = lines.deduplicated(odd).selectExpr("row.doc_id", "n_lines", "n_dropped", "kept_text")
    want = lines_dropped(odd_rows(), 10)
    assert sum(n for _, _, n, _ in want) >= 11
    assert unordered(got.collect()) == unordered(want)
    kept = lines.with_kept_text(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert lines.with_kept_text(none).count() == 0
