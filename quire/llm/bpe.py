"""Byte-level BPE over whole batches: every merge is replayed on all their words at once.

The distinct words of a batch form its corpus. An inverted index leads from each
pair of neighbouring tokens, by the rank of their union, to the places where it
stands; the ranks are taken in order, in waves in which each word merges at the
places of its lowest rank, and only the pairs of the two neighbours of a merged
place enter the index anew. A word that occurs a million times is merged once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.memory import Memory, uncollected

MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of text in one corpus, whose words and places are Python objects many times as
#: large, and the chunks that a worker remembers: less of both is slower and smaller.
CORPUS_BYTES = 4 << 20
REMEMBERED = 150_000
#: Parts of the ranks in which merges are replayed, at most 256.
WAVES = 64
#: The rank of a pair that has no union.
NONE = (1 << 31) - 1
_LOADED: dict[tuple, Encoding] = {}

# What is kept of a chunk: its ids in decimal and the bytes that they decode to.
Entry = tuple[str, bytes]

# Places where a blank neither ends a word nor begins one, so that the text
# can't be cut ahead of it: white space, or the end, on both sides.
_GLUED = regex.compile(r"\p{White_Space} (?:\p{White_Space}|$)")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines 'base64 rank'."""
    pairs = (line.split() for line in data.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _filed(index: list[list[np.ndarray]], waves: np.ndarray, places: np.ndarray) -> None:
    """Put each place into the index under its wave."""
    order = np.argsort(waves, kind="stable")
    waves, places = waves[order], places[order]
    cuts = np.flatnonzero(np.append(True, waves[1:] != waves[:-1])) if len(waves) else []
    for wave, part in zip(waves[cuts].tolist(), np.split(places, cuts[1:]), strict=False):
        index[wave].append(part)


def _ends(parts: list, more: int) -> np.ndarray:
    """Where each part begins if all stand in a row with ``more`` characters between them, and the end."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + more
    return np.append(0, np.cumsum(sizes))


class Encoding:
    """Encoder and decoder of one vocabulary; the pattern cuts a text into words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED) -> None:
        # Of the library for rank files, white space is the Unicode property;
        # here it would hold four more control characters.
        unicode = pattern.replace(r"[^\s", r"[^\p{White_Space}")
        unicode = unicode.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(unicode).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.printed = {rank: str(rank) for rank in self.bytes_of}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = ranks
        self.n_ranks = max(self.bytes_of) + 1
        union: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    union[left << 32 | right] = rank
        self.pairs = np.array([-1, *sorted(union)], np.int64)
        # Tokens that have a union of a lower rank than their own with some other one.
        self.risky = np.zeros(self.n_ranks, bool)
        self.risky[[t for pair, u in union.items() for t in (pair >> 32, pair & 0xFFFFFFFF) if u < t]] = True
        self.unions = np.array([NONE, *map(union.__getitem__, sorted(union))], np.int32)
        self.known = Memory(remembered)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens; ``NONE`` where they have no union."""
        keys = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where(self.pairs[at] == keys, self.unions[at], np.int32(NONE))

    def replay(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Token ids of all words in a row, and where each word's begin (one more at the end).

        All merges are applied in rank order over all words together: in waves of
        neighbouring ranks, in which each word merges its lowest rank, then its
        next one. A merge may bring up a pair of a lower rank, if the vocabulary
        has such; words where it does are merged again by themselves, pair by pair.
        """
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        token = np.append(self.byte_ids[data], np.int32(-1))
        after = np.append(np.arange(1, n + 1), n).astype(np.int32)  # next of the same word, or n
        after[ends[sizes > 0] - 1] = n
        before = np.append(np.arange(-1, n - 1), n).astype(np.int32)  # the last one, or n
        before[(ends - sizes)[sizes > 0]] = n
        pair = np.full(n + 1, NONE, np.int32)  # rank of the pair that begins at a place
        pair[:n] = self._ranks(token[:n], token[after[:n]])
        lowest = np.full(len(words), NONE, np.int32)  # rank that a word merges next
        # The index: for each wave its first places, then those that came later.
        wave_of = self._waves(pair[:n])
        index: list[list[np.ndarray]] = [[] for _ in range(int(wave_of[-1]) + 1)]
        begun = np.flatnonzero(pair[:n] < NONE).astype(np.int32)
        _filed(index, wave_of[pair[begun]], begun)
        lower = [np.zeros(0, np.int32)]
        for wave, found_places in enumerate(index):
            while found_places:
                places = np.sort(np.concatenate(found_places))
                places = np.delete(places, np.flatnonzero(places[1:] == places[:-1]))
                found_places.clear()
                rank = pair[places]
                due = rank < NONE  # a neighbour may have merged meanwhile
                due[due] = wave_of[rank[due]] == wave
                places, rank = places[due], rank[due]
                if not len(places):
                    continue
                own = word[places]
                np.minimum.at(lowest, own, rank)
                now = rank == lowest[own]
                lowest[own] = NONE
                found_places.append(places[~now])
                places, rank, own = places[now], rank[now], own[now]
                # Of overlapping pairs every other one merges, from the first on.
                lap = np.append(False, after[places[:-1]] == places[1:])
                if lap.any():
                    count = np.arange(len(places))
                    odd = (count - np.maximum.accumulate(np.where(lap, 0, count))) % 2 == 0
                    places, rank, own = places[odd], rank[odd], own[odd]
                gone = after[places]
                then = after[gone]
                same = own[1:] == own[:-1]
                if same.any():  # would one of a word's merges bring up a lower pair by itself?
                    many = (np.append(False, same) | np.append(same, False)) & self.risky[rank]
                    at, low = places[many], rank[many]
                    up = self._ranks(token[before[at]], low) < low
                    lower.append(at[up | (self._ranks(low, token[then[many]]) < low)])
                token[places], token[gone] = rank, -1
                pair[gone] = NONE
                after[places] = then
                before[then] = places
                ahead = before[places]
                inside = ahead < n
                touched = np.append(places, ahead[inside])
                found = self._ranks(token[touched], token[after[touched]])
                pair[touched] = found
                low = found <= np.append(rank, rank[inside])
                if low.any():
                    lower.append(touched[low])
                known = (found < NONE) & ~low
                _filed(index, wave_of[found[known]], touched[known])
        alive = token[:n] >= 0
        ids = token[:n][alive].tolist()
        upto = np.append(0, np.cumsum(alive))[np.append(0, ends)].tolist()
        for i in np.unique(word[np.concatenate(lower)])[::-1].tolist():
            own_ids = self.one_by_one(words[i])
            longer = len(own_ids) - (upto[i + 1] - upto[i])
            ids[upto[i] : upto[i + 1]] = own_ids
            upto[i + 1 :] = [x + longer for x in upto[i + 1 :]]
        return ids, upto

    def _waves(self, pair: np.ndarray) -> np.ndarray:
        """For each rank its wave; all waves have about as many of the first places."""
        counts = np.bincount(pair[pair < NONE], minlength=self.n_ranks) + 1
        upto = np.cumsum(counts)
        return ((upto - counts) * WAVES // upto[-1]).astype(np.uint8)

    def one_by_one(self, word: bytes) -> list[int]:
        """Token ids of a word, merging the first pair of the lowest rank again and again."""
        n = len(word)
        end = list(range(1, n + 1))  # of the part that begins at a place; 0 if none does
        begin = list(range(-1, n))  # of the part that ends at a place
        queue = [(self.whole[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in self.whole]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has merged meanwhile
            end[i], end[middle] = stop, 0
            begin[stop] = i
            for left, right in ((begin[i], stop), (i, end[stop] if stop < n else 0)):
                if left >= 0 and right:
                    rank = self.whole.get(word[left:right])
                    if rank is not None:
                        heapq.heappush(queue, (rank, left, right))
        return [self.whole[word[i : end[i]]] for i in range(n) if end[i]]

    def chunks(self, text: str) -> list[str]:
        """The text in parts that are encoded each for itself, mostly a blank and a word."""
        if _GLUED.search(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *map(" ".__add__, rest)] if first else [" " + x for x in rest]

    def learn(self, chunks: set[str]) -> dict[str, Entry]:
        """The entries of all these chunks; one replay for the words of new ones."""
        self.known.make_room()
        new = self.known.missing(chunks)
        cut = list(map(self.split, new))
        of = self.of_words(list(set(chain.from_iterable(cut))))
        known = self.known.young
        for c, ws in zip(new, cut, strict=True):
            if len(ws) == 1:
                known[c] = of[ws[0]]
            else:
                printed, back = zip(*[of[w] for w in ws], strict=True)
                known[c] = " ".join(printed), b"".join(back)
        return known

    def of_words(self, words: list[str]) -> dict[str, Entry]:
        raw = [w.encode() for w in words]
        whole = self.whole
        of = {w: (self.printed[whole[r]], self.bytes_of[whole[r]]) for w, r in zip(words, raw, strict=True) if r in whole}
        if len(of) < len(words):
            words = [w for w in words if w not in of]
            ids, upto = self.replay([r for r in raw if r not in whole])
            # All ids are printed and decoded in a row, which is cut into the words.
            printed = list(map(self.printed.__getitem__, ids))
            back = list(map(self.bytes_of.__getitem__, ids))
            said = _ends(printed, 1)[upto].tolist()
            made = _ends(back, 0)[upto].tolist()
            printed, back = " ".join(printed), b"".join(back)
            for w, (a, b), (c, d) in zip(words, pairwise(said), pairwise(made), strict=True):
                of[w] = printed[a : b - 1], back[c:d]
        return of

    def entries(self, texts: list[str]) -> Iterator[tuple[tuple[str, ...], tuple[bytes, ...]]]:
        """For every text what its chunks' ids are printed as and decode to; the texts are one corpus."""
        with uncollected():
            cut = [self.chunks(t) if t else [] for t in texts]
            entry = self.learn(set().union(*cut)).__getitem__
            for chunks in cut:
                yield tuple(zip(*map(entry, chunks), strict=True)) if chunks else ((), ())

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of every text."""
        for printed, _ in self.entries(texts):
            yield list(map(int, " ".join(printed).split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _loaded(key: tuple, data: bytes, pattern: str, remembered: int = REMEMBERED) -> Encoding:
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoding(read_ranks(data), pattern, remembered)
    return _LOADED[key]


def _vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>``: the token ids of every text.

    ``vocabulary`` is a file of lines 'base64 rank' with all 256 bytes, of at
    most 64 MiB; ``pattern`` cuts texts into words. Special strings are text. A
    null text is empty: no ids. No match of ``pattern`` may begin ahead of a blank
    that stands between two other characters and end behind it. A row for each
    row of ``docs``, null and repeated ids included; other columns are not looked
    at.
    """
    data = _vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    name = hashlib.sha256(data).hexdigest()

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded((name, pattern), sent.value, pattern)
        for batch in slices(batches, CORPUS_BYTES):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = pa.array(list(made.encode(texts)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return text_rows(docs).mapInArrow(batches_of, "doc_id bigint, ids array<int>")


def decode(encodings: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, decoded binary``: the bytes of every row of ``ids``; null ids give no bytes."""
    data = _vocabulary(vocabulary)
    sent = encodings.sparkSession.sparkContext.broadcast(data)
    name = hashlib.sha256(data).hexdigest()

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded((name, ""), sent.value, "")
        for batch in batches:
            whole = [made.decode(ids or []) for ids in batch.column(1).to_pylist()]
            out = pa.array(whole, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["doc_id", "decoded"])

    chosen = encodings.selectExpr("cast(doc_id as bigint) as doc_id", "cast(ids as array<int>)")
    return chosen.mapInArrow(batches_of, "doc_id bigint, decoded binary")


def round_trip(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    corpus_bytes: int = CORPUS_BYTES,
    remembered: int = REMEMBERED,
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, exact``: encode, decode and digest.

    ``ids_sha256`` is of the decimal ids joined by a blank, ``decoded_sha256`` of
    the bytes that the ids decode to; ``exact`` tells whether these are the
    text's. Nulls, repeated rows and other columns as in ``encode``.
    """
    data = _vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(data)
    name = hashlib.sha256(data).hexdigest()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _loaded((name, pattern, remembered), sent.value, pattern, remembered)
        for batch in slices(batches, corpus_bytes):
            raw = encoded(batch.column(1))
            counts, of_ids, of_bytes, exact = [], [], [], []
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for text, (printed, parts) in zip(raw, made.entries(texts), strict=True):
                ids, back = " ".join(printed).encode(), b"".join(parts)
                counts.append(ids.count(b" ") + 1 if ids else 0)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(back).hexdigest())
                exact.append(back == text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_bytes, pa.string()), pa.array(exact, pa.bool_())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, exact boolean"
    return text_rows(docs).mapInArrow(digests, schema)
