"""Toxicity by a subsequence kernel and a support vector machine over Nyström landmarks.

The kernel of two words counts the letter triples that they have in common, in
order and with gaps; every letter in a gap makes a triple lighter. A word with
letters left out or put in between so stays near the plain word. It is
normalised, and values under ``NEAR`` count as 0, so that nearly all words of a
text are near no landmark and cost one lookup per distinct word of a slice.

Landmarks are words that labelled toxic texts have and others don't, chosen to
be unlike each other, and the most frequent words of clean texts that are near
one of those. A sentence's vector has its words' highest kernel value for each
landmark; Nyström's map (the inverse square root of the landmarks' own kernel
matrix) makes it a point in the kernel's space, and a linear support vector
machine (squared hinge) separates the points. Labels are of texts: in the second
round only those sentences of a toxic text train as toxic that the first round
found so, its best one at least. A text's score is the logistic of its best
sentence's margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.hashing import words
from quire.llm.tables import written

#: Labelled rows that a model is fitted on, those of the lowest hashes, and their sentences.
MAX_ROWS = 20_000
MAX_SENTENCES = 40_000
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 96, 16
NEAR = 0.55
DECAY = 0.7
SPAN = 6
#: Of the kernel: a product of kernels, in which what is alike stands out more.
POWER = 3

# Letters of either case, digits, and the bytes of other letters; 0 is left out.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = np.arange(27, 37)
_CLASS[128:] = 37 + np.arange(128) % 26
_CLASS[[9, 10, 11, 12, 13, 32]] = 63  # stands ahead of each word, so that beginnings are alike
_PATTERNS = [(a, a + b, DECAY ** (a + b - 2)) for a in range(1, SPAN) for b in range(1, SPAN - a + 1)]
_WORDS_AT_ONCE = 20_000


def triples(flat: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For words laid end to end: owner and number of every triple, by weight."""
    c = _CLASS[flat]
    owner, c = owner[c > 0], c[c > 0]  # marks between letters make no gap
    for near, far, weight in _PATTERNS:
        n = len(c) - far
        if n <= 0:
            continue
        a, b, z = c[:n], c[near : near + n], c[far:]
        there = np.flatnonzero(owner[:n] == owner[far:])
        yield owner[there], (a[there] << 12) | (b[there] << 6) | z[there], weight


def laid_out(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end, a blank ahead of each, and the number of the word at each byte."""
    flat = np.frombuffer(b"".join([b" " + w for w in found]), np.uint8)
    return flat, np.repeat(np.arange(len(found)), [len(w) + 1 for w in found])


def profiles(found: list[bytes]) -> list[dict[int, float]]:
    """Triples of each word with their summed weights."""
    out: list[dict[int, float]] = [{} for _ in found]
    for owner, triple, weight in triples(*laid_out(found)):
        for i, t in zip(owner.tolist(), triple.tolist(), strict=True):
            out[i][t] = out[i].get(t, 0.0) + weight
    return out


class Landmarks:
    """Kernel values of many words with a few fixed ones."""

    def __init__(self, found: list[bytes]) -> None:
        self.words = found
        own = profiles(found)
        number = {t: i + 1 for i, t in enumerate(sorted(set().union(*own)))} if own else {}
        self.row = np.zeros(1 << 18, np.int32)
        for t, i in number.items():
            self.row[t] = i
        cells = sorted(
            (number[t], j, w / np.sqrt(sum(x * x for x in p.values())))
            for j, p in enumerate(own)
            for t, w in p.items()
        )
        self.begin = np.searchsorted([c[0] for c in cells], np.arange(len(number) + 2))
        self.column = np.array([c[1] for c in cells], np.int64)
        self.weight = np.array([c[2] for c in cells], np.float64)

    def kernel(self, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``n`` words are near a landmark, and their kernel values."""
        m = len(self.words)
        total, square = np.zeros(n * m), np.zeros(n)
        for of, triple, weight in triples(flat, owner):
            square += np.bincount(of, minlength=n) * weight**2
            row = self.row[triple]
            known = np.flatnonzero(row)
            row, of = row[known], of[known]
            first, size = self.begin[row], self.begin[row + 1] - self.begin[row]
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            cell = np.repeat(of, size) * m + self.column[at]
            total += np.bincount(cell, self.weight[at] * weight, n * m)
        total = total.reshape(n, m)
        # Equal triples of a word only make it longer than the root of ``square``.
        maybe = np.flatnonzero((square > 0) & (total.max(axis=1, initial=0) >= NEAR * np.sqrt(square)))
        ends = np.searchsorted(owner, np.arange(n + 1))
        exact = profiles([flat[ends[i] + 1 : ends[i + 1]].tobytes() for i in maybe])
        length = np.array([np.sqrt(sum(x * x for x in p.values())) for p in exact])
        value = total[maybe] / length[:, None] if len(maybe) else np.zeros((0, m))
        value = np.where(value >= NEAR - 1e-9, np.minimum(value, 1.0), 0.0) ** POWER
        near = value.any(axis=1)
        return maybe[near], value[near]

    def of_words(self, found: list[bytes]) -> np.ndarray:
        """Kernel values of a list of words, a row each."""
        out = np.zeros((len(found), len(self.words)))
        which, value = self.kernel(*laid_out(found), len(found))
        out[which] = value
        return out


def _spelled(text: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, bytes]]:
    """Runs of three one-byte words or more as a word: 'b a d'."""
    one = np.flatnonzero((ends - starts) == 1)
    if len(one) < 3:
        return []
    runs = np.split(one, np.flatnonzero(np.diff(one) != 1) + 1)
    return [
        (int(starts[r[0]]), bytes(text[starts[i]] for i in r)) for r in runs if len(r) >= 3
    ]


def sentences(texts: list[bytes], landmarks: Landmarks) -> tuple[np.ndarray, np.ndarray]:
    """Text and vector of each sentence that has a word near a landmark."""
    joined = b"\n" + b"\n".join(texts)
    h, starts, ends = words(joined, fold=True)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    places, values = [], []
    data = np.frombuffer(joined, np.uint8)
    for at in range(0, len(first), _WORDS_AT_ONCE):
        some = first[at : at + _WORDS_AT_ONCE]
        size = (ends - starts)[some] + 1
        owner = np.repeat(np.arange(len(some)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        which, value = landmarks.kernel(data[starts[some][owner] - 1 + inside], owner, len(some))
        places.append(which + at)
        values.append(value)
    near = np.concatenate(places) if places else np.zeros(0, np.int64)
    value = np.concatenate(values) if values else np.zeros((0, len(landmarks.words)))
    number = np.full(len(first), -1)
    number[near] = np.arange(len(near))
    hit = number[inverse] if len(inverse) else number
    which = np.flatnonzero(hit >= 0)
    byte, vector = starts[which], value[hit[which]]
    if spelled := _spelled(joined, starts, ends):
        more = landmarks.of_words([w for _, w in spelled])
        kept = np.flatnonzero(more.any(axis=1))
        byte = np.concatenate((byte, [spelled[i][0] for i in kept])).astype(np.int64)
        vector = np.concatenate((vector, more[kept]))
    if not len(byte):
        return np.zeros(0, np.int64), np.zeros((0, len(landmarks.words)))
    order = np.argsort(byte, kind="stable")
    byte, vector = byte[order], vector[order]
    gap = np.ones(len(data), bool)
    gap[:-1] = np.isin(data[1:], (9, 10, 11, 12, 13, 32))
    stop = np.flatnonzero((np.isin(data, (33, 46, 63)) & gap) | (data == 10))
    cuts = np.cumsum([len(t) + 1 for t in texts])
    text = np.searchsorted(cuts, byte - 1, "right")
    sentence = np.searchsorted(stop, byte)
    begin = np.flatnonzero(
        np.concatenate(([True], (sentence[1:] != sentence[:-1]) | (text[1:] != text[:-1])))
    )
    return text[begin], np.maximum.reduceat(vector, begin, axis=0)


@dataclass(frozen=True)
class Model:
    """Landmark words and what turns a sentence's kernel values into a text's score."""

    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4):
    """Weights and bias of the least squared hinge loss, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    total = weight.sum()
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(50):
        active = y * (x @ w) < 1
        a = x[active] * weight[active, None] / total
        new = np.linalg.solve(a.T @ x[active] + np.diag(keep), a.T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * (w + new) if _ > 25 else new
    return w[:-1], float(w[-1])


def _logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - 1e-3 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w + np.clip(np.linalg.solve(bend, slope), -3, 3)
    return max(float(w[0]), 0.0), float(w[1])


def _chosen_words(train: DataFrame) -> list[bytes]:
    """Landmarks from the words of the labelled texts."""
    cut = train.selectExpr("toxic", "explode(split(lower(text), '[.!?\\n]+')) as sentence")
    # A sentence counts once, however many copies of its text there are.
    once = cut.groupBy("sentence").agg(F.min("toxic").alias("toxic"))
    of_sentence = once.selectExpr(
        "toxic", "explode(array_distinct(regexp_extract_all(sentence, '\\\\p{L}{3,}', 0))) as word"
    )
    by_word = of_sentence.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    by_word = written(by_word.where("n >= 3"), "toxic-words")
    pos, total = once.selectExpr("coalesce(sum(toxic), 0)", "count(*)").first()
    odds = f"ln((t + 0.5) / ({pos} + 1) * ({total - pos} + 1) / (n - t + 0.5))"
    toxic = by_word.where(f"t >= {max(5, pos // 2000)} and {odds} > 2")
    toxic = toxic.orderBy(F.expr(f"t * {odds}").desc(), "word")
    chosen: list[bytes] = []
    for row in toxic.limit(20 * TOXIC_LANDMARKS).collect():
        word = row.word.encode()
        if len(chosen) < TOXIC_LANDMARKS and profiles([word])[0]:
            if not chosen or Landmarks(chosen).of_words([word]).max() < 0.85**POWER:
                chosen.append(word)
    if not chosen:
        return []
    clean = by_word.where("t = 0 or 10 * t < n").orderBy(F.desc("n"), "word").limit(20_000)
    listed = [r.word.encode() for r in clean.collect()]
    like = Landmarks(chosen).of_words(listed).max(axis=1, initial=0)
    near = [w for w, v in zip(listed, like, strict=True) if v > 0]
    return chosen + near[:CLEAN_LANDMARKS]


def _sentence_rows(batches, landmarks: list[bytes]) -> Iterator[pa.RecordBatch]:
    made = Landmarks(landmarks)
    for batch in slices(batches):
        text, vector = sentences(encoded(batch.column(1)), made)
        ids = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(ids), batch.column(2).take(ids),
             pa.array(list(vector.astype(np.float32)), pa.list_(pa.float32()))],
            ["doc_id", "toxic", "vector"],
        )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from the rows of ``labels`` (``doc_id``, ``toxic`` 0 or 1) found in ``docs``.

    Rows without an id or a label don't train; of more than ``max_rows`` ids
    those with the lowest hashes do. Where no word tells the labels apart, or
    one label is missing, every text gets the share of label 1 as its score.
    """
    usable = labels.selectExpr("cast(doc_id as bigint) as _d", "cast(toxic as int) as toxic")
    usable = usable.where("_d is not null and toxic in (0, 1)").groupBy("_d").agg(
        F.max("toxic").alias("toxic")
    )
    sample = usable.orderBy(F.xxhash64("_d"), "_d").limit(max_rows)
    rows = text_rows(docs).join(F.broadcast(sample), F.expr("doc_id = _d"))  # max_rows at most
    train = written(rows.selectExpr("doc_id", "text", "toxic"), "toxic-train")
    n, pos = train.selectExpr("count(*)", "coalesce(sum(toxic), 0)").first()
    prior = (pos + 0.5) / (n + 1) if n else 0.0
    flat = Model([], np.zeros(0), 0.0, 0.0, float(np.log(prior / (1 - prior))) if prior else -30.0)
    chosen = _chosen_words(train) if 0 < pos < n else []
    if not chosen:
        return flat

    made = train.mapInArrow(
        partial(_sentence_rows, landmarks=chosen),
        "doc_id bigint, toxic int, vector array<float>",
    )
    some = made.orderBy(F.xxhash64("doc_id", "vector")).limit(MAX_SENTENCES).toArrow()
    doc, label = some.column(0).to_numpy(), some.column(1).to_numpy()
    kernel = np.array(some.column(2).to_pylist()).reshape(len(doc), len(chosen))
    values, vectors = np.linalg.eigh(Landmarks(chosen).of_words(chosen))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    x = np.vstack([kernel @ root, np.zeros((1, len(chosen)))])  # the last: a sentence near nothing
    y = np.append(np.where(label == 1, 1.0, -1.0), -1.0)
    weight = np.append(np.ones(len(doc)), float(min(n - pos, len(doc) + 1)))
    used = np.ones(len(x), bool)
    for _ in range(2):
        toxic, clean = (weight[used & (y == v)].sum() for v in (1, -1))
        balance = np.where(y > 0, clean / max(toxic, 1.0), 1.0)  # the logistic has the true shares
        w, bias = _hinge(x[used], y[used], (weight * balance)[used])
        margin = x @ w + bias
        ids, at = np.unique(doc, return_inverse=True)
        best = np.full(len(ids), -np.inf)
        np.maximum.at(best, at, margin[:-1])
        used = np.append((label == 0) | (margin[:-1] > 0) | (margin[:-1] >= best[at]), True)
    # Texts near nothing have the bias as their margin.
    of_doc = np.zeros(len(ids))
    of_doc[at] = label
    best = np.maximum(best, bias)
    left = np.array([n - pos - (of_doc == 0).sum(), pos - (of_doc == 1).sum()], float)
    slope, shift = _logistic(
        np.append(best, [bias, bias]),
        np.append(of_doc, [0.0, 1.0]),
        np.append(np.ones(len(ids)), np.maximum(left, 0.0)),
    )
    return Model(chosen, root @ w, bias, slope, shift)


def _score_rows(batches, model: Model) -> Iterator[pa.RecordBatch]:
    made = Landmarks(model.landmarks)
    for batch in slices(batches):
        margins = np.full(batch.num_rows, model.bias)
        if model.landmarks:
            text, vector = sentences(encoded(batch.column(1)), made)
            np.maximum.at(margins, text, vector @ model.weights + model.bias)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(model.scores(margins))], ["doc_id", "score"]
        )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``, by its text alone and without a shuffle.

    A null or empty text has no sentence near a landmark. Null ids and repeated
    rows get a row each; other columns are not looked at; an empty table gives
    an empty one.
    """
    return text_rows(docs).mapInArrow(partial(_score_rows, model=model), "doc_id bigint, score double")
