"""Token counts: encoding in Arrow batches, of which only the lengths come back."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow import encoded, slices, text_rows
from quire.llm.memory import Memory

#: Vocabulary files are broadcast; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20

# A blank with something else than white space ahead of it or after it begins a
# match of the usual patterns: what stands on either side is encoded alike with
# or without the other side. Where white space is on both sides it may not.
_SAFE = re.compile(r" (?:(?<=\S )|(?=\S))")
_GLUED = re.compile(r"\s (?:\s|$)")
_LOADED: dict[str, tuple] = {}


def safe_pieces(text: str, specials: tuple[str, ...] = ()) -> list[str]:
    """The text cut at every safe boundary; whole if a special string is in it.

    A text without blanks has no safe boundary and stays whole as well.

    White space ahead of a special string ends there as it does at a text's end,
    so blanks that are safe elsewhere are not beside it.
    """
    if any(s in text for s in specials):
        return [text]
    if _GLUED.search(text):
        cuts = [m.start() for m in _SAFE.finditer(text) if m.start()]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)] if first else [" " + x for x in rest]


def _json_lengths(data: bytes):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
    made = Tokenizer.from_str(data.decode())
    made.no_truncation()
    made.no_padding()
    specials = tuple(t.content for t in made.get_added_tokens_decoder().values())
    encode = made.encode_batch_fast
    return (lambda texts: [len(e) for e in encode(texts, add_special_tokens=False)]), specials


def _piece_lengths(data: bytes):
    from sentencepiece import SentencePieceProcessor

    made = SentencePieceProcessor(model_proto=data)
    return (lambda texts: [len(ids) for ids in made.encode(texts, num_threads=1)]), ()


def count_tokens(
    docs: DataFrame, vocabulary: str, max_tokens: int = 512, batch_bytes: int = 1 << 20
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``vocabulary`` is the path of a .json file of the tokenizers library or of a
    .model file of sentencepiece. No begin, end or padding token is counted;
    special strings inside a text count as the library's default has it.

    Texts are cut at all boundaries that no token crosses (.json with the usual
    byte-level cut at blanks only: sentencepiece normalises across blanks, so
    its texts stay whole). The library gets each new piece once, in batches of
    about ``batch_bytes`` whatever the lengths of the texts, and a worker
    remembers the lengths of a bounded number of pieces.

    A null text counts as empty: no bytes, no tokens. Null ids, repeated rows
    and rows with equal ids stay as they are, a row for each. Other columns are
    not looked at. An empty table gives an empty one.
    """
    with open(vocabulary, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{vocabulary} has more than {MAX_VOCABULARY_BYTES} bytes")
    whole = vocabulary.endswith(".model")
    sent = docs.sparkSession.sparkContext.broadcast(data)
    name = hashlib.sha256(data).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _LOADED:
            _LOADED.clear()
            load = _piece_lengths if whole else _json_lengths
            _LOADED[name] = *load(sent.value), Memory()
        lengths, specials, known = _LOADED[name]
        for batch in slices(batches):
            texts = [x or "" for x in batch.column(1).to_pylist()]
            cut = [[x] for x in texts] if whole else [safe_pieces(x, specials) for x in texts]
            known.make_room()
            for pieces in balanced(known.missing(set().union(*cut)), batch_bytes):
                known.young.update(zip(pieces, lengths(pieces), strict=True))
            n_tokens = [sum(map(known.young.__getitem__, pieces)) for pieces in cut]
            n_bytes = [len(x) for x in encoded(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > max_tokens for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )
            if whole:
                known.young = {}

    return text_rows(docs).mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def balanced(pieces: list[str], size: int) -> Iterator[list[str]]:
    """The pieces in batches of about ``size`` bytes, each of at least one piece."""
    batch: list[str] = []
    weight = 0
    for piece in pieces:
        own = len(piece) if piece.isascii() else len(piece.encode())
        if batch and weight + own > size:
            yield batch
            batch, weight = [], 0
        batch.append(piece)
        weight += own
    if batch:
        yield batch
