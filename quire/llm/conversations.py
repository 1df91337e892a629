"""Repair of conversations by interval parsing with a weighted grammar.

Turns are to read system? (user assistant)+, or nothing. Each turn is kept, given
another role or deleted, and turns without text may be inserted, each at a cost.
A cell holds, for a span of turns and each symbol of the grammar, the cheapest
(cost, audit) that makes the span that symbol; an audit is the edits' initials
in order. Symbols stand for what a piece of a proper conversation can be, by its
first and last role, so that every symbol of a span comes of two symbols of its
halves, wherever it is halved: rules have Chomsky's normal form, and spans are
combined bottom-up by length 1, 2, 4, ... Cells of single turns are closed under
insertion on both sides, which closes all others.

Of equal costs the ASCII-least audit wins. It does so in parts as well: two
audits of a span with equal cost are never one the beginning of the other, as
what the longer one has more would be insertions, which cost.

Turns are partitioned by ranges of (conversation, turn), so that a conversation
of any length is parsed in pieces, one in each partition; their cells are few and
are combined in turn. Most conversations lie within one partition and are done
there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import written
from quire.sources.ship import ship

# --- fixed values ------------------------------------------------------------
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
GAP = " \t\n\x0b\x0c\r"
STOPS = ".!?"
# ---------------------------------------------------------------------------

# A symbol is the first and last role of what it stands for; 's' is a system turn alone.
SYMBOLS = ("", "uu", "ua", "au", "aa", "s", "su", "sa")
PROPER = ("", "ua", "sa")
_AT = {name: i for i, name in enumerate(SYMBOLS)}


def _rules() -> list[tuple[int, int, int]]:
    """Left, right and whole: roles must take turns where two symbols meet."""
    out = []
    for left in SYMBOLS:
        for right in SYMBOLS:
            if not left or not right:
                whole = left or right
            elif right[0] == "s" or (left[-1] == right[0]) or (left == "s" and right[0] != "u"):
                continue
            else:
                whole = left[0] + right[-1]
            out.append((_AT[left], _AT[right], _AT[whole]))
    return out


RULES = _rules()
Cell = list  # of (cost, audit) or None, by symbol


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans in a row."""
    out: Cell = [None] * len(SYMBOLS)
    for a, b, whole in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        cost, best = x[0] + y[0], out[whole]
        if best is None or cost < best[0]:
            out[whole] = (cost, x[1] + y[1])
        elif cost == best[0]:
            out[whole] = (cost, min(best[1], x[1] + y[1]))
    return out


def _least(one: Cell, other: Cell) -> Cell:
    return [min((x for x in pair if x is not None), default=None) for pair in zip(one, other, strict=True)]


def _closed(cell: Cell) -> Cell:
    """With any insertions on both sides."""
    inserted: Cell = [None] * len(SYMBOLS)
    inserted[_AT["uu"]] = inserted[_AT["aa"]] = (INSERT_COST, INSERT)
    while True:
        more = _least(cell, _least(combined(inserted, cell), combined(cell, inserted)))
        if more == cell:
            return cell
        cell = more


def _leaf(kind: str) -> Cell:
    """The cell of one turn: 'd' must go; else its role's initial, upper case if it is truncated."""
    cell: Cell = [None] * len(SYMBOLS)
    cell[_AT[""]] = (DELETE_COST, DELETE)
    if kind != "d":
        extra = TRUNCATED_COST if kind.isupper() else 0
        for role, symbol in (("u", "uu"), ("a", "aa")):
            kept = kind.lower() == role
            cell[_AT[symbol]] = (extra, KEEP) if kept else (REROLE_COST + extra, REROLE)
        if kind.lower() == "s":
            cell[_AT["s"]] = (extra, KEEP)
    return _closed(cell)


LEAVES = {kind: _leaf(kind) for kind in "duasxUASX"}


def _bottom_up(cells: list[Cell]) -> Cell:
    """Spans of 2, 4, 8, ... cells, each from its two halves."""
    while len(cells) > 1:
        odd = [cells[-1]] if len(cells) % 2 else []
        cells = [combined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)] + odd
    return cells[0]


@lru_cache(maxsize=50_000)
def _known(kinds: str) -> Cell:
    return _bottom_up([LEAVES[k] for k in kinds])


def cell_of(kinds: str) -> Cell:
    """The cell of a span of turns, given by their kinds; short spans are remembered."""
    return _bottom_up([_known(kinds[i : i + 8]) for i in range(0, len(kinds), 8)])


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[_AT[name]] for name in PROPER if cell[_AT[name]] is not None)


class Replay:
    """The repaired turns of a conversation, by its audit."""

    def __init__(self, audit: str) -> None:
        self.audit = audit
        self.at = 0
        self.last = ""

    def _next_role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            role = self._next_role()
            self.last = role[0]
            yield role, ""

    def fed(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What comes ahead of this turn and what becomes of it."""
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != DELETE:
            role = role if edit == KEEP else self._next_role()
            self.last = role[0]
            yield role, text


class Digest:
    """SHA-256 of lines 'role:text', fed one by one."""

    def __init__(self) -> None:
        self.sha = hashlib.sha256()
        self.gap = b""

    def add(self, turns: Iterable[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(self.gap + f"{role}:{text}".encode())
            self.gap = b"\n"


class Piece:
    """Consecutive turns of one conversation, as far as a partition holds them."""

    def __init__(self, conv_id: int | None, part: int, open_: bool) -> None:
        self.conv_id, self.part, self.open = conv_id, part, open_
        self.turns: list[tuple[str, str, int]] = []
        self.kinds: list[str] = []
        self.low = self.high = None
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        """``copies`` equal turns; ``again`` if role and text stand in an earlier turn."""
        if not self.open:
            self.turns.append((role, text, copies))
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.distinct += 1
        initial = role[:1]
        words = text.strip(GAP)
        if not words:
            self.blank += copies
            kind = "d"
        elif again:
            self.duplicate += copies
            kind = "d"
        else:
            self.duplicate += copies - 1
            kind = initial if initial in ("u", "a", "s") else "x"
            if words[-1] not in STOPS:
                self.truncated += 1
                kind = kind.upper()
        self.kinds.append(kind + "d" * (copies - 1))
        if self.first is None:
            self.first = initial
        else:
            self.illegal += not follows(self.last, initial)
        self.illegal += (copies - 1) * (not follows(initial, initial))
        self.last = initial


def follows(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("open", pa.bool_())]
    + [(name, pa.int64()) for name in ("low", "high", "distinct", *COUNTS)]
    + [("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64()))]
    + [("audits", pa.list_(pa.string())), ("gaps", pa.int64()), ("cost", pa.int64())]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_RESULT = ("conv_id", "gaps", *COUNTS, "cost", "audit")
SUMMARY_SQL = (
    "conv_id bigint, part int, open boolean, low bigint, high bigint, distinct bigint, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, "
    "last string, costs array<bigint>, audits array<string>, gaps bigint, cost bigint, "
    "audit string, repaired_sha256 string"
)
RESULT_SQL = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, "
    "illegal bigint, cost bigint, audit string"
)
_MOST = (1 << 63) - 1


def _gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else min(high - low + 1 - distinct, _MOST)


def _summary(piece: Piece) -> dict:
    row = {name: getattr(piece, name) for name in ("conv_id", "part", "open", *COUNTS)}
    row |= {name: getattr(piece, name) for name in ("low", "high", "distinct", "first", "last")}
    kinds = "".join(piece.kinds)
    if piece.open:
        if kinds:
            cell = cell_of(kinds)
            row["costs"] = [x and x[0] for x in cell]
            row["audits"] = [x and x[1] for x in cell]
        return row
    cost, audit = cheapest(cell_of(kinds)) if kinds else (0, "")
    replay, digest = Replay(audit), Digest()
    for role, text, copies in piece.turns:
        for _ in range(copies):
            digest.add(replay.fed(role, text))
    digest.add(replay.inserted())
    row["gaps"] = _gaps(piece.low, piece.high, piece.distinct)
    return row | {"cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest()}


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of a sorted partition.

    Its first and last conversation may go on in other partitions: they are
    open, and their cells are handed on instead of a result.
    """
    part = TaskContext.get().partitionId()
    piece, done = None, []
    for batch in batches:
        for conv, turn, role, text, copies, again in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if piece is None or conv != piece.conv_id:
                if piece is not None:
                    done.append(_summary(piece))
                piece = Piece(conv, part, open_=piece is None)
            if copies:
                piece.add(turn, role, text, copies, again)
        if done:
            yield pa.RecordBatch.from_pylist(done, _SUMMARY)
            done = []
    if piece is not None:
        piece.open = True
        yield pa.RecordBatch.from_pylist([_summary(piece)], _SUMMARY)


def _joined(table: pa.Table) -> pa.Table:
    """The result of one conversation from its pieces, without the digest."""
    rows = sorted(table.to_pylist(), key=lambda r: r["part"])
    out = {name: sum(r[name] for r in rows) for name in COUNTS}
    turned = [r for r in rows if r["low"] is not None]
    distinct = sum(r["distinct"] for r in turned)
    distinct -= sum(a["high"] == b["low"] for a, b in pairwise(turned))
    filled = [r for r in rows if r["costs"] is not None]
    for a, b in pairwise(filled):
        out["illegal"] += not follows(a["last"], b["first"])
    cells = [
        [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
        for r in filled
    ]
    cost, audit = cheapest(_bottom_up(cells)) if cells else (0, "")
    low = turned[0]["low"] if turned else None
    high = turned[-1]["high"] if turned else None
    out |= {"conv_id": rows[0]["conv_id"], "gaps": _gaps(low, high, distinct)}
    out |= {"cost": cost, "audit": audit}
    schema = pa.schema([_SUMMARY.field(name) for name in _RESULT])
    return pa.Table.from_pylist([out], schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, repaired_sha256`` of a sorted stream: an audit, then its conversation's turns."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def row() -> pa.RecordBatch:
        digest.add(replay.inserted())
        made = {"conv_id": at, "repaired_sha256": digest.sha.hexdigest()}
        return pa.RecordBatch.from_pylist([made], schema)

    replay, digest, at = None, Digest(), None
    for batch in batches:
        for conv, kind, role, text, copies in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if kind == 0:
                if replay is not None:
                    yield row()
                replay, digest, at = Replay(text), Digest(), conv
            for _ in range(copies):
                digest.add(replay.fed(role, text))
    if replay is not None:
        yield row()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, n, role, text`` of every repaired turn, from the same stream."""
    names = ["conv_id", "n", "role", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def put(turns: Iterable[tuple[str, str]]) -> None:
        nonlocal n
        for role, text in turns:
            out.append((at, n, role, text))
            n += 1

    replay, at, n, out = None, None, 0, []
    for batch in batches:
        for conv, kind, role, text, copies in zip(
            *(c.to_pylist() for c in batch.columns), strict=True
        ):
            if kind == 0:
                if replay is not None:
                    put(replay.inserted())
                replay, at, n = Replay(text), conv, 0
            for _ in range(copies):
                put(replay.fed(role, text))
        if out:
            columns = zip(zip(*out, strict=True), types, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)
            out = []
    if replay is not None:
        put(replay.inserted())
    if out:
        columns = zip(zip(*out, strict=True), types, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)


ORDER = ("turn", "role", "text")


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, again``: equal turns in one row, written once.

    A null role or text is one blank. ``again`` tells that an earlier turn of
    the conversation has the same role and text. A row that ``rows`` marks with
    ``gone`` leaves its conversation's id behind, with no copies.
    """
    gone = "gone" if "gone" in rows.columns else "false"
    plain = rows.selectExpr(
        "cast(conv_id as bigint) as conv_id", f"if({gone}, null, cast(turn as bigint)) as turn",
        f"if({gone}, ' ', coalesce(cast(role as string), ' ')) as role",
        f"if({gone}, ' ', coalesce(cast(text as string), ' ')) as text",
        f"cast(if({gone}, 0, {'copies' if 'copies' in rows.columns else '1'}) as bigint) as copies",
    )
    grouped = plain.groupBy("conv_id", *ORDER).agg(F.sum("copies").alias("copies"))
    said = grouped.selectExpr(
        "*", "xxhash64(role, text) as _a", "xxhash64(text, 7, role) as _b"
    )
    repeated = said.where("copies > 0").groupBy("conv_id", "_a", "_b").agg(
        F.count("*").alias("_n"), F.min("turn").alias("_first"),
        F.max(F.isnull("turn")).alias("_null"),
    ).where("_n > 1").selectExpr("conv_id as _c", "_a as _x", "_b as _y", "_first", "_null")
    same = (
        F.col("conv_id").eqNullSafe(F.col("_c"))
        & (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))
    )
    again = "if(_null, turn is not null, coalesce(turn > _first, false))"
    return written(
        said.join(repeated, same, "left").selectExpr(
            "conv_id", *ORDER, "copies", f"coalesce({again}, false) as again"
        ),
        "turns",
    )


def _stream(turned: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit ahead of its turns, in partitions by conversation."""
    both = turned.selectExpr("conv_id", "1 as kind", *ORDER, "copies").unionByName(
        audits.selectExpr(
            "conv_id", "0 as kind", "cast(null as bigint) as turn", "'' as role", "audit as text",
            "cast(0 as bigint) as copies",
        )
    )
    sorted_ = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return sorted_.select("conv_id", "kind", "role", "text", "copies")


def repairs(turned: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of every conversation of ``turns``.

    Columns: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. Turns come by number, nulls first, then by role and text;
    of a turn's faults the first one counts, in this order: no characters but
    white space, role and text seen earlier, a last character other than
    ``.!?``. ``gaps`` are turn numbers that lack between the least and the
    greatest, at most 2^63 - 1, ``illegal`` neighbouring roles that are not
    system user, user assistant or assistant user, by their initials. Blank turns
    and duplicates must be deleted (3), other turns may; a new role user or
    assistant costs 2, an inserted turn 2, a truncated turn that stays 1. The
    digest is of the repaired lines ``role:text``.

    Rows without a conversation are one conversation. A conversation without
    turns has zeros, an empty audit and the digest of nothing; an empty table
    has no rows. Equal rows are one row with a count, so that copies don't pile
    up; a conversation of any length is parsed in ranges of its turns, and only
    its digest, which can't be parted, reads it in one stream.
    """
    ship(turned.sparkSession)
    # Longer texts are not sampled for the ranges; those that begin alike stay together.
    ranges = turned.repartitionByRange(
        "conv_id", "turn", "role", F.substring("text", 1, 256)
    ).sortWithinPartitions("conv_id", *ORDER)
    made = written(
        ranges.select("conv_id", *ORDER, "copies", "again").mapInArrow(_pieces, SUMMARY_SQL),
        "pieces",
    )
    whole = made.where("not open").select(*_RESULT, "repaired_sha256")
    parts = made.where("open")
    joined = written(parts.groupBy("conv_id").applyInArrow(_joined, RESULT_SQL), "joined")
    # At most two conversations of each partition.
    few = F.broadcast(joined.select(F.col("conv_id").alias("_c")))
    theirs = turned.join(few, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    sha = _stream(theirs, joined).mapInArrow(_digests, "conv_id bigint, repaired_sha256 string")
    sha = sha.withColumnRenamed("conv_id", "_c")
    rest = joined.join(sha, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return whole.unionByName(rest)


def repaired(turned: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, n, role, text``: the turns of ``turns`` after the edits of ``repairs``, from 0 on."""
    ship(turned.sparkSession)
    return _stream(turned, audits).mapInArrow(
        _replayed, "conv_id bigint, n bigint, role string, text string"
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by the CRC-32 of 'conv_id:turn' (nulls: a blank).

    Of 20 remainders, 0 drops a turn (``gone``), 1 empties its text, 2 takes its
    ``.!?`` away, 3 gives it a copy (``copies``) and 4 makes its role user.
    """
    key = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    kind = f"crc32({key}) % 20"
    text = "coalesce(cast(text as string), ' ')"
    return rows.selectExpr(
        "cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn",
        f"if({kind} = 4, 'user', coalesce(cast(role as string), ' ')) as role",
        f"case {kind} when 1 then '' when 2 then translate({text}, '{STOPS}', '') "
        f"else {text} end as text",
        f"if({kind} = 3, 2, 1) as copies", f"{kind} = 0 as gone",
    )
