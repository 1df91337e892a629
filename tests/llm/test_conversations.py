"""Repair of conversations against plain searches."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import conversations, queries
from tests.llm.conftest import unordered

SCHEMA = "conv_id long, turn long, role string, text string, kind int, copies int, _n string"
SF_DIR = "/root/testdata/sf0.01"
STEPS = {"": {"u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def tried(kinds):
    """Every choice of edits with up to three insertions in a place, for a few turns."""
    best = None
    for edits in itertools.product("KRD", repeat=len(kinds)):
        for extra in itertools.product(range(4), repeat=len(kinds) + 1):
            roles, cost = "", 2 * sum(extra)
            audit = ""
            ok = True
            for i, edit in enumerate([*edits, ""]):
                for _ in range(extra[i]):
                    roles += "a" if roles.endswith("u") else "u"
                audit += "I" * extra[i] + edit
                if not edit:
                    break
                kind = kinds[i]
                cost += {"K": 0, "R": 2, "D": 3}[edit] + (edit != "D" and kind.isupper())
                if edit == "R":
                    roles += "a" if roles.endswith("u") else "u"
                elif edit == "K":
                    roles += kind.lower()
                ok = ok and (edit == "D" or kind != "d")
            if ok and re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def one_by_one(kinds):
    """Cheapest audit by going through the turns with the state of the roles so far."""

    def inserting(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for role in STEPS[state].values():
                    new = (cost + 2, audit + "I")
                    best[role] = min(best.get(role, new), new)
        return best

    best = inserting({"": (0, "")})
    for kind in kinds:
        then = {}
        for state, (cost, audit) in best.items():
            options = [(state, 3, "D")]
            if kind != "d":
                more = kind.isupper()
                role = kind.lower()
                options += [(to, 2 + more, "R") for to in STEPS[state].values()]
                if role in STEPS[state] or (role == "s" and state == ""):
                    options.append((role, more, "K"))
            for to, extra, edit in options:
                new = (cost + extra, audit + edit)
                then[to] = min(then.get(to, new), new)
        best = inserting(then)
    return min(best[s] for s in ("", "a") if s in best)


def test_few_turns():
    for n in (1, 2, 3):
        for kinds in itertools.product("duasxUS", repeat=n):
            got = conversations.cheapest(conversations.cell_of("".join(kinds)))
            assert got == one_by_one(kinds)
            if n < 3 or kinds[0] in "dsU":
                assert got == tried(kinds), kinds


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="duasxUASX", min_size=1, max_size=60), st.integers(0, 60))
def test_many_turns_however_halved(kinds, at):
    want = one_by_one(kinds)
    assert conversations.cheapest(conversations.cell_of(kinds)) == want
    a, b = kinds[:at], kinds[at:]
    if a and b:
        both = conversations.combined(conversations.cell_of(a), conversations.cell_of(b))
        assert conversations.cheapest(both) == want


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        here = out[conv]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        here += [(turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain(conv, rows):
    """The row of one conversation, from its turns."""
    rows = sorted(
        rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    )
    seen, kinds = set(), ""
    blank = duplicate = truncated = 0
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if not words:
            blank += 1
            kind = "d"
        elif (role, text) in seen:
            duplicate += 1
            kind = "d"
        elif words[-1] not in ".!?":
            truncated += 1
            kind = kind.upper()
        seen.add((role, text))
        kinds += kind
    numbers = {r[0] for r in rows} - {None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    gaps = min(gaps, 2**63 - 1)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = one_by_one(kinds) if rows else (0, "")
    lines, last, left = [], "", list(rows)
    for edit in audit:
        role, text = ("user" if last != "u" else "assistant"), ""
        if edit != "I":
            _, own, text = left.pop(0)
            role = own if edit == "K" else role
        if edit != "D":
            lines.append(f"{role}:{text}")
            last = role[0]
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha), lines


ODD = [
    (None, 1, "user", "no conversation.", 1, 9, "x"), (None, None, None, None, None, None, None),
    (None, None, "assistant", "No turn!", 1, 1, "y"), (None, 1, "user", "no conversation.", 1, 9, "x"),
    (1, 0, "user", "Hi.", 1, 1, ""), (1, 0, "user", "Hi.", 1, 1, ""), (1, 0, "user", "Hi.", 1, 1, ""),
    (2, 5, "assistant", " \t\n", 1, 1, ""), (2, 3, "", "No role", 1, 1, ""), (2, 4, "tool", "é?", 1, 1, ""),
    (3, -(2**63), "user", "first.", 1, 1, ""), (3, 2**63 - 1, "assistant", "last. ", 1, 1, ""),
    (4, 1, "system", "S.", 1, 1, ""), (4, 2, "system", "S.", 1, 1, ""), (4, 2, "user", "s." * 9000, 1, 1, ""),
    (4, None, "assistant", "A\x0b", 1, 1, ""), (4, None, None, "B", 1, 1, ""),
] + [(5, i, "user" if i % 3 else "assistant", f"turn {i % 40}.", 1, 1, "") for i in range(700)] + [
    (i, 0, None, None, None, None, None) for i in range(6, 60)
]


def test_odd_rows(spark):
    """Conversation 5 is cut over partitions; others have nothing but a dropped turn."""
    rows = spark.createDataFrame(ODD, SCHEMA).repartition(5)
    by_conv = damaged(ODD)
    want = {conv: plain(conv, turns) for conv, turns in by_conv.items()}
    assert any(not turns for turns in by_conv.values())
    turned = conversations.turns(conversations.damaged(rows))
    got = conversations.repairs(turned)
    assert unordered(got.collect()) == unordered(w[0] for w in want.values())
    lines = defaultdict(list)
    for r in sorted(conversations.repaired(turned, got).collect(), key=lambda r: r.n):
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    assert lines == {conv: made for conv, (_, made) in want.items() if made}
    plainly = defaultdict(list)
    for conv, turn, role, text, *_ in ODD:
        plainly[conv].append((turn, " " if role is None else role, " " if text is None else text))
    undamaged = conversations.repairs(conversations.turns(rows.select("conv_id", "turn", "role", "text")))
    assert unordered(undamaged.collect()) == unordered(plain(c, t)[0] for c, t in plainly.items())


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repairs(conversations.turns(conversations.damaged(none))).count() == 0


def test_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    rows = [tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()]
    got = queries.op12_conversation_repair(spark, SF_DIR)
    assert got.columns == [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ]
    want = [plain(conv, turns)[0] for conv, turns in damaged(rows).items()]
    assert unordered(got.collect()) == unordered(want)


@pytest.mark.parametrize("cuts", [(1,), (3, 4), (100, 350)])
def test_pieces_join(cuts):
    """The result doesn't depend on where partitions cut a conversation."""
    turns = damaged(ODD)[5]
    turns.sort(key=lambda r: r[0])
    seen, pieces = set(), []
    bounds = [0, *cuts, len(turns)]
    for part, (a, b) in enumerate(itertools.pairwise(bounds)):
        piece = conversations.Piece(5, part, True)
        for turn, role, text in turns[a:b]:
            piece.add(turn, role, text, 1, (role, text) in seen)
            seen.add((role, text))
        pieces.append(conversations._summary(piece))
    table = pa.Table.from_pylist(pieces[::-1], conversations._SUMMARY)
    got = conversations._joined(table).to_pylist()[0]
    assert tuple(got.values()) == plain(5, turns)[0][:-1]
