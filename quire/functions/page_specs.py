"""Page selections such as '0-5' or '1,3,5' as sorted, disjoint ranges.

Ranges are the canonical form of a selection: '1,2,3', '3,1,2' and '1-3' give
the same one, its size needs no list of ids, and a huge range stays one struct.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from quire.functions.rows import lower_bound
from quire.functions.text import literal, strip

# --- fixed values: what counts as a whole number in a page selection --------
NUMBER = r"\+?\d+(_\d+)*"
SIGNED = r"[+\-]?\d+(_\d+)*"
# ---------------------------------------------------------------------------

RANGES = "array<struct<first:bigint,last:bigint>>"


def parse_literal(spec: str | None) -> list[tuple[int, int]] | None:
    """Ranges of a selection given as text; ValueError if it cannot be read."""
    if not spec:
        return None
    found = []
    for piece in map(str.strip, spec.split(",")):
        low, dash, high = piece.partition("-")
        low, high = low.strip(), (high if dash else low).strip()
        if not re.fullmatch(NUMBER, low, re.ASCII) or not re.fullmatch(SIGNED, high, re.ASCII):
            raise ValueError(f"not a page selection: {spec!r}")
        if int(low) <= int(high):
            found.append((int(low), int(high)))
    merged: list[tuple[int, int]] = []
    for low, high in sorted(found):
        if merged and low <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(high, merged[-1][1]))
        else:
            merged.append((low, high))
    return merged


def range_literal(ranges: Sequence[tuple[int, int]] | None) -> str:
    """Ranges known on the driver as a SQL constant; null for no selection."""
    if ranges is None:
        return f"cast(null as {RANGES})"
    pairs = ", ".join(f"named_struct('first', {a}L, 'last', {b}L)" for a, b in ranges)
    return f"cast(array({pairs}) as {RANGES})"


def parsed_pieces(spec: str) -> str:
    """array<struct<first,last>> of the comma separated pieces; null for no selection.

    A bound that cannot be read is null.
    """

    def number(text: str, pattern: str) -> str:
        valid = f"{text} rlike {literal(f'^{pattern}$')}"
        return f"if({valid}, try_cast(replace({text}, '_', '') as bigint), null)"

    low = strip("substring_index(p, '-', 1)")
    high = strip("regexp_replace(p, '^[^-]*-', '')")
    piece = (
        f"named_struct('first', {number(low, NUMBER)}, 'last', {number(high, SIGNED)})"
    )
    pieces = f"transform(split({spec}, ',', -1), p -> {strip('p')})"
    return f"if({spec} = '', null, transform({pieces}, p -> {piece}))"


def pieces_invalid(pieces: str) -> str:
    return f"coalesce(exists({pieces}, p -> p.first is null or p.last is null), false)"


def merge_pieces(pieces: str) -> str:
    """Sort and merge pieces into disjoint, non-adjacent ranges; 5-3 selects nothing."""
    kept = f"sort_array(filter({pieces}, p -> p.first <= p.last))"
    top = "element_at(acc, -1)"
    grown = f"named_struct('first', {top}.first, 'last', greatest({top}.last, p.last))"
    return f"""
        aggregate({kept}, cast(array() as {RANGES}), (acc, p) -> cast(
          if(size(acc) > 0 and p.first - 1 <= try_element_at(acc, -1).last,
             concat(slice(acc, 1, greatest(size(acc) - 1, 0)), array({grown})),
             concat(acc, array(p))) as {RANGES}))"""


def ranges_size(ranges: str) -> str:
    """How many pages a selection names; null if they are too many for a bigint."""
    own = "try_add(try_subtract(r.last, r.first), 1L)"
    return f"aggregate({ranges}, 0L, (n, r) -> try_add(n, {own}))"


def in_ranges(page_id: str, ranges: str) -> str:
    return f"exists({ranges}, r -> {page_id} between r.first and r.last)"


def in_sorted_ranges(page_id: str, ranges: str) -> str:
    """The same by bisection, for many ranges; null ranges select every page."""
    found = f"get({ranges}, {lower_bound(ranges, 'last', page_id)})"
    return f"({ranges} is null or coalesce({found}.first <= {page_id}, false))"
