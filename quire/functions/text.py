"""Text expressions shared by every operator, as Spark SQL.

Functions here and in the sibling modules take and return SQL expressions, so
that whole array transformations stay one readable expression of built-ins.
"""

from __future__ import annotations

# Every code point Unicode counts as white space; SQL trim() only knows U+0020.
WHITESPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# --- fixed values: patterns of the paginated text format -------------------
# A page boundary is a whole line "{<id>}---". "d" keeps Java's ^ and $ at \n.
PAGE_BOUNDARY = r"(?md)^[ \t]*\{(\d+)\}-{3,}[ \t]*$"
PAGE_HEADER = rf"(?md)^## Page (\d+)[{WHITESPACE}]*$"
IMAGE_LINK = r"!\[[^\]]*\]\(([^)]*)\)"
# ---------------------------------------------------------------------------

MAX_LONG = (1 << 63) - 1


def literal(value: str) -> str:
    """A Python string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def long_or(x: str, otherwise: int) -> str:
    """A number as bigint; numbers beyond its range become ``otherwise``."""
    return f"coalesce(try_cast({x} as bigint), {otherwise}L)"


def strip(x: str) -> str:
    """Trim every kind of white space from both ends."""
    return f"btrim({x}, {literal(WHITESPACE)})"


def is_blank(x: str) -> str:
    """True for null text and for text of nothing but white space."""
    stripped = strip(f"coalesce({x}, '')")
    return f"({stripped} = '')"


def source_page(page_id: str) -> str:
    """0-based page id to 1-based page number; ids beyond bigint saturate."""
    return f"greatest(1L, {long_or(page_id, MAX_LONG - 1)} + 1L)"


def human_size(size: str) -> str:
    """Bytes as '1.5 KB' (one decimal, ties to even, 1024 steps up to TB)."""

    def text(power: int, unit: str) -> str:
        return f"format_string('%.1f {unit}', bround({size} / {1024**power}D, 1))"

    steps = " ".join(
        f"when {size} < {1024 ** (i + 1)}L then {text(i, unit)}"
        for i, unit in enumerate(("B", "KB", "MB", "GB"))
    )
    return f"case when {size} is null then null {steps} else {text(4, 'TB')} end"
