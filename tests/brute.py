"""Plain Python versions of the rules, for comparison on small inputs."""

from __future__ import annotations

import re

RULE = "-" * 48


def pages_of(text: str | None) -> list[tuple[int, str]]:
    """Read the text line by line; a line that is a boundary starts a page."""
    if text is None or not text.strip():
        return []
    lead: list[str] = []
    found: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        boundary = re.fullmatch(r"[ \t]*\{([0-9]+)\}---+[ \t]*", line)
        if boundary:
            found.append((int(boundary[1]), []))
        else:
            (found[-1][1] if found else lead).append(line)
    preamble = "\n".join(lead).strip()
    if not found:
        return [(1, preamble)]
    out = [(page_id + 1, "\n".join(lines).strip()) for page_id, lines in found]
    if preamble:
        out[0] = (out[0][0], f"{preamble}\n\n{out[0][1]}" if out[0][1] else preamble)
    return out
