"""Figure keys: page and block numbers, output names, and link tokens."""

from __future__ import annotations

from quire.functions.rows import lower_bound
from quire.functions.text import MAX_LONG, literal, long_or, source_page

# --- fixed values: shape of image keys and of figure names ------------------
KEY_PAGE = r"(?i)page[_\-]?(\d+)"
KEY_BLOCK = r"(?d)_(\d+)(?:\.[A-Za-z0-9]+)?$"
FIGURE_LINK = "./figures/figure_%d_page%d.png"
FIGURE_LINK_PAGE = r"^\./figures/figure_\d+_page(\d+)\.png$"
# Image modes that keep their alpha channel, as such or as RGBA; all others lose it.
AS_IS, TO_RGBA, PALETTE, ALPHA, PLAIN = ("RGB", "RGBA"), ("LA", "PA"), "P", "RGBA", "RGB"
# ---------------------------------------------------------------------------


def key_page(key: str) -> str:
    """Page number named by an image key; 1 when it names none."""
    found = f"regexp_extract({key}, {literal(KEY_PAGE)}, 1)"
    return f"if({found} = '', 1L, {source_page(found)})"


def key_block(key: str) -> str:
    """Trailing block number of an image key; 0 when it has none."""
    found = f"regexp_extract({key}, {literal(KEY_BLOCK)}, 1)"
    return f"if({found} = '', 0L, {long_or(found, MAX_LONG)})"


def figure_link(figure_no: str, page_no: str) -> str:
    return f"format_string('{FIGURE_LINK}', {figure_no}, {page_no})"


def png_mode(mode: str, has_transparency: str) -> str:
    """Image mode to encode a PNG with: alpha is kept, everything else is RGB."""
    return (
        f"case when {mode} in {AS_IS} then {mode} "
        f"when {mode} in {TO_RGBA} or ({mode} = '{PALETTE}' and {has_transparency}) then '{ALPHA}' "
        f"else '{PLAIN}' end"
    )


def failure_text(keys: str) -> str:
    """Diagnostic for an array of failed image keys."""
    return (
        f"concat('figures without an image (', cast(size({keys}) as string), '): ', "
        f"array_join(transform({keys}, k -> concat(\"'\", k, \"'\")), ', '))"
    )


def key_token(key: str) -> str:
    """What must stand between the innermost parentheses wherever ``(key)`` occurs.

    Up to the first ')' after the opening one, the text of an occurrence is
    '(' plus the key's own head; the token is the part after its last '('.
    For a key without parentheses the token is the key. So joining keys to
    the tokens of a page on equality finds every occurrence.
    """
    return f"substring_index(concat('(', substring_index({key}, ')', 1)), '(', -1)"


def text_tokens(text: str) -> str:
    """Distinct innermost parenthesised strings of a text."""
    inner = literal(r"\(([^()]*+)\)")
    return f"array_distinct(regexp_extract_all({text}, {inner}, 1))"


def by_key(f: str) -> str:
    """A figure as an entry of its document's table of keys; sorting an array makes the table.

    Of entries with one key the saved one with the lowest number comes first.
    """
    return (
        f"named_struct('img_key', {f}.img_key, 'failed', {f}.link is null, "
        f"'figure_no', {f}.figure_no, 'page_no', {f}.page_no, 'block_id', {f}.block_id, "
        f"'link', {f}.link, 'token', {key_token(f'{f}.img_key')})"
    )


def has_odd_keys(keys: str) -> str:
    """Whether a key has a parenthesis, so that its occurrences have several pieces."""
    return f"exists({keys}, k -> k.img_key rlike '[()]')"


def linked_text(text: str, keys: str, odd: str) -> str:
    """Point the keys of saved figures at their links; drop markup of failed ones.

    A saved figure's '(key)' is replaced wherever it stands; of a failed one
    every whole '![alt](key)' goes. ``keys`` is a table of ``by_key``, ``odd``
    whether it has odd keys.

    The text is cut once, at its innermost parentheses. What stands in each pair
    is looked up in the table by bisection, and the pieces are put together
    again, so the work follows the length of the text. Keys with parentheses,
    and texts with a parenthesis inside an alt text, are handled key by key.
    """
    inner = literal(r"\(([^()]*+)\)")
    crossing = literal(r"!\[[^\]()]*+[()]")
    markup = literal(r"!\[[^\]]*+\]\z")
    found = (
        f"transform(regexp_extract_all({text}, {inner}, 1), t -> named_struct('t', t, 'k', "
        f"get(filter(array(get({keys}, {lower_bound(keys, 'img_key', 't')})), k -> k.img_key = t), 0)))"
    )
    piece = (
        "case when f.t is null then g "
        f"when f.k.failed and g rlike {markup} then regexp_replace(g, {markup}, '') "
        "else concat(g, '(', if(f.k.failed is null or f.k.failed, f.t, f.k.link), ')') end"
    )
    once = f"array_join(zip_with(split({text}, {inner}, -1), {found}, (g, f) -> {piece}), '')"
    tokens = text_tokens(text)
    own = (
        f"transform(array({tokens}), ts -> sort_array(transform("
        f"filter({keys}, k -> array_contains(ts, k.token)), k -> {_hit('k')})))[0]"
    )
    return (
        f"case when size({keys}) = 0 or instr({text}, '(') = 0 then {text} "
        f"when {odd} or {text} rlike {crossing} then {_key_by_key(text, own)} else {once} end"
    )


def _hit(k: str) -> str:
    """An entry in the order in which ``_key_by_key`` takes them: saved ones and long keys first."""
    return (
        f"named_struct('failed', {k}.failed, 'longest', -length({k}.img_key), "
        f"'figure_no', {k}.figure_no, 'page_no', {k}.page_no, 'block_id', {k}.block_id, "
        f"'img_key', {k}.img_key, 'link', {k}.link)"
    )


def _key_by_key(text: str, hits: str) -> str:
    """The same with a pass over the text for each of ``hits``."""
    # A key may itself hold "\E", which would end the quoted part of the pattern.
    unquote, requote = literal(r"\E"), literal(r"\E\\E\Q")
    ahead, behind = literal(r"!\[[^\]]*\]\(\Q"), literal(r"\E\)")
    quoted = f"replace(h.img_key, {unquote}, {requote})"
    markup = f"concat({ahead}, {quoted}, {behind})"
    return (
        f"aggregate({hits}, {text}, (acc, h) -> if(h.failed, "
        f"regexp_replace(acc, {markup}, ''), "
        "replace(acc, concat('(', h.img_key, ')'), concat('(', h.link, ')'))))"
    )
