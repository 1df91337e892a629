"""DuckDB SQL of those operator queries that SQL can express."""

from __future__ import annotations

GAPS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with cut as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), keyed as (
    select doc_id, ls, list_transform(ls, lambda x: translate(trim(x, {GAPS}),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ks from cut
), lines as (
    select doc_id, unnest(ls) as line, unnest(ks) as key, unnest(range(len(ls))) as pos
    from keyed
), frequent as (
    select key from (select distinct doc_id, key from lines where key <> '')
    group by key having count(*) >= 10
)
select doc_id, count(*) as n_lines,
    count(*) filter (where f.key is not null) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos)
        filter (where f.key is null), '')) as kept_sha256
from lines l left join frequent f on l.key = f.key
group by doc_id
"""

LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = "list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

NGRAM_JACCARD = f"""
with recursive cut as (
    select doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), {LOWER})")} as ws from documents
), sets as (
    select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5
        then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3),
        lambda i: array_to_string(ws[i : i + 4], ' ')) end) as s from cut
), flat as (select doc_id, len(s) as n, unnest(s) as shingle from sets
), pairs as (
    select a.doc_id as x, b.doc_id as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
    from flat a join flat b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
), links as (
    select x, y from pairs where 100 * common >= 75 * (n + m - common)
    union all select y, x from pairs where 100 * common >= 75 * (n + m - common)
), reached as (
    select doc_id, doc_id as other from sets
    union select r.doc_id, l.y from reached r join links l on l.x = r.other
)
select doc_id, len(s)::bigint as n_shingles, low as component_id from sets
join (select doc_id, min(other) as low from reached group by doc_id) using (doc_id)
"""

SUBSTRING_DEDUP = f"""
with cut as (
    select doc_id, {WORDS.format(text="coalesce(text, '')")} as ws from documents
), flat as (
    select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p,
        unnest(list_transform(range(1, len(ws) + 1), lambda i: case when i + 34 <= len(ws)
            then array_to_string(ws[i : i + 34], ' ') end)) as opened from cut
), repeated as (
    select opened from flat where opened is not null group by opened having count(*) > 1
), marked as (
    select doc_id, word, p, max(case when r.opened is not null then p end)
        over (partition by doc_id order by p) as last
    from flat f left join repeated r on f.opened = r.opened
), kept as (
    select doc_id, count(*) filter (p - last <= 34) as gone,
        string_agg(word, ' ' order by p) filter (last is null or p - last > 34) as left_
    from marked group by doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(gone, 0) as n_removed,
    sha256(coalesce(left_, '')) as kept_sha256
from cut left join kept using (doc_id)
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of ASCII characters, bit by bit."""
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::bigint),
        lambda acc, b: list_reduce(range(8), lambda c, i: case when c & 1 = 1
          then xor(c >> 1, 3988292384) else c >> 1 end, xor(acc, b)), 4294967295), 4294967295)"""


PERIODIC_RUNS = f"""
with cut as (
    select doc_id, {WORDS.format(text="coalesce(text, '')")} as ws,
        case when doc_id is not null then {_crc32("doc_id::varchar")} end as h from documents
), given as (
    select doc_id, ws, len(ws) as n, h % 10 = 0 and len(ws) > 0 as made,
        case when len(ws) > 0 then (h // 10) % len(ws) end as a, 3 + (h // 10) % 8 as parts from cut
), flat as (
    select doc_id, n, i, case when made and i >= a
        then ws[a + (i - a) % (1 + (n - a) // parts) + 1] else ws[i + 1] end as word
    from (select *, unnest(range(n)) as i from given)
), matches as (
    select x.doc_id, y.i - x.i as q, x.i from flat x join flat y
    on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n
), stretches as (
    select doc_id, q, min(i) as start, count(*) + q as length from (
        select *, i - row_number() over (partition by doc_id, q order by i) as g from matches)
    group by doc_id, q, g having count(*) + q >= greatest(6, 4 * q)
), runs as (  -- a stretch has its multiples of its smallest period as well
    select doc_id, start, length, min(q) as q from stretches group by all
), listed as (
    select doc_id, count(*) as n_runs,
        arg_min({{'s': start, 'l': length, 'q': q}}, {{'l': -length, 's': start, 'q': q}}) as top,
        string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as printed
    from runs group by doc_id
), kept as (
    select doc_id, string_agg(word, ' ' order by i) as left_ from flat f
    where not exists (select 1 from runs r where r.doc_id = f.doc_id
        and f.i >= r.start + r.q and f.i < r.start + r.length)
    group by doc_id
)
select doc_id, coalesce(n_runs, 0) as n_runs, top.s as start, top.l as length, top.q as period,
    1000 * top.l // top.q as exponent_milli, sha256(coalesce(printed, '')) as runs_sha256,
    sha256(coalesce(left_, '')) as collapsed_sha256
from cut left join listed using (doc_id) left join kept using (doc_id)
"""


def _after(state: str, cost: str, edit: str, line: str | None = None) -> str:
    """A state of the roles so far after an edit; ``t`` has the repaired lines."""
    text = f"{state}.t"
    if line:
        text = f"case when {text} is null then {line} else {text} || chr(10) || {line} end"
    return (
        f"case when {state} is not null then {{'c': {state}.c + {cost}, "
        f"'audit': {state}.audit || '{edit}', 't': {text}}} end"
    )


def _cheapest(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


def _repair() -> str:
    """The turns of a conversation one by one, with the cheapest edits for each state.

    States are those of the roles so far: none (n), system (y), user (u) and
    assistant (a). Edits of equal cost are told apart by their initials.
    """
    key = "coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')"
    crc = _crc32(key)
    own = "f.role || ':' || f.text"
    user, assistant = "'user:' || f.text", "'assistant:' || f.text"
    gone = {x: _after(f"r.{x}", "3", "D") for x in "nyua"}

    def other(state: str, line: str) -> str:
        return f"case when not f.must then {_after(f'r.{state}', '2 + f.truncated::int', 'R', line)} end"

    def kept(state: str, initial: str) -> str:
        made = _after(f"r.{state}", "f.truncated::int", "K", own)
        return f"case when not f.must and f.initial = '{initial}' then {made} end"

    u = _cheapest(gone["u"], *(other(x, user) for x in "nya"), *(kept(x, "u") for x in "nya"))
    a = _cheapest(gone["a"], other("u", assistant), kept("u", "a"))
    y = _cheapest(gone["y"], kept("n", "s"))
    inserted_u = _cheapest("u", *(_after(x, "2", "I", "'user:'") for x in "nya"))
    inserted_a = _cheapest("a", _after("v", "2", "I", "'assistant:'"))
    nothing = "null::struct(c integer, audit varchar, t varchar)"
    return f"""
with recursive raw as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc} % 20 as kind
  from conversations
), rows as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) as copy
  from raw
), placed as (
  select *, trim(text, {GAPS}) as words, left(role, 1) as initial,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth
  from rows
), faults as (
  select *, words = '' as blank, words <> '' and nth > 1 as duplicate,
    words = '' or nth > 1 as must,
    words <> '' and nth = 1 and right(words, 1) not in ('.', '!', '?') as truncated,
    lag(initial) over (partition by conv_id order by pos) || initial as pair
  from placed
), steps as (
  select distinct conv_id, 0::bigint as pos, {{'c': 0, 'audit': '', 't': null::varchar}} as n,
    {nothing} as y, {{'c': 2, 'audit': 'I', 't': 'user:'}} as u,
    {{'c': 4, 'audit': 'II', 't': 'user:' || chr(10) || 'assistant:'}} as a from faults
  union all
  select conv_id, pos, n, y, v, {inserted_a} from (
    select *, {inserted_u} as v from (
      select r.conv_id, f.pos, {gone["n"]} as n, {y} as y, {u} as u, {a} as a
      from steps r join faults f on f.conv_id is not distinct from r.conv_id and f.pos = r.pos + 1))
), counted as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate,
    count(*) filter (truncated) as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from faults group by conv_id
), best as (
  select c.*, {_cheapest("s.n", "s.a")} as b from counted c
  join steps s on s.conv_id is not distinct from c.conv_id and s.pos = c.n
)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank,
  coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(b.c, 0)::bigint as cost, coalesce(b.audit, '') as audit,
  sha256(coalesce(b.t, '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join best on best.conv_id is not distinct from i.conv_id
"""


ORACLES: dict[str, str] = {
    "op5_line_dedup": LINE_DEDUP,
    "op8_ngram_jaccard": NGRAM_JACCARD,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op11_periodic_runs": PERIODIC_RUNS,
    "op12_conversation_repair": _repair(),
}
