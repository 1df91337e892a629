"""SQL that computes the expected result of each query from the source rows.

Pages, figures and links are derived from the turns themselves, not by
splitting the paginated text again.
"""

from __future__ import annotations

from quire.functions.text import WHITESPACE
from quire.operators.metadata import UNREADABLE_CHECKSUM
from quire.operators.status import EMPTY_RENDER
from workload.fixtures import (
    IDS_PER_VOLUME,
    MODES,
    OVERSIZE,
    PREAMBLE,
    RULE,
    TURNS_PER_DOCUMENT,
)

WS = f"'{WHITESPACE}'"
NL2 = "chr(10)||chr(10)"
SHORT = (
    "'pages incomplete: '||recovered||' of '||expected||' came back'"
)


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


_MODE = "case turn % {n} {cases} end".format(
    n=len(MODES), cases=" ".join(f"when {i} then '{m}'" for i, m in enumerate(MODES))
)

# t: one row per turn.  f: one row per document.  p: pages.  g: figures.
BASE = f"""
t as (
  select *, min(turn) over w as first_turn, max(turn) over w as last_turn,
         count(*) over w as n
  from (
    select conv_id, conv_id % 10 as cls, turn, turn // {TURNS_PER_DOCUMENT} as vol, role, text,
      'd' || (conv_id % 5) || '/doc' || (conv_id // 5)
        || case when turn // {TURNS_PER_DOCUMENT} > 0
             then '-' || (turn // {TURNS_PER_DOCUMENT}) else '' end || '.pdf' as rel_key,
      '_page_' || turn || '_Figure_10.jpeg' as k10,
      '_page_' || turn || '_Figure_2.jpeg' as k2
    from conversations)
  window w as (partition by rel_key)),
tb as (
  select *, text || case when role = 'assistant'
      then {NL2} || '![](' || k10 || ')' || {NL2} || '![](' || k2 || ')' else '' end as body
  from t where cls not in (1, 7) or turn < last_turn),
f as (
  select conv_id, cls, rel_key, '/in/' || rel_key as path,
    case when cls = 9 then {OVERSIZE} else 1000 * sum(length(text)) end::bigint as size_bytes,
    case when cls = 2 then 1 else count(*) end::bigint as page_count,
    'sha256:' || sha256(string_agg(text, '' order by turn)) as checksum,
    string_agg(text, chr(12) order by turn) as content,
    count(*)::bigint as n,
    regexp_replace(rel_key, '([^/]*)\\.pdf$', '\\1/\\1.md') as output_path
  from t group by conv_id, cls, rel_key)
"""

PAGES = f"""
p as (
  select rel_key, cls, conv_id, (row_number() over (partition by rel_key order by turn) - 1)::bigint as pos,
    (turn + 1)::bigint as page_no,
    case when cls = 6 then ''
      when cls = 4 and turn = first_turn then '{PREAMBLE}' || {NL2} || {strip("body")}
      else {strip("body")} end as text
  from tb where cls in (0, 1, 4, 5, 6, 7)
  union all
  select rel_key, 2, conv_id, 0::bigint, 1::bigint, {strip(f"string_agg(body, {NL2} order by turn)")}
  from tb where cls = 2 group by rel_key, conv_id)
"""

FIGURES = f"""
gi as (
  select rel_key, cls, turn, turn + 1 as page_no, 10 as block_id, k10 as img_key,
    cls not in (5, 7) as saved from tb
  where role = 'assistant' and cls in (0, 1, 2, 4, 5, 7)
  union all
  select rel_key, cls, turn, turn + 1, 2, k2, true from tb
  where role = 'assistant' and cls in (0, 1, 2, 4, 5, 7)),
g as (
  select *, case when saved then row_number() over
      (partition by rel_key, saved order by page_no, block_id, img_key) end as figure_no,
    case when {_MODE} in ('RGB', 'RGBA') then {_MODE}
         when {_MODE} in ('LA', 'PA') or ({_MODE} = 'P' and turn % 2 = 1) then 'RGBA'
         else 'RGB' end as png_mode
  from gi),
gl as (
  select *, './figures/figure_' || figure_no || '_page' || page_no || '.png' as link from g)
"""


def relinked(rewrite: bool, remove: bool) -> str:
    """Pages with links set: composed from text and links, never by replacing."""

    def mark(key: str, link: str) -> str:
        here = f"coalesce('![](' || {link} || ')', {{gone}})"
        gone = "''" if remove else f"'![](' || {key} || ')'"
        if not rewrite:
            return f"case when {link} is null then {gone} else '![](' || {key} || ')' end"
        return here.format(gone=gone)

    return f"""
lb as (
  select tb.*, case when role = 'assistant' then
      text || {NL2} || {mark("tb.k10", "a.link")} || {NL2} || {mark("tb.k2", "b.link")}
      else text end as lbody
  from tb
  left join gl a on a.rel_key = tb.rel_key and a.img_key = tb.k10
  left join gl b on b.rel_key = tb.rel_key and b.img_key = tb.k2),
lp as (
  select rel_key, cls, (row_number() over (partition by rel_key order by turn) - 1)::bigint as pos,
    (turn + 1)::bigint as page_no,
    case when cls = 6 then ''
      when cls = 4 and turn = first_turn then '{PREAMBLE}' || {NL2} || {strip("lbody")}
      else {strip("lbody")} end as text
  from lb where cls in (0, 1, 4, 5, 6, 7)
  union all
  select rel_key, 2, 0::bigint, 1::bigint, {strip(f"string_agg(lbody, {NL2} order by turn)")}
  from lb where cls = 2 group by rel_key)
"""


JUDGED = f"""
s as (
  select f.rel_key, f.cls, f.conv_id, f.checksum, f.output_path, f.page_count as expected,
    coalesce(r.recovered, 0)::bigint as recovered, coalesce(r.has_content, false) as has_content,
    case when cls = 3 then 'converter failed'
         when cls = 8 or (cls in (1, 7) and n = 1) then '{EMPTY_RENDER}' end as error,
    x.detail as figure_error
  from f
  left join (select rel_key, count(*) as recovered, bool_or(text <> '') as has_content
             from p group by rel_key) r using (rel_key)
  left join (select rel_key, 'figures without an image (' || count(*) || '): '
               || string_agg('''' || img_key || '''', ', ' order by page_no, block_id) as detail
             from g where not saved group by rel_key) x using (rel_key)
  where cls <> 9),
s2 as (
  select *, case when recovered > 0 and recovered < expected then {SHORT} end as page_error from s),
s3 as (
  select *, page_error is not null or figure_error is not null as degraded,
    case when recovered = 0 or not has_content then 'failed'
         when page_error is not null or figure_error is not null then 'partial'
         when error is null then 'completed' else 'failed' end as status
  from s2),
s4 as (
  select * exclude (error), case when status <> 'completed' then
      nullif(concat_ws('; ', error, page_error, figure_error), '') end as error from s3)
"""

DOC_ROWS = f"""
dr as (
  select rel_key, conv_id, checksum, output_path, recovered, status, error from s4
  union all
  select rel_key, conv_id, checksum, output_path, 0, 'failed',
    'too large: ' || printf('%.2f', size_bytes / 1048576.0) || ' MB, limit 500.0 MB'
  from f where size_bytes / 1048576.0 > 500),
md as (
  select rel_key as key, status, coalesce(checksum, '{UNREADABLE_CHECKSUM}') as checksum,
    'converter' as model, 'custom' as backend, output_path, recovered::bigint as pages, error,
    'fp-now' as fingerprint, conv_id
  from dr)
"""

PRIOR = """
pi as (
  select conv_id, rel_key, case when conv_id % 5 = 0 then 'partial' else 'completed' end as status,
    case when conv_id % 3 = 1 then 'sha256:' || sha256('old' || conv_id) else checksum end as checksum,
    case when conv_id % 7 = 0 then 'fp-old' else 'fp-now' end as fingerprint, output_path
  from f where conv_id % 3 <> 2),
pl as (
  select f.*, conv_id % 3 = 0 and conv_id % 5 <> 0 and conv_id % 7 <> 0 and conv_id % 11 <> 0 as skip
  from f)
"""

OLD = """
old as (
  select rel_key as key, status, checksum, 'converter' as model, 'custom' as backend, output_path,
    1::bigint as pages, null::varchar as error, fingerprint from pi
  union all
  select 'gone/' || rel_key, status, checksum, 'converter', 'custom', 'gone/' || output_path,
    1::bigint, null::varchar, fingerprint from pi where conv_id % 4 = 0)
"""

SPECS = """
sp as (
  select *, case conv_id % 6 when 0 then '0-' || page_count when 1 then '1,0'
    when 2 then page_count || '-0' when 4 then ' 0, 2-3 ,2' when 5 then 'a' end as spec
  from f),
ids as (
  select rel_key, unnest(generate_series(0, page_count)) as page_id from sp where conv_id % 6 = 0
  union all select rel_key, unnest([0, 1]) from sp where conv_id % 6 = 1
  union all select rel_key, unnest([0, 2, 3]) from sp where conv_id % 6 = 4)
"""

VARIED = """
v as (
  select '/in/' || case conv_id % 3 when 0 then 'ocr' when 1 then 'ocr-notes' else 'sub/ocr' end
    || '/' || regexp_replace(rel_key, '\\.pdf$', '')
    || case conv_id % 4 when 0 then '.pdf' when 1 then '.PDF' when 2 then '.jpg' else '' end as path,
    conv_id, size_bytes
  from f)
"""

BOOKS = f"""
b as (
  select doc_id, source || '/v' || (doc_id // {IDS_PER_VOLUME}) || '.pdf' as rel_key,
    doc_id % {IDS_PER_VOLUME} as page_id, text,
    '_page_' || (doc_id % {IDS_PER_VOLUME}) || '_Figure_0.jpeg' as k
  from documents),
bn as (
  select *, (row_number() over (partition by rel_key order by page_id) - 1)::bigint as pos,
    sum((page_id % 3 = 0)::int) over (partition by rel_key order by page_id) as no from b)
"""


def size_text(x: str) -> str:
    steps = "".join(
        f"when {x} < {1024 ** (i + 1)} then printf('%.1f', {x}::double / {1024**i}) || ' {u}' "
        for i, u in enumerate(("B", "KB", "MB", "GB"))
    )
    return f"case {steps} else printf('%.1f', {x}::double / {1024**4}) || ' TB' end"


def q(select: str, *ctes: str) -> str:
    return "with " + ",\n".join(c.strip() for c in (BASE, *ctes)) + "\n" + select.strip()


PG, FG = (PAGES,), (PAGES, FIGURES)
JD = (PAGES, FIGURES, JUDGED)
MD = (*JD, DOC_ROWS)

SPOILED = """
spoiled as (
  select * replace (
    case when key like 'd0/%' then replace(checksum, 'sha256:', 'md5:')
         when key like 'd2/%' then 'sha256:' else checksum end as checksum,
    case when key like 'd3/%1.pdf' then 'partial' else status end as status)
  from md)
"""

RESULTS = """
res as (
  select rel_key, status, output_path from dr
  where rel_key in (select rel_key from pl where not skip)
  union all select rel_key, 'completed', output_path from pl where skip)
"""

REFS = """
refs as (
  select rel_key, pos, page_no, m.i - 1 as ref_no, m.link as link from (
    select rel_key, pos, page_no, unnest(list_zip(range(1, len(l) + 1), l)) as z from (
      select rel_key, pos, page_no,
        regexp_extract_all(text, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1) as l from {src})),
    lateral (select z[1] as i, z[2] as link) m)
"""

META = "key, status, checksum, model, backend, output_path, pages, error, fingerprint"

ORACLES: dict[str, str] = {
    "discover_files": q(
        "select path[5:] as rel_key, size_bytes from v where conv_id % 4 in (0, 1) "
        "and conv_id % 3 <> 0", VARIED),
    "filter_supported": q(
        "select path, size_bytes from v where conv_id % 4 in (0, 1)", VARIED),
    "exclude_output_subtree": q("select path, size_bytes from v where conv_id % 3 <> 0", VARIED),
    "with_relative_key": q(
        "select path, size_bytes, path[5:] as rel_key from v", VARIED),
    "with_checksum": "select doc_id, 'sha256:' || sha256(text) as checksum from documents",
    "size_gate": q(
        "select rel_key, size_bytes, case when size_bytes / 1048576.0 > 500 then 'too large: ' "
        "|| printf('%.2f', size_bytes / 1048576.0) "
        "|| ' MB, limit 500.0 MB' end as size_error from f"),
    "read_index": q(f"select {META} from old", PRIOR, OLD),
    "inventory": q(
        f"select rel_key, regexp_extract(rel_key, '[^/]*$') as name, {size_text('size_bytes')} as size, "
        "case when conv_id % 3 <> 0 then page_count::varchar else '-' end as pages from f"),
    "inventory_totals": q(
        f"select files, total_bytes, {size_text('total_bytes')} as total_size from "
        "(select count(*) as files, coalesce(sum(size_bytes), 0)::bigint as total_bytes from f)"),
    "expand_page_specs": q("select rel_key, page_id::bigint as page_id from ids", SPECS),
    "select_pages": q(
        "select p.rel_key, pos, page_no, text from p join sp using (rel_key) "
        "where spec is null or exists (select 1 from ids "
        "where ids.rel_key = p.rel_key and ids.page_id + 1 = p.page_no)", PAGES, SPECS),
    "run_fingerprint": q(
        """select rel_key, case when conv_id % 6 = 5 then 'not a page selection: a' end as spec_error,
        sha256('{"model":"converter","backend":"custom","force_ocr":'
          || case when conv_id % 2 = 0 then 'true' else 'false' end || ',"pages":'
          || case conv_id % 6 when 0 then '[{"first":0,"last":' || page_count || '}]'
               when 1 then '[{"first":0,"last":1}]' when 2 then '[]'
               when 4 then '[{"first":0,"last":0},{"first":2,"last":3}]'
               else 'null' end || '}') as fingerprint from sp""", SPECS),
    "plan_run": q(
        "select rel_key, checksum, case when skip then 'skip' else 'convert' end as action, "
        "case when skip then output_path end as cached_path from pl", PRIOR),
    "pending": q("select rel_key, size_bytes from pl where not skip", PRIOR),
    "cached_outcomes": q(
        "select rel_key, 'completed' as status, output_path from pl where skip", PRIOR),
    "convert": q(
        f"""select f.rel_key, case when f.rel_key not like '%7.pdf' then m.markdown end as markdown,
        case when f.rel_key like '%7.pdf' then 'cannot convert' end as error,
        case when f.rel_key not like '%7.pdf' then n end as page_count,
        case when f.rel_key like '%7.pdf' then 0 else 1 end::bigint as n_images, true as timed
        from f join (select rel_key, string_agg({NL2} || '{{' || (turn - first_turn) || '}}{RULE}'
          || {NL2} || text, '' order by turn) as markdown from t group by rel_key) m using (rel_key)"""),
    "flag_empty_renders": q(
        f"select rel_key, case when cls = 3 then 'converter failed' when cls = 8 "
        f"or (cls in (1, 7) and n = 1) then '{EMPTY_RENDER}' end as error from f where cls <> 9"),
    "split_pages": q("select rel_key, pos, page_no, text from p", PAGES),
    "split_books": "with " + BOOKS + f""" select rel_key, pos, page_id + 1 as page_no,
        {strip("text || case when page_id % 3 = 0 then " + NL2 + " || '![](' || k || ')' else '' end")}
        as text from bn""",
    "fold_preamble": q(
        f"select rel_key, '{PREAMBLE}' as preamble, page_no, text from p where cls = 4 and pos = 0",
        PAGES),
    "unpaginated_fallback": q("select rel_key, page_no, text from p where cls = 2", PAGES),
    "page_stats": q(
        "select rel_key, count(*) as page_count, bool_or(text <> '') as has_content, "
        "min(page_no) as first_page, max(page_no) as last_page from p group by rel_key", PAGES),
    "page_numbers": q(
        "select rel_key, string_agg(page_no::varchar, ',' order by pos) "
        "as page_numbers from p group by all", PAGES),
    "flat_text": q(
        f"select rel_key, string_agg(text, {NL2} order by pos) as text "
        "from p where text <> '' group by all", PAGES),
    "assemble_body": q(
        f"""select f.rel_key, coalesce(body, '*[OCR Failed]*' || chr(10)) as body
        from f left join (select rel_key,
          string_agg('## Page ' || page_no || {NL2} || text || {NL2}, '' order by pos) as body
          from p group by all) x using (rel_key) where cls <> 9""", PAGES),
    "parse_body": q("select rel_key, pos, page_no, text from p", PAGES),
    "expected_pages": q(
        "select rel_key, case conv_id % 6 when 0 then page_count + 1 when 1 then 2 when 2 then null "
        "when 4 then 3 else page_count end::bigint as expected from sp", SPECS),
    "flag_shortfall": q("select rel_key, recovered, expected, page_error from s2", *JD),
    "classify_status": q("select rel_key, recovered, degraded, status from s3", *JD),
    "compose_error": q("select rel_key, status, error from s4", *JD),
    "parse_figure_key": q(
        "select rel_key, img_key, saved, png_mode, page_no::bigint as page_no, "
        "block_id::bigint as block_id from g", *FG),
    "number_figures": q(
        "select rel_key, img_key, saved, figure_no::bigint as figure_no from g", *FG),
    "figure_links": q("select rel_key, img_key, link from gl", *FG),
    "figure_failures": q(
        "select rel_key, count(*) as failed, 'figures without an image (' || count(*) "
        "|| '): ' || string_agg('''' || img_key || '''', ', ' order by no) as detail from "
        "(select *, row_number() over (partition by rel_key order by page_no, block_id, img_key) as no "
        "from g where not saved) group by all", *FG),
    "rewrite_links": q(
        "select rel_key, pos, page_no, text from lp", *FG, relinked(True, False)),
    "strip_links": q(
        "select rel_key, pos, page_no, text from lp", *FG, relinked(False, True)),
    "extract_image_refs": q(
        "select rel_key, pos, page_no, ref_no::bigint as ref_no, link from refs",
        PAGES, REFS.format(src="p")),
    "relink_pages": q(
        "select rel_key, pos, page_no, text from lp", *FG, relinked(True, True)),
    "relink_books": "with " + BOOKS + f""" select rel_key, pos, page_id + 1 as page_no,
        {strip("text || case when page_id % 3 = 0 then " + NL2 + " || '![](./figures/figure_' || no || '_page' || (page_id + 1) || '.png)' else '' end")}
        as text from bn""",
    "process_documents": q(
        "select rel_key, expected, recovered, has_content, degraded, status, error, "
        "coalesce(c, 0)::bigint as figures_saved from s4 left join "
        "(select rel_key, count(*) as c from g where saved group by rel_key) using (rel_key)", *JD),
    "document_figures": q(
        "select rel_key, page_no::bigint as page_no, block_id::bigint as block_id, img_key, saved, "
        "png_mode, figure_no::bigint as figure_no, link from gl", *FG),
    "output_paths": q("select rel_key, output_path from f"),
    "doc_metadata": q(f"select {META} from md", *MD),
    "upsert_index": q(
        f"select {META} from md union all select {META} from old "
        "where key not in (select key from md)", *MD, PRIOR, OLD),
    "compact_index": q(
        f"select {META} from md union all select {META.replace('error', chr(39) + 'stale' + chr(39) + ' as error')} "
        "from old where key not in (select key from md)", *MD, PRIOR, OLD),
    "write_run": q(
        """select 'pages' as name, rel_key as key, sha256(string_agg(
            pos || '|' || page_no || '|' || text, chr(10) order by pos)) as digest from lp group by rel_key
        union all
        select 'figures', rel_key, sha256(string_agg(img_key || '|' || coalesce(figure_no::varchar, '-')
            || '|' || coalesce(link, '-'), chr(10) order by img_key)) from gl group by rel_key
        union all
        select name, rel_key, sha256(concat_ws('|', status, checksum, output_path, recovered,
            coalesce(case when status <> 'completed' then error end, '-')))
        from s4, (values ('metadata'), ('index')) as n(name)""",
        *JD, relinked(True, True)),
    "export_tree": q(
        f"""select output_path as path, strlen(body)::bigint as size_bytes,
          'sha256:' || sha256(body) as checksum
        from (select f.output_path, coalesce(body, '*[OCR Failed]*' || chr(10)) as body
          from f left join (select rel_key,
            string_agg('## Page ' || page_no || {NL2} || text || {NL2}, '' order by pos) as body
            from lp group by all) x using (rel_key) where cls <> 9)
        union all
        select f.output_path[:-(length(regexp_extract(f.output_path, '[^/]*$')) + 1)] || link[3:],
          strlen(img_key)::bigint, 'sha256:' || sha256(img_key) from gl join f using (rel_key) where saved""",
        *FG, relinked(True, True)),
    "run_outcome": q(
        """select count(*) filter (status = 'completed') as completed,
        count(*) filter (status = 'partial') as partial, count(*) filter (status = 'failed') as failed,
        count(*) as total, case when count(*) filter (status <> 'completed') > 0 then 1 else 0 end::bigint
        as exit_code from res""", *MD, PRIOR, RESULTS),
    "written_outputs": q(
        "select rel_key, output_path from res where status <> 'failed'", *MD, PRIOR, RESULTS),
    "dangling_links": q(
        "select rel_key, pos, page_no, ref_no::bigint as ref_no, link from refs "
        "where link like '\\_page\\_%' escape '\\'",
        *FG, relinked(True, False), REFS.format(src="lp")),
    "page_tag_mismatch": q(
        "select rel_key, pos, page_no, ref_no::bigint as ref_no, link, tag_page from (select *, "
        "regexp_extract(link, '_page(\\d+)\\.png$', 1)::bigint as tag_page from refs) "
        "where tag_page <> page_no", *FG, relinked(True, True), REFS.format(src="lp")),
    "expectation_diff": q(
        """select * from (select rel_key, e.pages as expected_pages, e.status as expected_status,
          m.pages as actual_pages, m.status as actual_status,
          case when m.status is null then 'missing' when e.status is null then 'unexpected'
            when (e.pages is not null and e.pages is distinct from m.pages)
              or e.status <> m.status then 'different' end as problem
        from (select rel_key, case when conv_id % 11 <> 0 then page_count end as pages,
                case when conv_id % 10 = 3 then 'failed' else 'completed' end as status
              from f where conv_id % 17 <> 3) e
        full join (select key as rel_key, pages, status from md where key not like 'd4/%7.pdf') m
          using (rel_key)) where problem is not null""", *MD),
    "figure_diff": q(
        """select rel_key, figure_no::bigint as figure_no, expected_page::bigint as expected_page,
          actual_page::bigint as actual_page
        from (select rel_key, 2 * i + j as figure_no, turn + 1 as expected_page
              from (select *, row_number() over (partition by rel_key order by turn) - 1 as i
                    from t where role = 'assistant' and cls not in (3, 6, 8, 9)), (values (1), (2)) v(j)) e
        full join (select rel_key, figure_no, page_no as actual_page from g where saved) a
          using (rel_key, figure_no)
        where expected_page is distinct from actual_page""", *FG),
    "bad_checksums": q(
        "select key, checksum from spoiled where checksum not like 'sha256:_%'", *MD, SPOILED),
    "index_vs_metadata": q(
        """select * from (select key, case when m.status is null then 'no metadata'
            when i.status is null then 'not in index'
            when i.status <> m.status or i.checksum <> m.checksum then 'different' end as problem
          from (select * from spoiled where key not like 'd1/%3.pdf') i full join (select * from md where key not like 'd2/%0.pdf') m using (key))
        where problem is not null""", *MD, SPOILED),
    "planned_collisions": q(
        """select rel_key, case when conv_id % 8 = 0 then 'skip' else 'convert' end as action,
            case when conv_id % 8 = 4 then 'output path belongs to '
              || regexp_replace(rel_key, 'pdf$', 'PDF') end as path_error from f
        union all select regexp_replace(rel_key, 'pdf$', 'PDF'), 'convert',
            case when conv_id % 8 = 0 then 'output path belongs to ' || rel_key end
        from f where conv_id % 4 = 0"""),
    "path_collisions": q(
        """select output_path, 2::bigint as documents,
          regexp_replace(rel_key, 'pdf$', 'PDF') as first_key, rel_key as last_key
        from f where conv_id % 4 = 0"""),
}
