"""DuckDB SQL of the operators that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"


def _bucket(v: str) -> str:
    return f"case when {v} < 64 then {v} else (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)::int)::bigint end"


def _value(b: str) -> str:
    return f"case when {b} < 64 then {b} else ({b} - 32 * ({b} // 32 - 1)) << ({b} // 32 - 1)::int end"


def quality(fences: dict[str, tuple[bool, int, int]], min_words: int, max_repeat: int, min_group: int) -> str:
    stacked = " union all ".join(f"select lang, source, '{m}' as measure, {_bucket('q_' + m)} as bucket from q where not base_failed" for m in fences)
    columns = ", ".join(
        f"max(case when measure = '{m}' then q2 + {spreads} * (q3 - q2) + {slack} end) as high_{m}, "
        f"max(case when measure = '{m}' then {f'q2 - {spreads} * (q2 - q1) - {slack}' if low else '0'} end) as low_{m}" for m, (low, spreads, slack) in fences.items())
    inside = " and ".join(f"q_{m} between f.low_{m} and f.high_{m}" for m in fences)
    names = ", ".join(f"{{c}}.low_{m}, {{c}}.high_{m}" for m in fences)
    best = ", ".join(f"arg_max({side}_{m}, level) as {side}_{m}" for m in fences for side in ("low", "high"))
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, lang, source from documents),
w as (select *, regexp_extract_all(t, '{_WORD}') as ws, [l for l in string_split(t, chr(10)) if regexp_matches(l, '{_WORD}')] as ls from d),
tokens as (select rid, unnest(ws) as a, generate_subscripts(ws, 1) as i from w),
wins as (select rid, i, a, lead(a) over s as b, lead(a, 2) over s as c from tokens window s as (partition by rid order by i)),
hits as (select rid, i from (select *, count(*) over (partition by rid, a, b, c) as n from wins where c is not null) where n > 1),
covered as (select rid, sum(least(3, coalesce(nx - i, 3)))::bigint as n from (select rid, i, lead(i) over (partition by rid order by i) as nx from hits) group by rid),
m as (select rid, doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
      (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
      coalesce(n, 0)::bigint as n_repeat_words, greatest(len(ls), 1) as n_lines, greatest(len(ws), 1) as n1 from w left join covered using (rid)),
q as (select *, n_words < {min_words} or 100 * n_repeat_words > {max_repeat} * n_words as base_failed, 100 * word_chars // n1 as q_word_len,
      1000 * n_symbols // n1 as q_symbols, 1000 * n_dup_lines // n_lines as q_dup_lines, 1000 * n_repeat_words // n1 as q_repeats from m),
sketch as (select lang, source, measure, bucket, count(*) as n from ({stacked}) group by all),
merged as (select level, case when level > 0 then lang end as k_lang, case when level > 1 then source end as k_source, measure, bucket, sum(n)::bigint as n
           from sketch, (values (0), (1), (2)) v(level) group by all),
ranked as (select *, sum(n) over (partition by level, k_lang, k_source, measure order by bucket) as upto,
           sum(n) over (partition by level, k_lang, k_source, measure) as total from merged),
quartiles as (select level, k_lang, k_source, measure, max(total) as docs, min(case when 4 * upto >= total then {_value('bucket')} end) as q1,
              min(case when 2 * upto >= total then {_value('bucket')} end) as q2, min(case when 4 * upto >= 3 * total then {_value('bucket')} end) as q3 from ranked group by all),
fences as (select level, k_lang, k_source, max(docs) as docs, {columns} from quartiles group by all),
f as (select g.lang, g.source, {best} from (select distinct lang, source, level from sketch, (values (0), (1), (2)) v(level)) g
      join (select level as lv, k_lang, k_source, docs, {names.format(c='fences')} from fences) p
      on level = lv and (case when level > 0 then lang end) is not distinct from k_lang and (case when level > 1 then source end) is not distinct from k_source
      where docs >= {min_group} or level = 0 group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce({inside}, true) as kept
from q left join f on q.lang is not distinct from f.lang and q.source is not distinct from f.source"""


def line_runs(min_words: int) -> str:
    """Lines of maximal stretches of ``min_words`` words or more that equal an earlier stretch line by line, by all pairs of equal lines."""
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, count(*) as copies from documents group by all),
split as (select doc_id, t, unnest(string_split(t, chr(10))) as l, generate_subscripts(string_split(t, chr(10)), 1) - 1 as line from d),
full_lines as (select doc_id, t, line, l, len(regexp_extract_all(l, '{_WORD}')) as words, row_number() over (partition by doc_id, t order by line) as pos
               from split where regexp_matches(l, '{_WORD}')),
placed as (select *, row_number() over (order by doc_id, t, pos) as place, dense_rank() over (order by doc_id, t) as doc from full_lines),
equal as (select b.doc_id, b.t, b.pos, b.words, b.pos - a.pos as apart, a.doc as from_doc, b.doc from placed a join placed b on a.l = b.l and a.place < b.place),
stretches as (select *, pos - row_number() over (partition by from_doc, doc, apart order by pos) as stretch from equal),
runs as (select doc_id, t, min(pos) as first, max(pos) as last from stretches group by doc_id, t, from_doc, doc, apart, stretch having sum(words) >= {min_words}),
gone as (select distinct doc_id, t, unnest(range(first, last + 1)) as pos from runs),
flagged as (select s.doc_id, s.t, s.line, s.l, g.pos is not null as gone from split s left join full_lines f on s.doc_id is not distinct from f.doc_id and s.t = f.t and s.line = f.line
            left join gone g on f.doc_id is not distinct from g.doc_id and f.t = g.t and f.pos = g.pos),
per as (select doc_id, t, count(*) as n_lines, count(*) filter (gone) as n_deleted, coalesce(string_agg(line::varchar, ',' order by line) filter (gone), '') as deleted_lines,
        coalesce(string_agg(l, chr(10) order by line) filter (not gone), '') as rest from flagged group by doc_id, t)
select per.doc_id, n_lines, n_deleted, deleted_lines, sha256(rest) as text_sha256 from per join d using (t) , range(copies) where per.doc_id is not distinct from d.doc_id"""


def warc() -> str:
    return """
with h as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as x, max(page_id) over (partition by coalesce(html, '')) as last from pages)
select page_id, strlen(t)::bigint as payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(x, (5 * (k // 4) + 1)::int, 5))::bigint >> (15 - 5 * (k % 4))::int) & 31) + 1)::int, 1) for k in range(32)], '') as payload_digest,
  case when last is null or page_id is not distinct from last then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from last then last end as refers_to from h"""


def interactions() -> str:
    return rf"""
with marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as ws from documents),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, [letter for letter in [
      case when len(ws) < 200 then 'A' end, case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 'B' end,
      case when 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 3 * length(t) then 'C' end,
      case when regexp_matches(t, '[#$%&*|]') then 'D' end,
      case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' end] if letter is not null] as fails from d left join marks using (doc_id)),
sets as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || e.x || g.x as filter_order from letters a, letters b, letters c, letters e, letters g
           where len(list_distinct([a.x, b.x, c.x, e.x, g.x])) = 5),
steps as (select filter_order, step, filter_order[step] as x, [filter_order[i] for i in range(1, step)] as earlier from orders, range(1, 6) s(step)),
rows as (select part, filter_order, step, x,
         coalesce(sum(n) filter (not list_has_any(fails, earlier) and not list_contains(fails, x)), 0)::bigint as kept,
         coalesce(sum(n) filter (not list_has_any(fails, earlier) and list_contains(fails, x)), 0)::bigint as removed,
         coalesce(sum(n) filter (list_has_any(fails, earlier) and list_contains(fails, x)), 0)::bigint as redundant,
         coalesce(sum(n) filter (fails = [x]), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (not list_has_any(fails, earlier) and list_contains(fails, x)), 0)::bigint as good_lost,
         coalesce(sum(toxic) filter (not list_has_any(fails, earlier) and list_contains(fails, x)), 0)::bigint as toxic_lost
         from sets, steps group by all)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) over (partition by part, x))::bigint as shapley from rows"""
