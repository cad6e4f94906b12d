"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_filter import _TAG, _VALUE, ENTITIES

#: Nested budgets of the SQL: beyond those that are needed they take nothing.
BUDGETS = 14
OP1 = rf"""
with docs as (
  select doc_id, source, coalesce('a' || source, 'b') as skey,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint as h
  from documents),
src0 as (select skey, sum(size)::bigint as source_size from docs group by skey),
src1 as (select *, [5.0, 2.0, 1.0][((row_number() over (order by skey)) - 1) % 3 + 1]::double as weight from src0),
src2 as (
  select *, 2.0::double * source_size as cap, sum(source_size) over () * 1.5::double as total,
         row_number() over (order by 2.0::double * source_size / weight, skey) as k from src1),
src3 as (
  select *, cap / weight as ratio,
         (total - coalesce(sum(cap) over (order by k rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by k rows between current row and unbounded following) as level from src2),
water as (select min_by(level, k) as level from src3 where ratio > level),
src as (
  select skey, source_size, least(cap, coalesce(level * weight, cap)) as target,
         case when source_size > 0 then floor(least(cap, coalesce(level * weight, cap)) / source_size) else 0 end::bigint as whole
  from src2, water),
r0 as (select d.*, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size as open, false as sel from docs d join src s using (skey)),
{"".join(f'''
c{k} as (
  select *, not sel and size > 0 {"and size <= open" if k else ""} as ok from r{k}),
s{k} as (
  select *, ok and sum(case when ok then size else 0 end) over (partition by skey order by h range between unbounded preceding and current row) <= open as now from c{k}),
r{k + 1} as (
  select doc_id, source, skey, size, h, source_size, target, whole,
         open - coalesce(sum(case when now then size else 0 end) over (partition by skey), 0) as open, sel or now as sel from s{k}),''' for k in range(BUDGETS))}
done as (select 1)
select doc_id, size, source_size, target, (size * (whole + sel::int))::bigint as taken from r{BUDGETS}
"""

_HOST = r"translate(coalesce(regexp_extract({u}, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"coalesce(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), '')"
_PARTS = "string_split(" + _PATH + ", '/')"
_PLAIN = (
    "regexp_replace(array_to_string(list_reduce(list_transform(" + _PARTS + "[2:], lambda p: [p]), "
    "lambda kept, p: case when p[1] = '.' then kept when p[1] = '..' then kept[1:greatest(len(kept) - 1, 1)] else list_concat(kept, p) end, " + _PARTS + "[1:1]), '/'), '/+$', '')"
)
_KEY = (
    "case when " + _HOST + " <> '' then " + _HOST + " || " + _PLAIN + " || "
    r"coalesce('?' || nullif(array_to_string(list_filter(string_split(coalesce(regexp_extract({u}, '://[^?#]*\?([^#]*)', 1), ''), '&'), lambda x: x <> '' and not starts_with(x, 'utm_')), '&'), ''), '') end"
)


_QUOTES = "^[\"']|[\"']$"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _attribute(name: str) -> str:
    value = f"regexp_replace(regexp_extract(tag, {_quoted(_VALUE.format(name))}, 1), {_quoted(_QUOTES)}, '', 'g')"
    for entity, plain in ENTITIES:
        value = f"replace({value}, {_quoted(entity)}, {_quoted(plain)})"
    return f"trim({value})"


_SCHEME = "^[A-Za-z][A-Za-z0-9+.\\-]*:"
OP3 = rf"""
with recursive d as (
  select page_id, {_HOST.format(u="url")} as host, {_PATH.format(u="url")} as path, {_KEY.format(u="url")} as spot, html from pages),
tags as (
  select host, path, spot, unnest(regexp_extract_all(html, {_quoted(_TAG.format("link"))})) as tag, 1 as kind from d
  union all select host, path, spot, unnest(regexp_extract_all(html, {_quoted(_TAG.format("meta"))})), 2 from d),
found as (
  select host, path, spot, case when kind = 1 then {_attribute("href")} else regexp_extract({_attribute("content")}, '(?is)url\s*=\s*["'']?([^"''\s]+)', 1) end as link
  from tags where case when kind = 1 then regexp_matches(lower({_attribute("rel")}), '(^|\s)canonical(\s|$)') else lower({_attribute("http-equiv")}) = 'refresh' end),
t as (
  select spot, case when link = '' or starts_with(link, '#') or host = '' then null
                    when regexp_matches(link, '{_SCHEME}') then case when regexp_matches(link, '{_SCHEME}//') then link end
                    when starts_with(link, '//') then 'http:' || link
                    when starts_with(link, '/') then 'http://' || host || link
                    when starts_with(link, '?') then 'http://' || host || path || link
                    else 'http://' || host || regexp_replace(case when path = '' then '/' else path end, '[^/]*$', '') || link end as target from found),
k as (select spot, {_KEY.format(u="target")} as other from t),
j as (
  select page_id, host, path, spot,
         case when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
              when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
              when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
              when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from d),
v as (select *, case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' end as own from j),
e as (select distinct spot as a, other as b from k where spot <> other),
sym as (select a, b from e union select b, a from e),
reach as (select a, b from sym union select r.a, s.b from reach r join sym s on r.b = s.a),
bad as (select distinct spot from v where own = 'block' and spot is not null),
hit as (select spot from bad union select r.a from reach r join bad on r.b = bad.spot)
select page_id, host, path, rule, coalesce(own, case when spot in (select spot from hit) then 'block' else 'allow' end) as verdict from v
"""

ORACLES = {"op1_mix_sources": OP1, "op3_url_filter": OP3}
