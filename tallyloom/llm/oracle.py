"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_S = 42  # symbols of the URL models


def _level(k: int) -> str:
    shorter = f"1.0::double / {_S}" if k == 0 else "b.yes_p", f"1.0::double / {_S}" if k == 0 else "b.no_p"
    join = "" if k == 0 else f"join p{k - 1} b on b.gram = l.gram % {_S ** k}"
    return f"""
l{k} as (select gram % {_S ** (k + 1)} as gram, sum(yes)::bigint as yes, sum(no)::bigint as no from counts group by 1),
w{k} as (select gram, yes, no,
  sum(yes) over c as yes_all, count(*) filter (where yes > 0) over c as yes_kinds,
  sum(no) over c as no_all, count(*) filter (where no > 0) over c as no_kinds
  from l{k} window c as (partition by gram // {_S})),
p{k} as (select l.gram,
  case when yes_all > 0 then (yes + yes_kinds * {shorter[0]}) / (yes_all + yes_kinds)::double else {shorter[0]} end as yes_p,
  case when no_all > 0 then (no + no_kinds * {shorter[1]}) / (no_all + no_kinds)::double else {shorter[1]} end as no_p
  from w{k} l {join})"""


_RULE = """case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/')
    then 'www.example.com/en/'
  when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
  when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
  when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end"""

OP1 = rf"""
with own as (select page_id, coalesce(url, '') as url from pages),
parts as (select distinct url, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end as rest
  from own),
split as (select url, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
ruled as (select *, {_RULE} as rule from split),
settled as (select *, case when rule is null then null when rule in ('com/', 'www.example.com/en/') then 1 else 0 end as side,
  substring(md5(url), 1, 1) in ('0', '1', '2') as held from ruled),
folded as (select url, case when held then null else side end as side, '^^^' || regexp_replace({_LOWER.format(
    "regexp_replace(url, '[1-9]', '0', 'g')")}, '[^a-z0/.\-_?=&#%:~+]', '*', 'g') || '$' as t from settled),
grams as (select url, side,
  (instr(a, substring(t, i, 1)) * {_S ** 3} + instr(a, substring(t, i + 1, 1)) * {_S ** 2}
   + instr(a, substring(t, i + 2, 1)) * {_S} + instr(a, substring(t, i + 3, 1)))::bigint as gram
  from (select url, side, t, 'abcdefghijklmnopqrstuvwxyz0/.-_?=&#%:~+^$' as a, unnest(generate_series(1, length(t) - 3)) as i
    from folded)),
counts as (select gram, count(*) filter (where side = 1) as yes, count(*) filter (where side = 0) as no from grams group by 1),
{','.join(_level(k) for k in range(4))},
diffs as (select gram, round((ln(yes_p) - ln(no_p)) * 1e6)::bigint as diff from p3),
scored as (select url, greatest(-1000, least(1000, floor(sum(diff)::double / (count(*) * 10000.0::double))))::int as score
  from grams join diffs using (gram) group by 1),
bins as (select score, count(*) filter (where side = 1) as yes, count(*) filter (where side = 0) as no
  from settled join scored using (url) where held and side is not null group by 1),
gains as (select score, sum(yes) over up * 1.0::double * sum(no) over () - sum(no) over up * 1.0::double * sum(yes) over () as gain
  from bins window up as (order by score desc)),
best as (select coalesce((select score from gains where gain > 0 order by gain desc, abs(score), score limit 1), 0) as threshold)
select page_id, host, path, rule,
  case when side = 1 then 'allow' when side = 0 then 'block'
    when score >= threshold then 'allow' else 'block' end as verdict, score
from own join settled using (url) join scored using (url), best"""

OP3 = f"""
with w as (select doc_id, {_WORDS} as words from documents),
items as (select item_id::varchar as item, words, least(10, len(words)) as n
  from (select item_id, {_WORDS} as words from benchmark) where len(words) > 0),
windows as (select distinct item, n, words[i:i + n - 1] as win
  from (select *, unnest(generate_series(1, len(words) - n + 1)) as i from items)),
sizes as (select distinct n from windows),
places as (select doc_id, i, n, words[i:i + n - 1] as win
  from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) as i from w, sizes where len(words) >= n)),
hits as (select doc_id, i, n, item from places join windows using (n, win)),
covered as (select doc_id, count(distinct j) as n_hit
  from (select doc_id, unnest(generate_series(i, i + n - 1)) as j from (select distinct doc_id, i, n from hits)) group by 1),
named as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items
  from hits group by 1)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (doc_id) left join named using (doc_id)"""

_LETTERS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP13 = f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, {_LETTERS} as terms
  from documents),
counts as (select lang, source, term, count(*) as n, count(distinct r) as docs
  from (select r, lang, source, unnest(terms) as term from d) group by all),
kept as (select lang, term, sum(n) as n from counts group by all having sum(docs) >= 30),
sizes as (select lang, count(*) as v, sum(n) as total from kept group by 1),
g as (select distinct lang, source from d),
filled as (select g.lang, g.source, kept.term, coalesce(counts.n, 0) as n, kept.n as n_lang
  from g join kept using (lang) left join counts on counts.lang = g.lang and counts.source = g.source and counts.term = kept.term),
totals as (select lang, source, sum(n) as total from filled group by all),
shares as (select f.lang, f.source, f.term, f.n, (1 + (1000000000::hugeint * (f.n + 5)) // (t.total + 5 * s.v))::bigint as p,
  (1 + (1000000000::hugeint * (f.n_lang + 5)) // (s.total + 5 * s.v))::bigint as q
  from filled f join totals t using (lang, source) join sizes s using (lang)),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
terms as (select lang, source, 'term' as part, term as item, p - q as value from shares where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
  from (select * from pairs union all select * from terms))
select * from ranked where part = 'pair' or rank <= 50"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op3_decontaminate": OP3, "op13_source_divergence": OP13}
