"""DuckDB statements that state the registered queries independently of the Spark code."""

from __future__ import annotations

# Stated here once more, apart from the lists of the code under test: letters that are vowels, and English stop words.
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"
STOP_WORDS = """a about above after again against all am an and any are as at be because been before being below between both but
by can did do does doing don down during each few for from further had has have having he her here hers herself him himself his
how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out
over own s same she should so some such t than that the their theirs them themselves then there these they this those through to
too under until up very was we were what when where which while who whom why will with you your yours yourself yourselves""".split()

WS = r"E' \n\t\r'"
TS = "timestamp '2024-06-01'"
ROUNDS = 20


def norm(u: str) -> str:
    return rf"rtrim(case when contains({u}, '#') then regexp_replace(split_part({u}, '#', 1), '\?$', '') else {u} end, '/')"


def host(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://([^/?#]*)', 1)"


def site(u: str) -> str:
    return f"regexp_extract({u}, '^[a-z]+://[^/?#]*')"


def dec(x: str) -> str:
    for entity, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def cut(x: str, tags: list[str], mark: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', {mark}, 'g')"
    for tag in tags:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', {mark}, 'g')"
    return x


BODY = ["script", "style", "nav", "header", "footer", "aside"]
INDEX = ["script", "style", "nav", "footer", "header"]


def visible(x: str, tags: list[str]) -> str:
    marked = dec(f"regexp_replace({cut(x, tags, 'chr(1)')}, '<[^>]+>', chr(1), 'g')")
    nodes = f"list_transform(string_split({marked}, chr(1)), lambda t: trim(t, {WS}))"
    return f"array_to_string(list_filter({nodes}, lambda t: t <> ''), ' ')"


def title(x: str) -> str:
    return "trim(" + dec(f"regexp_extract({x}, '(?is)<title>(.*?)</title>', 1)") + f", {WS})"


BLOCKS = (
    "address article blockquote body br dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li "
    "main ol p pre section table tbody td tfoot th thead title tr ul"
).replace(" ", "|")


def main_text(x: str) -> str:
    body = cut(f"regexp_replace({x}, '(?is)<title>.*?</title>', chr(2), 'g')", INDEX, "chr(2)")
    body = rf"regexp_replace({body}, '(?i)</?({BLOCKS})(\s[^>]*)?>', chr(2), 'g')"
    body = rf"regexp_replace(regexp_replace({body}, '(?i)<a\s[^>]*>', chr(3), 'g'), '(?i)</a>', chr(4), 'g')"
    body = dec(f"regexp_replace({body}, '<[^>]+>', '', 'g')")
    block = (
        f"struct_pack(t := trim(replace(replace(b, chr(3), ''), chr(4), ''), {WS}), "
        f"p := length(trim(regexp_replace(b, chr(3) || '[^' || chr(4) || ']*' || chr(4) || '?', '', 'g'), {WS})))"
    )
    blocks = f"list_transform(string_split({body}, chr(2)), lambda b: {block})"
    kept = f"list_filter({blocks}, lambda s: length(s.t) >= 25 and s.p >= 0.5 * length(s.t))"
    joined = f"array_to_string(list_transform({kept}, lambda s: s.t), chr(10))"
    return f"coalesce(nullif({joined}, ''), {visible(x, INDEX)})"


def ease(x: str) -> str:
    n = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern}'))"
    low = f"lower({x})"
    words, vowels = n(low, r"\p{L}+"), n(low, f"[{VOWELS}]+")
    voiced = n(low, rf"\p{{L}}*[{VOWELS}]\p{{L}}*")
    return (
        f"case when length({x}) > 100 and {words} > 0 then 206.835 - 1.015 * ({words} / greatest({n(x, '[.!?]+')}, 1)) "
        f"- 84.6 * (({vowels} + {words} - {voiced}) / {words}) else 0.0 end"
    )


def hrefs(x: str) -> str:
    found = f"""regexp_extract_all({cut(x, ["script", "style"], "' '")}, '<a href="([^"]*)"', 1)"""
    return f"list_transform({found}, lambda h: {dec('h')})"


def unnested(source: str, x: str, tags: list[str], mark: str) -> str:
    """``page_id`` and ``h``: the html without elements, by running levels of each name over its tags and texts."""
    names = "|".join(tags)
    level = " + ".join(rf"""(sum(case when regexp_matches(tok, '(?i)^<{t}[\s>]') then 1
      when regexp_matches(tok, '(?i)^</{t}[\s>]') then -1 else 0 end) over w)""" for t in tags)
    return rf"""select page_id, string_agg(case when hidden then '' when own then {mark} else tok end, '' order by pos) as h from (
      select *, {level} > 0 as hidden, regexp_matches(tok, '(?i)^</?({names})[\s>]') as own from (
        select page_id, unnest(ts) as tok, unnest(range(len(ts))) as pos from (
          select page_id, regexp_extract_all({x}, '(?is)</?(?:{names})(?:\s[^>]*)?>|[^<]+|<') as ts from {source}))
      window w as (partition by page_id order by pos)) group by page_id"""


EXT = r"\.(pdf|jpg|png|gif|css|js|zip|mp4|mp3)$"

PG = f"pg as (select page_id, url as raw_url, html, {norm('url')} as url from pages)"
DP = f"{PG}, dp as (select url, html, page_id from pg qualify row_number() over (partition by url order by page_id) = 1)"
HREFS = f"""hr as (select page_id, url, unnest(h) as href, unnest(range(len(h))) as link
  from (select page_id, url, {hrefs('html')} as h from dp))"""
LINKS = f"""{DP}, {HREFS}, res as (select url as source_url, {norm(f"{site('url')} || href")} as target_url from hr),
  lk as (select * from res where not regexp_matches(lower(target_url), '{EXT}'))"""
NUMBERED = "row_number() over (order by substr(md5(url), 1, 4), url)"
GRAPH = f"""{LINKS},
  ids as (select url, {NUMBERED} as id from dp),
  st as (select url, {NUMBERED} + (select max(id) from ids) as id from
         (select distinct target_url as url from lk where target_url not in (select url from dp))),
  everyone as (select id, url from ids union all select id, url from st),
  ed as (select distinct s.id as source_id, t.id as target_id from lk
         join everyone s on s.url = lk.source_url join everyone t on t.url = lk.target_url)"""
STUB_DOMAIN = "split_part(split_part(url, '//', 2), '/', 1)"


def pagerank(nodes: str, edges: str, shared: bool = False) -> str:
    """CTEs r0 ... r20 over nodes(id) and edges(source_id, target_id); ``shared``: all nodes get the score of those without links."""
    out = f"""deg as materialized (select source_id, count(*) as k from {edges} group by 1),
      nn as (select count(*)::double as n from {nodes}),
      r0 as materialized (select id, 1.0 / (select n from nn) as score from {nodes})"""
    extra = " + (select sum(score) from r{0} where id not in (select source_id from deg)) / (select n from nn)" if shared else ""
    for i in range(1, ROUNDS + 1):
        out += f""",
      i{i} as materialized (select e.target_id, sum(r.score / d.k) as v from {edges} e
        join r{i - 1} r on r.id = e.source_id join deg d on d.source_id = e.source_id group by 1),
      r{i} as materialized (select n.id, 0.15 / (select n from nn) + 0.85 * (coalesce(i.v, 0){extra.format(i - 1)}) as score
        from {nodes} n left join i{i} i on i.target_id = n.id)"""
    return out


PARTS = """nodes as (select p_partkey as id from part),
  ed as materialized (select distinct source_id, target_id from (select l_partkey as source_id,
    lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as target_id from lineitem)
    where target_id is not null)"""

COMPOSITE = f"""{GRAPH}, nodes as (select id from everyone), {pagerank('nodes', 'ed')},
  facts as (select url, case when page_id % 7 <> 0 then {TS} - to_days((page_id % 500)::int) end as crawled_at,
      length({visible('html', BODY)}) as n, {main_text('html')} as body, 0 as depth from dp),
  allp as (select url, crawled_at, n, {ease('body')} as ease, depth from facts
    union all select url, (select max(crawled_at) from facts), null, 0.0, -1 from st),
  m as (select a.url, a.depth, r.score,
      greatest(0.0, 1.0 - (epoch_us({TS}) - epoch_us(coalesce(a.crawled_at, {TS}))) / 1e6 / 31536000.0) as fresh,
      case when a.n > 0 then log10(a.n::double) else 0.0 end as quality, a.ease,
      case when a.url like '%.gov%' then 1.0 when a.url like '%.edu%' then 0.8 when a.url like '%.org%' then 0.5
        else 0.0 end::double as dom
    from allp a join everyone e on e.url = a.url join r{ROUNDS} r on r.id = e.id),
  comp as (select url, depth,
    round(score * 0.7 + fresh * 0.1 + quality * 0.1 + ease / 100.0 * 0.05 + dom * 0.05, 7) as rank_score,
    round(fresh, 7) as freshness_score, round(quality, 7) as quality_score, round(dom, 7) as domain_score from m)"""

CUSTOMERS = f"""cp as (select c_custkey as id, 'http://shop.example/' || c_custkey as url,
    case when not s then c_name end as title, case when not s then c_mktsegment end as meta_description,
    case when s then -1 else c_nationkey end::int as depth, {TS} - to_days(c_nationkey) as crawled_at,
    case when not s then c_mktsegment end as body_text, case when not s then 'en' end as language,
    case when c_nationkey > 2 then c_acctbal end as rank_score,
    case when c_acctbal > 2000 then {TS} - to_days(12) end as indexed_at,
    case when c_acctbal > 7000 then {TS} - to_days(1) end as deleted_at
  from (select *, c_mktsegment = 'BUILDING' as s from customer))"""
ORDER_WRITES = """ow as (select 'http://shop.example/' ||
    (case when o_orderpriority = '1-URGENT' then o_custkey + 1000000 else o_custkey end) as url,
    'Order ' || o_orderkey as title, o_orderpriority as meta_description, 1 as depth, o_orderstatus as body_text,
    'raw/' || o_orderkey as raw_html_path, 'de' as language, o_orderdate as crawled_at,
    o_orderstatus = 'P' as is_stub, o_orderkey as seq from orders)"""


def us(x: str) -> str:
    return f"coalesce(epoch_us({x})::varchar, '-')"


DOCS = """doc as (select doc_id as id, 'http://docs.example/' || doc_id as url, split_part(text, chr(10), 1) as title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) as body_text, source || ' ' || lang as meta_description,
    source as domain, lang as language, (n_chars % 100) / 100.0 as rank_score from documents)"""
WORDS = r"'[\p{L}\p{N}]+'"


def tokens(x: str) -> str:
    """Select-list items: word and its place, from 1."""
    return f"unnest(regexp_extract_all({x}, {WORDS})) as word, unnest(range(1, len(regexp_extract_all({x}, {WORDS})) + 1)) as pos"


POSTINGS = f"""tok as (
    select id, 0 as field, {tokens('title')} from doc union all
    select id, 1, {tokens('body_text')} from doc union all
    select id, 2, {tokens('meta_description')} from doc),
  post as materialized (select strip_accents(lower(word)) as term, id, field, pos from tok)"""

QUERY = f"""bw as (select item_id, regexp_extract_all(text, {WORDS}) as w from benchmark),
  qu as (select item_id as qid,
      array_to_string(list_transform(w, lambda x, i: case when i = 4 then substr(x, 1, 2) || 'x' || substr(x, 3) else x end), ' ') as q,
      case when item_id % 4 = 1 then 'src' || (item_id % 20) end as want_domain,
      case when item_id % 4 = 2 then 'en' end as want_language from bw),
  qw as (select qid, strip_accents(lower(word)) as word, min(pos) as p from (select qid, {tokens('q')} from qu) group by 1, 2),
  slots as (select qid, word, (row_number() over (partition by qid order by p) - 1)::int as slot from qw),
  vocab as (select distinct term from post),
  near as materialized (select word, term, typos from (
      select word, term, damerau_levenshtein(replace(word, 'ß', '~'), replace(term, 'ß', '~')) as typos,
        case when length(word) >= 9 then 2 when length(word) >= 5 then 1 else 0 end as budget
      from (select distinct word from slots) join vocab on abs(length(term) - length(word)) <= 2) where typos <= budget)"""

PLAIN_ANSWERS = "ans as materialized (select qid, slot, term, typos, typos = 0 as whole from slots join near using (word))"
# The last word of a query that does not end with a blank is also answered by what starts with it.
BEGUN_ANSWERS = """ends as (select qid, slot, word from (select *, slot = max(slot) over (partition by qid) as ending from slots) join qu using (qid)
      where ending and not ends_with(q, ' ')),
  ans as materialized (select qid, slot, term, min(typos) as typos, bool_or(whole) as whole from (
      select qid, slot, term, typos, typos = 0 as whole from slots join near using (word)
      union all select qid, slot, term, 0, false from ends join vocab on starts_with(term, word) and length(term) > length(word)) group by 1, 2, 3)"""
BEGUN_QUERY = QUERY.replace(QUERY[QUERY.index("qu as"):QUERY.index("qw as")], """qu as (select item_id as qid, w[1] || ' ' || w[2] || ' '
      || substr(w[6], 1, 3) || case when item_id % 5 = 0 then ' ' else '' end as q, null::varchar as want_domain, null::varchar as want_language from bw),
  """)


def matches(query: str, answers: str) -> str:
    return f"""{DOCS}, {POSTINGS}, {query}, {answers},
  perword as (select qid, id, slot, min(typos) as typos, min(field) as field, bool_or(whole) as whole from post join ans using (term) group by 1, 2, 3),
  admitted as (select p.*, row_number() over (partition by qid, id order by slot) - 1 as turn from perword p
      join doc d using (id) join qu using (qid) where (want_domain is null or want_domain = d.domain)
      and (want_language is null or want_language = d.language)),
  perdoc as (select qid, id, count(*) as words, sum(typos) as typos, min(field) as attribute,
      count(*) filter (whole) as exact from admitted where slot = turn group by 1, 2),
  lv as (select qid, coalesce(max(words) filter (reached >= 20), 1) as level from (
      select qid, words, sum(count(*)) over (partition by qid order by words desc) as reached from perdoc group by 1, 2) group by 1),
  mt as materialized (select p.*, d.url, d.domain, d.language, d.rank_score from perdoc p join doc d using (id)
      join lv using (qid) where words >= level)"""


def ranked(found: str) -> str:
    return f"""{found},
  places as materialized (select distinct qid, id, field, slot, pos from post join ans using (term)
      join (select qid, id, words from mt) using (qid, id) where slot < words),
  gaps as (select qid, id, slot, least(min(gap), 8) as gap from (
      select a.qid, a.id, a.slot, abs(a.pos - b.pos) as gap from places a join places b
        on a.qid = b.qid and a.id = b.id and a.field = b.field and b.slot = a.slot + 1) group by 1, 2, 3),
  saved as (select qid, id, sum(8 - gap) as s from gaps group by 1, 2),
  pairs as (select qid, count(*) - 1 as n from slots group by 1),
  rk as (select qid, row_number() over (partition by qid order by words desc, typos, proximity, attribute, exact desc,
        rank_score desc, url, id)::int as place, * exclude (qid) from (
      select mt.*, pairs.n * 8 - coalesce(s, 0) as proximity from mt join pairs using (qid)
        left join saved using (qid, id)) qualify place <= 20)"""


MATCHES = matches(QUERY, PLAIN_ANSWERS)
RANKED, BEGUN = ranked(MATCHES), ranked(matches(BEGUN_QUERY, BEGUN_ANSWERS))

ESC = lambda x: f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
SNIPPETS = rf"""{RANKED},
  qt as (select qid, place, list(distinct term) as terms from rk join ans using (qid) where slot < words group by 1, 2),
  cr as (select rk.qid, rk.place, doc.url, doc.title, doc.meta_description, rk.rank_score, terms,
      list_transform(regexp_extract_all(body_text, '^[^\p{{L}}\p{{N}}]+|[\p{{L}}\p{{N}}]+[^\p{{L}}\p{{N}}]*'),
        lambda r: struct_pack(w := regexp_extract(r, '[\p{{L}}\p{{N}}]+'),
          e := substr(r, length(regexp_extract(r, '[\p{{L}}\p{{N}}]+')) + 1))) as ps
    from rk join doc using (id) join qt using (qid, place)),
  ht as (select *, coalesce(list_position(list_transform(ps,
      lambda s: list_contains(terms, strip_accents(lower(s.w)))), true), 0) as hit from cr),
  sa as (select *, greatest(least(hit - 75, len(ps) - 149), 1) as first from ht),
  sn as (select qid, place, url, title, meta_description, rank_score, case when len(ps) = 0 then '' else
      (case when first > 1 then '…' else '' end) || rtrim(array_to_string(list_transform(ps[first:first + 149],
        lambda s: (case when list_contains(terms, strip_accents(lower(s.w))) then '<b>' || s.w || '</b>' else s.w end)
          || {ESC('s.e')}), '')) || (case when len(ps) > first + 149 then '…' else '' end) end as crop from sa),
  rs as (select qid, place, url, title, coalesce(nullif(crop, ''), meta_description) as snippet, meta_description, rank_score
    from sn)"""

# The Porter stemmer once more, stated step by step over distinct words.
M1, M2 = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'", "'^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]'"
CVC = "'[^aeiouy][aeiouy][^aeiouywxY]$'"
PORTER_2 = (
    "ational:ate ization:ize iveness:ive fulness:ful ousness:ous tional:tion biliti:ble entli:ent ousli:ous ation:ate "
    "alism:al aliti:al iviti:ive enci:ence anci:ance izer:ize alli:al ator:ate logi:log bli:ble eli:e"
)
PORTER_3 = "icate:ic ative: alize:al iciti:ic ical:ic ness: ful:"
PORTER_4 = "ement: ance: ence: able: ible: ment: ant: ent: ism: ate: iti: ous: ive: ize: ion: al: er: ic: ou:"


def ending_step(x: str, pairs: str, measure: str) -> str:
    out = ""
    for ending, new in (pair.split(":") for pair in pairs.split()):
        rest = f"substr({x}, 1, length({x}) - {len(ending)})"
        extra = f" and regexp_matches({rest}, '[st]$')" if ending == "ion" else ""
        out += f" when ends_with({x}, '{ending}') then case when regexp_matches({rest}, {measure}){extra} then {rest} || '{new}' else {x} end"
    return f"case{out} else {x} end"


def stems(source: str) -> str:
    """CTEs that end in ``stem_of(word, term)`` for the words of ``source``."""
    less = lambda n: f"substr(s, 1, length(s) - {n})"
    return f"""q0 as (select distinct word, regexp_replace(word, '(^|[aeiouy])y', '\\1Y', 'g') as s from {source}),
    q1 as (select word, case when ends_with(s, 'sses') or ends_with(s, 'ies') then {less(2)} when ends_with(s, 'ss') then s
      when ends_with(s, 's') then {less(1)} else s end as s from q0),
    q2 as (select word, s, case when ends_with(s, 'eed') then null when ends_with(s, 'ed') then {less(2)}
      when ends_with(s, 'ing') then {less(3)} end as c from q1),
    q3 as (select word, case when ends_with(s, 'eed') then case when regexp_matches({less(3)}, {M1}) then {less(1)} else s end
      when c is null or not regexp_matches(c, '[aeiouy]') then s when regexp_matches(c, '(at|bl|iz)$') then c || 'e'
      when length(c) > 1 and c[-1] = c[-2] and not regexp_matches(c, '[aeiouylsz]$') then substr(c, 1, length(c) - 1)
      when regexp_matches(c, {CVC}) and regexp_matches(c, {M1}) and not regexp_matches(c, {M2}) then c || 'e' else c end as s from q2),
    q4 as (select word, case when lower(s[-1]) = 'y' and regexp_matches({less(1)}, '[aeiouy]') then {less(1)} || 'i' else s end as s from q3),
    q5 as (select word, {ending_step('s', PORTER_2, M1)} as s from q4),
    q6 as (select word, {ending_step('s', PORTER_3, M1)} as s from q5),
    q7 as (select word, {ending_step('s', PORTER_4, M2)} as s from q6),
    q8 as (select word, case when s[-1] = 'e' and (regexp_matches({less(1)}, {M2}) or (regexp_matches({less(1)}, {M1})
      and not regexp_matches({less(1)}, {CVC}))) then {less(1)} else s end as s from q7),
    stem_of as (select word, case when length(word) <= 2 then word when ends_with(s, 'll') and regexp_matches(s, {M2})
      then lower({less(1)}) else lower(s) end as term from q8)"""


LOG = """fl as (select event_id, 'http://site' || (user_id % 20) || '.example/' || user_id as url,
    'site' || (user_id % 20) || '.example' as domain,
    case event_type when 'signup' then 'skipped' when 'error' then 'error' when 'purchase' then 'dropped'
      when 'click' then 'crawled' else case when value < 30 then 'crawled' else 'dropped' end end as outcome from events)"""

GRAMS = """lw as (select lang, word, count(*) as n from (
      select lang, unnest(regexp_extract_all(lower(text), '\\p{L}+')) as word from documents) group by 1, 2),
  lg as (select lang, substr(' ' || word || ' ', i, 3) as gram, sum(n) as n from (
      select lang, word, n, unnest(range(1, length(word) + 1)) as i from lw) group by 1, 2),
  tot as (select lang, sum(n) + count(*) as total from lg group by 1),
  fl as (select lang, round(ln(1.0 / total) * 1000000)::bigint as floor from tot),
  wt as materialized (select lang, gram, round(ln((n + 1) / total) * 1000000)::bigint - floor as weight
    from lg join tot using (lang) join fl using (lang))"""


def identify(source: str, key: str) -> str:
    return f"""{GRAMS}, src as (select * from {source}),
  sg as (select {key}, substr(' ' || word || ' ', i, 3) as gram, count(*) as c from (
      select {key}, word, unnest(range(1, length(word) + 1)) as i from (
        select {key}, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from src where length(text) > 50)) group by 1, 2),
  sc as (select {key}, lang, sum(weight * c) as m from sg join wt using (gram) group by 1, 2),
  best as (select {key}, lang from sc join fl using (lang) join (select {key},
      length(regexp_replace(text, '[^\\p{{L}}]+', '', 'g')) as letters from src) using ({key})
    qualify row_number() over (partition by {key} order by m + letters * floor desc, lang) = 1)
  select {key}, coalesce(lang, 'unknown') as language from src left join best using ({key})"""


SWAPS = r"""sw as (select distinct substr(w, 1, h - 1) || substr(w, h + 1, 1) || substr(w, h, 1) || substr(w, h + 2) as word from (
      select w, (length(w) // 2)::int as h from (select distinct strip_accents(lower(word)) as w from bw, unnest(bw.w) as u(word)) where length(w) >= 5)),
    swap_vocab as (select distinct term from post),
    swapped as (select word, term, typos from (select word, term,
        damerau_levenshtein(replace(word, 'ß', '~'), replace(term, 'ß', '~')) as typos,
        case when length(word) >= 9 then 2 when length(word) >= 5 then 1 else 0 end as budget
      from sw join swap_vocab on abs(length(term) - length(word)) <= 2) where typos <= budget)"""

ORACLES = {
    "url_normalize": f"select page_id, url, {norm('url')} as norm_url from pages",
    "url_domain": f"""with {PG} select page_id, {host('url')} as domain, {STUB_DOMAIN} as stub_domain,
        {site('url')} as base_url from pg""",
    "url_valid": f"""with {PG} select page_id, form, candidate,
        regexp_matches(candidate, '^https?://[^/?#]') and not regexp_matches(lower(candidate), '{EXT}') as valid
      from (select page_id, unnest(range(8))::int as form, unnest([url, url || '.PDF', url || '.zip?x=1',
        url || '?file=a.mp3', regexp_replace(url, '^https?', 'ftp'), 'mailto:x@' || {host('url')},
        regexp_replace(url, '^https?:', ''), regexp_replace(url, '//[^/]*', '//')]) as candidate from pg)""",
    "url_key": f"with {PG} select page_id, 'raw_html/' || sha256(url) || '.html' as raw_html_path from pg",
    "href_resolve": rf"""with b as (select page_id, url, {site('url')} as s, split_part(url, ':', 1) as scheme,
          regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as p, regexp_extract(url, '\?[^#]*') as q,
          {hrefs('html')} as hs from pages),
        f as (select *, regexp_replace(p, '[^/]*$', '') as d, unnest(hs) as h, unnest(range(len(hs)))::int as link from b)
      select page_id, link, unnest(range(9))::int as form, unnest([
        s || h, s || d || substr(h, 2), s || regexp_replace(d, '[^/]+/$', '') || substr(h, 2), s || d || substr(h, 2),
        s || p || '?q=' || h, s || p || q || '#' || h, scheme || '://other.example' || h, 'https://abs.example' || h,
        url]) as resolved from f""",
    "page_title": f"select page_id, {title('html')} as title from pages",
    "page_meta": """select page_id, coalesce(trim(regexp_extract(regexp_extract(html,
        '(?is)<meta[^>]*name=.description.[^>]*>'), 'content="([^"]*)"', 1)), '') as meta_description from (select page_id,
        case when page_id % 3 = 0 then replace(html, '<head>', '<head><META name=''description'' content="Page & no. ' || page_id || ' ">')
        else html end as html from pages)""",
    "page_text": f"""select page_id, t as whole_text, substr(t, 1, 5000) as body_text
      from (select page_id, {visible('html', BODY)} as t from pages)""",
    "page_insufficient": f"""select page_id, length({visible('html', ['script', 'style', 'noscript'])}) < 100 as page_needs_render,
        length({visible("regexp_extract(html, '(?is)^.*?</head>')", ['script', 'style', 'noscript'])}) < 100
          as head_needs_render from pages""",
    "page_main_text": f"select page_id, {main_text('html')} as main_text from pages",
    "page_nested": f"""with planted as (select page_id, repeat('<NAV class="m">in<a href="/in">i</a>', (page_id % 4 + 1)::int)
            || '<header>h<header id=x>hh</header>LEAK</header>'
            || repeat('</nav> LEAK <a href="/leak">l</a><p>A leaked line that is long enough to be a block of its own.</p>', (page_id % 4)::int)
            || '</nav>' || html || '<aside>a<aside>b</aside>LEAK<a href="/leak">x</a></aside> end' as html from pages),
        coded as (select page_id, {cut('html', ['script', 'style'], 'chr(1)')} as html from planted),
        body as ({unnested('coded', 'html', BODY[2:], 'chr(1)')}),
        idx as ({unnested('coded', 'html', INDEX[2:], 'chr(2)')})
      select page_id, {visible('body.h', [])} as whole_text, array_to_string({hrefs('body.h')}, ' ') as links,
        {main_text('idx.h')} as main_text from body join idx using (page_id)""",
    "raw_html_join": f"""with {DP} select page_id, 'raw_html/' || sha256(url) || '.html' as raw_html_path,
        sha256(html) as html_hash from dp""",
    "page_links_raw": f"""select page_id, unnest(range(len(h)))::int as link, unnest(h) as href
      from (select page_id, {hrefs('html')} as h from pages)""",
    "page_links_valid": f"with {LINKS} select source_url, target_url from lk",
    "page_links_content": f"""with c as (select page_id, {hrefs(cut('html', BODY, "' '"))} as h, {hrefs('html')} as a from pages)
      select page_id, len(h)::int as content_links, len(a)::int as all_links from c""",
    "link_stubs": f"with {GRAPH} select id, url, {STUB_DOMAIN} as domain, -1 as depth from st",
    "link_edges": f"with {GRAPH} select source_id, target_id from ed",
    "edge_cascade": f"""with {GRAPH} select source_id, target_id from ed
      where source_id in (select id from everyone where url not like 'https:%')
        and target_id in (select id from everyone where url not like 'https:%')""",
    "out_degree": f"""with {GRAPH} select e.id, count(ed.source_id) as links_out from everyone e
      left join ed on ed.source_id = e.id group by 1""",
    "pagerank_pages": f"""with {GRAPH}, nodes as (select id from everyone), {pagerank('nodes', 'ed')}
      select url, round(score, 9) as score from everyone join r{ROUNDS} using (id)""",
    "pagerank_parts": f"with {PARTS}, {pagerank('nodes', 'ed')} select id, round(score, 9) as score from r{ROUNDS}",
    "pagerank_redistributed": f"""with {PARTS}, fewer as materialized (select * from ed where source_id % 10 <> 0),
        {pagerank('nodes', 'fewer', shared=True)} select id, round(score, 9) as score from r{ROUNDS}""",
    "bfs_frontier": f"""with recursive {PARTS}, walk as (select min(id) as id, 0 as depth from nodes
        union select target_id, depth + 1 from walk join ed on source_id = id where depth < 3)
      select id, min(depth)::int as depth from walk group by 1""",
    "frontier_pop": """select url, depth from (select 'http://parts.example/' || p_partkey as url, p_size as depth from part)
      order by depth, url limit 20""",
    "frontier_merge": f"""with {LINKS},
        found as (select target_url as url, min(length(regexp_replace(source_url, '[^/]', '', 'g')) - 2) + 1 as depth
          from lk where length(regexp_replace(source_url, '[^/]', '', 'g')) - 2 < 3
            and target_url not in (select url from dp) group by 1)
      select url, min(depth)::int as depth from (select * from found union all select url, 0 from dp) group by 1""",
    "visited_update": """select 'http://parts.example/' || k as url from (
        (select p_partkey as k from part where p_size <= 25 union select l_partkey from lineitem where l_quantity >= 45)
        except select l_partkey from lineitem where l_returnflag = 'R' and l_quantity < 3)""",
    "composite_score": f"with {COMPOSITE} select * from comp",
    "top_pages": f"with {COMPOSITE} select * from comp order by rank_score desc, url limit 20",
    "readability": f"select doc_id, round({ease('text')}, 6) as reading_ease from documents",
    "language_id": "with " + identify("(select doc_id, text from documents)", "doc_id"),
    "page_language": "with " + identify(f"(select page_id, {visible('html', BODY)} as text from pages)", "page_id"),
    "page_upsert": f"""with {CUSTOMERS}, {ORDER_WRITES},
        fw as (select * from ow qualify row_number() over (partition by url order by seq) = 1),
        lw as (select * from ow where not is_stub qualify row_number() over (partition by url order by seq desc) = 1),
        old as (select cp.id, url, coalesce(lw.title, cp.title) as title, cp.meta_description, cp.depth,
            coalesce(lw.body_text, cp.body_text) as body_text, null as raw_html_path,
            coalesce(lw.language, cp.language) as language, coalesce(lw.crawled_at, cp.crawled_at) as crawled_at,
            deleted_at, indexed_at from cp left join lw using (url)),
        new as (select {NUMBERED} + (select max(id) from cp) as id, url, coalesce(lw.title, fw.title) as title,
            fw.meta_description, fw.depth, coalesce(lw.body_text, fw.body_text) as body_text, fw.raw_html_path,
            fw.language, coalesce(lw.crawled_at, fw.crawled_at) as crawled_at, null::timestamp as deleted_at,
            null::timestamp as indexed_at
          from fw left join lw using (url) where url not in (select url from cp))
      select id, url, coalesce(title, '-') as title, coalesce(meta_description, '-') as meta_description, depth,
        coalesce(body_text, '-') as body_text, coalesce(raw_html_path, '-') as raw_html_path,
        coalesce(language, '-') as language, {us('crawled_at')} as crawled_at, {us('deleted_at')} as deleted_at,
        {us('indexed_at')} as indexed_at from (select * from old union all select * from new)""",
    "soft_delete": f"""with {CUSTOMERS}, {ORDER_WRITES} select id, case when url in (select url from ow where is_stub)
        then {us(TS)} else {us('deleted_at')} end as deleted_at from cp""",
    "index_pending": f"""with {CUSTOMERS} select id, row_number() over (order by crawled_at, id) <= 1000 as first_batch
      from cp where (indexed_at is null or crawled_at > indexed_at) and deleted_at is null""",
    "index_queue_depth": f"""with {CUSTOMERS} select count(*) as queue_depth from cp
      where indexed_at is null or crawled_at > indexed_at""",
    "index_cleanup": f"""with {CUSTOMERS}, gone as (select id from cp where deleted_at is not null and indexed_at is not null)
      select id, case when id in (select id from gone) then '-' else {us('indexed_at')} end as indexed_at,
        indexed_at is not null and id not in (select id from gone) as in_index from cp""",
    "index_documents": f"""with {CUSTOMERS},
        feed as (select id from cp where (indexed_at is null or crawled_at > indexed_at) and deleted_at is null)
      select id, url, coalesce(case when id in (select id from feed) then title else 'old' end, '-') as title,
        round(epoch_us(crawled_at) / 1e6, 3) as crawled_at, coalesce(rank_score, 1.0) as rank_score,
        case when id in (select id from feed) then {us(TS)} else {us('indexed_at')} end as indexed_at
      from cp where indexed_at is not null or id in (select id from feed)""",
    "index_cycle": f"""with {DP}, n as (select url, {main_text('html')} as body from dp)
      select url, round({ease('body')}, 6) as reading_ease, true as indexed, length(body) as body_chars,
        sha256(body) as body_hash from n""",
    "term_postings": f"""with {DOCS}, t as (select id, {tokens("lower(title || ' ' || body_text)")} from doc),
        kept as (select * from t where word not in ({', '.join(f"'{w}'" for w in STOP_WORDS)})), {stems('kept')}
      select id as doc_id, term, string_agg(pos::varchar, ' ' order by pos) as positions from kept join stem_of using (word) group by 1, 2""",
    "search_postings": f"with {DOCS}, {POSTINGS} select term, id, field, pos::int as pos from post",
    "search_typo": f"with {DOCS}, {POSTINGS}, {QUERY} select word, term, typos::int as typos from near",
    "search_swaps": f"""with {DOCS}, {POSTINGS}, {QUERY}, {SWAPS} select word, term, typos::int as typos from swapped""",
    "search_ranked": f"""with {RANKED} select qid, place, id, url, domain, language, words, typos::bigint as typos,
        proximity::bigint as proximity, attribute, exact, rank_score from rk""",
    "search_prefix": f"""with {BEGUN} select qid, place, id, url, domain, language, words, typos::bigint as typos,
        proximity::bigint as proximity, attribute, exact, rank_score from rk""",
    "search_facets": f"""with {MATCHES} select qid, 'domain' as facet, domain as value, count(*) as n from mt group by 1, 3
      union all select qid, 'language', language, count(*) from mt group by 1, 3""",
    "search_facet_maps": f"""with {MATCHES},
        fd as (select qid, domain as v, count(*) as n from mt group by 1, 2),
        fl as (select qid, language as v, count(*) as n from mt group by 1, 2)
      select qid, d.s as domain, l.s as language from
        (select qid, string_agg(v || '=' || n, ',' order by v) as s from fd group by 1) d join
        (select qid, string_agg(v || '=' || n, ',' order by v) as s from fl group by 1) l using (qid)""",
    "search_snippets": f"with {SNIPPETS} select * from rs",
    "search_display": f"""with {SNIPPETS} select qid, place, url, coalesce(nullif(title, ''), url) as heading,
        coalesce(nullif(snippet, ''), nullif(meta_description, ''), 'No description.') as summary from rs""",
    "robots_filter": f"""with {PG}, p as (select page_id, url, {site('url')} as s, regexp_replace(url, '^[a-z]+://[^/?#]*', '') as path,
          regexp_extract(url, '^[a-z]+://[^/]+/([^/?]*)', 1) as part from pg),
        r as (select s, min(part) as lo, max(part) as hi from p group by 1)
      select page_id, url, case when lo = 'de' then not starts_with(path, '/en/3')
        else case when starts_with(path, '/' || lo || '/1') then false when starts_with(path, '/' || lo) then true
          when starts_with(path, '/' || hi || '/2') then false else true end end as allowed
      from p join r using (s)""",
    "fetch_schedule": f"""with {DP}, q as (select url, {host('url')} as domain,
          (length(regexp_replace(url, '[^/]', '', 'g')) - 2)::int as depth from dp),
        t as (select *, row_number() over (partition by domain order by depth, url) as host_turn from q),
        g as (select *, row_number() over (order by (host_turn - 1) * 1.5, depth, url) as global_turn from t)
      select url, domain, depth, host_turn, global_turn,
        greatest((host_turn - 1) * 1.5, floor((global_turn - 1) / 60) * 60.0)::double as fetch_at from g""",
    "address_filter": f"""with {PG}, h as (select domain, md5(domain) as m from (select distinct {host('url')} as domain from pg)),
        o as (select *, substr(m, 1, 1) as k, ('0x' || substr(m, 2, 2))::int as a, ('0x' || substr(m, 4, 2))::int as b,
          ('0x' || substr(m, 6, 2))::int as c, ('0x' || substr(m, 8, 2))::int as d from h),
        x as (select domain, k, m, case k when '0' then '10' when '1' then '172' when '2' then '192' when '3' then '127'
            when '4' then '100' else a::varchar end as o1,
          case k when '2' then 168 when '3' then 0 when '0' then a when '1' then a when '4' then a else b end as o2,
          case k when '2' then b when '3' then 0 when '0' then b when '1' then b when '4' then b else c end as o3,
          case when k in ('0', '1', '2', '3', '4') then c else d end as o4 from o),
        y as (select domain, case k when '5' then 'fe80::' || substr(m, 3, 4) when '6' then '2001:db8::' || substr(m, 3, 4)
            when '7' then 'not-an-address' else o1 || '.' || o2 || '.' || o3 || '.' || o4 end as address,
          case when k in ('5', '7') then true when k = '6' then false else
            o1 in ('10', '127') or (o1 = '172' and o2 between 16 and 31) or (o1 = '192' and o2 = 168)
            or (o1 = '169' and o2 = 254) or (o1 = '100' and o2 between 64 and 127) end as private from x)
      select domain, address, private, not private as fetchable from y""",
    "fetch_outcomes": f"with {LOG} select event_id, url, outcome from fl",
    "domain_stats": f"""with {LOG} select domain, count(*) filter (outcome = 'crawled') as crawled,
        count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'error') as errors from fl group by 1""",
    "crawl_counters": f"""with {LOG}, {LINKS}, {CUSTOMERS} select
        (select count(*) from fl where outcome = 'crawled') as total_crawled,
        (select count(*) from fl where outcome = 'skipped') as total_skipped,
        (select count(*) from fl where outcome = 'error') as total_errors,
        (select count(*) from lk) as links_recorded,
        (select count(*) from (select distinct source_url, target_url from lk)) as links_distinct,
        (select count(*) from cp where indexed_at is null or crawled_at > indexed_at) as queue_depth,
        (select count(*) from cp where indexed_at is not null and deleted_at is null) as indexed_total""",
    "retry_effects": f"""with {LOG}, f as (select url, count(*) filter (outcome = 'error') as n from fl group by 1)
      select url, case when n between 1 and 3 then length(url) % 3 else -1 end::int as queued_at, n not between 1 and 3 as is_visited,
        n > 3 as is_deleted from f""",
    "corpus_language": f"""with {GRAPH}, lang_of as (with {identify(f"(select url, {visible('html', BODY)} as text from dp)", "url")})
      select url, language from lang_of union all select url, '-' from st""",
    "retry_state": f"""with {LOG} select url, f as failures,
        case when f = 0 then 'none' when f <= 3 then 'requeue' else 'failed' end as decision
      from (select url, count(*) filter (outcome = 'error') as f from fl group by 1)""",
    "score_histogram": """with b as (select unnest([0, 10, 20, 50, 100, 200, 500, 1000]) as b)
      select b::varchar as le, (select count(*) from events where value <= b) as n,
        (select round(sum(value), 2) from events) as total, (select count(value) from events) as observations from b
      union all select '+Inf', count(value), round(sum(value), 2), count(value) from events""",
    "config_overlay": """select event_id, case when event_type <> 'error' then (props->>'$.k')::int else 3 end as max_depth,
        1.0::double as delay_per_domain, true as save_to_db,
        case when event_type <> 'error' then props->>'$.k' else '-' end as nested_k,
        case when event_type <> 'error' then 10 else 9 end as settings from events""",
    "stream_window_counts": """select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) as n from events
      where date_trunc('day', ts) + interval 1 day <= (select max(ts) - interval 1 hour from events) group by 1, 2""",
    "stream_ingest": f"""with {LINKS}, n as (select source_url as url, count(distinct target_url) as links from lk group by 1)
      select url, {host('url')} as domain, 0 as depth, false as is_stub, coalesce(links, 0) as links,
        sha256({title('html')} || {visible('html', BODY)}) as content_hash from dp left join n using (url)
      union all select url, {STUB_DOMAIN}, -1, true, 0, '-' from
        (select distinct target_url as url from lk where target_url not in (select url from dp))""",
    "stream_retry": """select 'u' || user_id as url, count(*) as failures,
        case when count(*) <= 3 then 'requeue' else 'failed' end as decision
      from events where event_type = 'error' group by 1""",
    "stream_index_sync": f"""with {PG}, l as (select * from pg qualify row_number() over (partition by url order by page_id desc) = 1),
        b as (select page_id as id, url, {title('html')} as title, {main_text('html')} as body from l
          where url not in (select url from pg where page_id % 11 = 0))
      select id, url, title, epoch({TS})::double as crawled_at, 1.0::double as rank_score,
        sha256(body) as body_hash, round({ease('body')}, 6) as reading_ease, {us(TS)} as indexed_at from b""",
    "stream_postings": f"""with {PG},
        ev as (select url, page_id, 1 as batch, false as gone, html from pg
          union all select url, page_id, 2, true, '' from pg where page_id % 11 = 0
          union all select url, page_id, 3, false, html || '<p>These words came with the second crawl of the page.</p>' from pg
            where page_id % 7 = 0 and page_id % 11 <> 0),
        l as (select * from ev qualify row_number() over (partition by url order by batch desc, page_id desc) = 1),
        doc as (select page_id as id, {title('html')} as title, {main_text('html')} as body_text, '' as meta_description from l where not gone),
        {POSTINGS} select term, id, field, pos::int as pos from post""",
    "stream_recent_retries": """with f as (select 'u' || user_id as url, ts, lag(ts) over (partition by user_id order by ts) as before
        from events where event_type = 'error'),
        r as (select url, sum(case when ts - before > interval 30 hours then 1 else 0 end) over (partition by url order by ts) as run from f),
        n as (select url, run, count(*) as failures from r group by 1, 2)
      select url, failures, case when failures <= 3 then 'requeue' else 'failed' end as decision from n
      qualify run = max(run) over (partition by url)""",
    "latency_histogram": """with b as (select unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]::double[]) as b)
      select b::varchar as le, (select count(*) from events where value / 10 <= b) as n,
        (select round(sum(value / 10), 2) from events) as total, (select count(value) from events) as observations from b
      union all select '+Inf', count(value), round(sum(value / 10), 2), count(value) from events""",
}
ORACLES["page_store_upsert"] = f"select * exclude (id) from ({ORACLES['page_upsert']})"
