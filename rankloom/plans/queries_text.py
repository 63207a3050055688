"""Registered queries: URLs, pools, dates, text, prompts, verdicts, planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import labels as L
from ..functions import prompts as P
from ..functions import text as T
from ..functions import urls as U
from ..functions.binding import with_rules
from ..operators import extraction, latest, planning, pool, requests
from ..operators.pages import date_pages
from .queries_score import _todo
from .registry import query, step
from .views import NOW, Views

_P = r"(?is)^(https?|wss?|ftp)://([^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\s<>^|%]+)(:\d*)?(/[^?#]*)?(\?[^#]*)?(#.*)?$"
_TRACK = r"(?i)^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|igshid)(=.*)?$"


def sql_norm(src: str) -> str:
    """Adds norm and host to the rows of ``src`` (column url)."""
    return rf"""
select * exclude (s, sch, usr, hst, prt, pth, qry, ps, kept), regexp_replace(hst, '^www\.', '') as host,
 case when regexp_matches(s, '{_P}') then regexp_replace(sch || '://' || usr || hst ||
   case when prt = ':' or (sch = 'http' and prt = ':80') or (sch = 'https' and prt = ':443') then '' else prt end ||
   case when pth = '' then '/' else pth end ||
   case when len(kept) = len(ps) then qry when list_aggregate(kept, 'string_agg', '&') is null then '' else '?' || list_aggregate(kept, 'string_agg', '&') end,
   '/$', '') else s end as norm
from (select *, list_filter(ps, lambda p: not regexp_matches(p, '{_TRACK}')) as kept from
 (select *, lower(regexp_extract(s, '{_P}', 1)) as sch, regexp_extract(s, '{_P}', 2) as usr, lower(regexp_extract(s, '{_P}', 3)) as hst,
  regexp_extract(s, '{_P}', 4) as prt, regexp_extract(s, '{_P}', 5) as pth, regexp_extract(s, '{_P}', 6) as qry,
  string_split(substring(regexp_extract(s, '{_P}', 6), 2), '&') as ps from (select *, trim(url) as s from {src})))"""


step("norm_pages", sql_norm("pages"))
step("norm_sources", sql_norm("source_log"))


@query("f01_f03_urls", "select page_id, norm as url, host from norm_pages")
def f01(v):
    pages = v.pages.select("page_id", F.col("url").alias("raw"))
    return with_rules(pages, url=lambda: U.normalize_url(F.col("raw")), host=lambda: U.host(F.col("raw"))).drop("raw")


@query("f01_f04_canonical_pages", """
select seq, query_id, provider, cast(pos as bigint) as pos, norm as url, host, coalesce(content, snippet, '') as body from norm_sources where norm <> ''""")
def f04(v):
    return pool.canonical_pages(v.source_log).select("seq", "query_id", "provider", "pos", "url", "host", "body")


def nested_fetches(v: Views):
    """Fetch rows with their sources as the log nests them; p3 fails."""
    src = F.struct("seq", "title", "url", "published", "domain", "snippet", "content")
    return v.source_log.groupBy("query_id", "query", "provider").agg(
        F.array_sort(F.collect_list(src)).alias("sources"), F.min("seq").alias("seq")
    ).withColumn("error", F.when(F.col("provider") == "p3", F.lit("HTTP 500")))


@query("f02_returned_urls", """
select query_id, provider, string_agg(norm, ' ' order by first_at) as urls from
 (select query_id, provider, norm, min(seq) as first_at from norm_sources where norm <> '' group by 1, 2, 3) group by 1, 2""")
def f02(v):
    return nested_fetches(v).select("query_id", "provider", F.array_join(U.returned_urls(F.col("sources")), " ").alias("urls"))


@query("f37_safe_links", """
select page_id, n, case when n = 0 then url when n = 2 then url end as href from pages cross join (select i as n from range(3) t(i))""")
def f37(v):
    links = F.array(F.col("url"), F.concat(F.lit("javascript:"), F.col("url")), F.concat(F.lit("  "), F.col("url")))
    return v.pages.select("page_id", F.posexplode(links).alias("n", "link")).select("page_id", "n", U.safe_href(F.col("link")).alias("href"))


@query("f38_title_key", r"select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') as key from documents")
def f38(v):
    return v.documents.select("doc_id", T.title_key(F.col("text")).alias("key"))


# --- pool -------------------------------------------------------------------

_POOL = """
select query_id, norm as url, arg_min(query, seq) as query, arg_min(title, seq) as title, arg_min(domain, seq) as domain,
 arg_min(published, seq) filter (published is not null) as published,
 arg_max(provider, (length(coalesce(content, snippet, '')), -seq)) as content_from,
 arg_max(coalesce(content, snippet, ''), (length(coalesce(content, snippet, '')), -seq)) as content
from {src} group by 1, 2"""
step("pool", _POOL.format(src="norm_sources"))
step("pool_by", """
select query_id, norm as url, string_agg(provider, ',' order by first_at) as returned_by from
 (select query_id, norm, provider, min(seq) as first_at from norm_sources group by 1, 2, 3) group by 1, 2""")


def _with_by(df):
    return df.withColumn("returned_by", F.array_join("returned_by", ","))


@query("d09_pool", "select p.*, returned_by from pool p join pool_by b on p.query_id = b.query_id and p.url = b.url")
def d09(v):
    return _with_by(pool.build_pool(v.source_log))


step("ok_sources", """
select n.* exclude (seq), f.first * 100000000 + n.seq as seq from norm_sources n
 join (select query_id, provider, min(seq) as first from source_log group by 1, 2) f on n.query_id = f.query_id and n.provider = f.provider
where n.provider <> 'p3'""")
step("pool_ok_by", """
select query_id, norm as url, string_agg(provider, ',' order by first_at) as returned_by from
 (select query_id, norm, provider, min(seq) as first_at from ok_sources group by 1, 2, 3) group by 1, 2""")


@query("d10_pool_from_fetches", f"""
select p.*, returned_by from ({_POOL.format(src='ok_sources')}) p join pool_ok_by b on p.query_id = b.query_id and p.url = b.url""")
def d10(v):
    # seq inside a source is its own row's; the pool orders by the fetch row, then place.
    fetches = nested_fetches(v)
    bare = F.transform("sources", lambda s: s.dropFields("seq"))
    return _with_by(pool.pool_from_fetches(fetches.withColumn("sources", bare)))


@query("d11_judged_from", """
select query_id, url, max(length(coalesce(content, ''))) as judged_chars,
 arg_max(provider, (length(coalesce(content, '')), -seq)) as judged_from from source_log group by 1, 2""")
def d11(v):
    return pool.judged_from(v.source_log)


@query("a38_overlap_both_urls", """
select kind, k, count(*) as n_pages from
 (select 'normalised' as kind, count(distinct provider) as k from norm_sources group by query_id, norm
  union all select 'raw', count(distinct provider) from source_log group by query_id, url) group by 1, 2""")
def a38(v):
    pages = pool.canonical_pages(v.source_log)
    both = [
        pool.overlap(pages, col, 8).where("n_pages > 0").withColumn("kind", F.lit(kind))
        for kind, col in (("normalised", "url"), ("raw", "raw_url"))
    ]
    return both[0].unionByName(both[1])


# --- labels -----------------------------------------------------------------

_REFS = """
select c_custkey, case c_custkey % 6 when 0 then 'openai/gpt-' || cast(c_custkey as string) when 1 then 'fireworks/accounts/a/models/m' || cast(c_custkey as string)
 when 2 then 'plain-' || cast(c_custkey as string) when 3 then 'other/lab/' || cast(c_custkey as string) when 4 then 'groq/' else 'anthropic/c' end as ref from {customer}"""
step("refs", _REFS.replace("{customer}", "customer"))


def refs(v):
    return v.sql(_REFS)


@query("f09_f10_model_refs", """
select c_custkey, ref, case when split_part(ref, '/', -1) = '' then ref else split_part(ref, '/', -1) end as label,
 case when contains(ref, '/') and split_part(ref, '/', 1) in ('openai', 'fireworks', 'groq', 'anthropic') then split_part(ref, '/', 1) else 'openai' end as lab,
 case when contains(ref, '/') and split_part(ref, '/', 1) in ('openai', 'fireworks', 'groq', 'anthropic')
  then substring(ref, instr(ref, '/') + 1) else ref end as model from refs""")
def f09(v):
    r = F.col("ref")
    return refs(v).select("c_custkey", "ref", L.judge_label(r).alias("label"), L.model_lab(r).alias("lab"), L.model_name(r).alias("model"))


step("aged", """
select seq, case when published is not null then cast(date_diff('day', cast(published as date), date '2026-08-18') as bigint) end as days from source_log""")


@query("f32_f35_score_display", """
select a.seq, days, case when days is null then 'undated' when days < 1 then 'today' when days < 60 then cast(days as varchar) || 'd ago'
  else cast(cast(floor(days / 30.0 + 0.5) as bigint) as varchar) || 'mo ago' end as age,
 case when days is null then '—' when days < 60 then cast(days as varchar) || 'd' else cast(cast(floor(days / 30.0 + 0.5) as bigint) as varchar) || 'mo' end as med,
 case when days is null then 'neutral' when days <= 30 then 'good' when days <= 180 then 'warning' else 'critical' end as fresh,
 cast(greatest(0, least(10, floor(n_chars / 700.0 - 1 + 0.5))) as bigint) as step
from aged a join documents d on a.seq = d.doc_id""")
def f32(v):
    days = D.age_days(F.col("published"), F.lit(NOW).cast("timestamp"))
    rows = v.source_log.select("seq", days.alias("days")).join(v.documents.select(F.col("doc_id").alias("seq"), "n_chars"), "seq")
    d = F.col("days")
    return rows.select(
        "seq", "days", L.age_label(d).alias("age"), L.median_label(d).alias("med"), L.fresh_status(d).alias("fresh"),
        L.score_step(F.col("n_chars") / F.lit(700.0) - 1).alias("step"),
    )


_WINDOWED = """
select o_orderkey, o_orderdate, case o_orderkey % 4 when 0 then '24h' when 1 then '30d' when 2 then '1y' else 'all' end as freshness from {orders}"""
step("windowed", _WINDOWED.replace("{orders}", "orders"))


@query("f39_freshness_window", """
select o_orderkey, freshness, case freshness when '24h' then 'qdr:d' when '30d' then 'qdr:m' when '1y' then 'qdr:y' else '' end as code from windowed
where freshness = 'all' or o_orderdate >= timestamp '2001-01-01' - case freshness when '24h' then interval 1 day when '30d' then interval 30 day else interval 365 day end""")
def f39(v):
    start = L.window_start(F.col("freshness"), F.lit("2001-01-01").cast("timestamp"))
    rows = v.sql(_WINDOWED).where(start.isNull() | (F.col("o_orderdate") >= start))
    return rows.select("o_orderkey", "freshness", L.freshness_code(F.col("freshness")).alias("code"))


@query("f40_finite_guards", """
select event_id, case event_id % 4 when 0 then value end as number, coalesce(case when event_id % 2 = 0 then event_type end, '') as txt from events""")
def f40(v):
    raw = (
        F.when(F.col("event_id") % 4 == 0, F.col("value").cast("string")).when(F.col("event_id") % 4 == 1, "NaN")
        .when(F.col("event_id") % 4 == 2, "Infinity").otherwise("n/a")
    )
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_type"))
    return v.events.select("event_id", L.finite(raw).alias("number"), L.text_or_blank(text).alias("txt"))


# --- dates ------------------------------------------------------------------

_DATED = """
select doc_id, 'p' || cast(doc_id % 8 as string) as provider, doc_id % 700 as n,
 case doc_id % 10 when 0 then cast(date '2026-08-18' - cast(doc_id % 700 as int) as string) || 'T04:27:42Z'
  when 1 then cast(doc_id % 700 as string) || ' days ago' when 2 then cast(doc_id % 90 as string) || ' weeks ago, edited'
  when 3 then 'Posted ' || case doc_id % 3 when 0 then 'January' when 1 then 'Sept.' else 'mar' end || ' ' || cast(1 + doc_id % 28 as string) || ', 2024'
  when 4 then 'Yesterday' when 5 then 'soon' end as native,
 case when doc_id % 10 = 6 then cast(doc_id % 20 as string) || ' months ago - ' else '' end || source as snippet,
 case when doc_id % 10 = 7 then 'Written on Dec ' || cast(1 + doc_id % 28 as string) || ' 2023. ' else '' end || text as content,
 'https://x.example/' || case when doc_id % 10 = 8 then '2025/' || cast(1 + doc_id % 12 as string) || '/' || cast(1 + doc_id % 28 as string) || '/' else '' end || cast(doc_id as string) as url,
 '<html><head>' || case doc_id % 4 when 0 then '<meta content="x"><meta property="article:published_time" content="2024-02-03T00:00:00Z">'
  when 1 then '<meta name=''pubdate'' content=''2 days ago''>' when 2 then '<script>{{"datePublished": "1999-01-01"}}</script><time datetime="2021-05-06">' else '' end || '</head>' || text as html
from {documents}"""
step("dated", _DATED.replace("{documents}", "documents").replace("{{", "{").replace("}}", "}"))


@query("f11_f16_date_pages", """
with r as (select doc_id, provider,
 case doc_id % 10 when 0 then date '2026-08-18' - cast(n as int) when 1 then date '2026-08-18' - cast(n as int)
  when 2 then date '2026-08-18' - cast(7 * (doc_id % 90) as int)
  when 3 then make_date(2024, case doc_id % 3 when 0 then 1 when 1 then 9 else 3 end, 1 + doc_id % 28)
  when 4 then date '2026-08-17' when 6 then date '2026-08-18' - cast(30 * (doc_id % 20) as int)
  when 7 then make_date(2023, 12, 1 + doc_id % 28) when 8 then make_date(2025, 1 + doc_id % 12, 1 + doc_id % 28) end as d,
 case when doc_id % 10 <= 4 then 'native' when doc_id % 10 = 6 then 'snippet' when doc_id % 10 = 7 then 'content' when doc_id % 10 = 8 then 'url' else 'none' end as dated_by
from dated)
select doc_id, provider, cast(d as varchar) as published, dated_by, cast(date_diff('day', d, date '2026-08-18') as bigint) as age_days from r""")
def f11(v):
    now = F.lit(NOW).cast("timestamp")
    return date_pages(v.sql(_DATED), now).select("doc_id", "provider", "published", "dated_by", "age_days")


@query("f15_html_dates", """
select doc_id, case doc_id % 4 when 0 then '2024-02-03' when 1 then '2026-08-16' when 2 then '2021-05-06' end as published from dated""")
def f15(v):
    now = F.lit(NOW).cast("timestamp")
    return with_rules(v.sql(_DATED), published=lambda: D.date_from_html(F.col("html"), now)).select("doc_id", "published")


@query("f14_metadata_dates", """
select event_id, cast(case event_id % 4 when 0 then cast(ts as date) when 1 then date '2023-03-04' when 2 then cast(ts as date) - 1 end as varchar) as published from events""")
def f14(v):
    day = F.to_date("ts").cast("string")
    k = F.col("event_id") % 4
    meta = F.create_map(
        F.when(k == 0, F.lit("Article:Published_Time")).otherwise("x"), day,
        F.when(k == 1, F.lit("dateModified")).otherwise("y"), F.lit("March 4, 2023"),
        F.when(k == 2, F.lit("DATE")).otherwise("z"), F.date_sub("ts", 1).cast("string"),
        F.when(k == 0, F.lit("modifiedTime")).otherwise("w"), F.lit("2020-01-01"),
    )
    return v.events.select("event_id", D.date_from_metadata(meta, F.lit(NOW).cast("timestamp")).alias("published"))


# --- text -------------------------------------------------------------------

_WS = r"[\s\x{00a0}]"


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_CLEAN = sql_trim(
    rf"regexp_replace(regexp_replace(replace(content, chr(13), ''), '(?m)^{_WS}*[-*]?{_WS}*\[[^\]]*\]\([^)]*\){_WS}*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
)


@query("f17_clean_markdown", f"""
select doc_id, case when length(t) > 1600 then substring(t, 1, 1600) || '…' else t end as text from (select doc_id, {_CLEAN} as t from doc_texts)""")
def f17(v):
    return v.doc_texts.select("doc_id", T.clean_markdown(F.col("content")).alias("text"))


_DETAG = "html"
for _tag in ("head", "script", "style", "noscript", "svg"):
    _DETAG = rf"regexp_replace({_DETAG}, '(?is)<{_tag}\b[^>]*>.*?</{_tag}>', ' ', 'g')"
_DETAG = rf"regexp_replace({_DETAG}, '(?s)<!--.*?-->', ' ', 'g')"
_DETAG = rf"regexp_replace({_DETAG}, '(?i)</(p|div|li|h[1-6]|tr|section|article|br)\s*>', chr(10), 'g')"
_DETAG = rf"regexp_replace({_DETAG}, '<[^>]+>', ' ', 'g')"
for _name, _char in [("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("mdash", "—"), ("hellip", "…"), ("amp", "&")]:
    _DETAG = f"replace({_DETAG}, '&{_name};', '{_char}')"
_DETAG = rf"regexp_replace({_DETAG}, '[ \t\x{{00a0}}]+', ' ', 'g')"
_DETAG = rf"regexp_replace({_DETAG}, '\n[ \t]+', chr(10), 'g')"
_DETAG = sql_trim(rf"regexp_replace({_DETAG}, '\n{{3,}}', chr(10) || chr(10), 'g')")


@query("f18_html_to_text", f"select page_id, {_DETAG} as text from pages")
def f18(v):
    pages = v.pages.select("page_id", "html")
    return with_rules(pages, text=lambda: T.strip_tags(F.col("html"))).select("page_id", "text")


@query("f19_challenge_class", r"""
select page_id, n, case when n = 1 then 'captcha' when n = 0 then 'markup' else 'ok' end as challenge from pages cross join (select i as n from range(3) t(i))""")
def f19(v):
    from ..sources.serp import page_challenges

    kinds = F.array(
        F.col("html"), F.concat(F.lit("<TITLE> Captcha</TITLE>"), F.col("html")),
        F.concat(F.col("html"), F.lit("<ul class=results-standard>")),
    )
    pages = v.pages.select("page_id", F.posexplode(kinds).alias("n", "html"))
    return page_challenges(pages, "html", "page_id", "n")


@query("f20_f21_text_flags", r"""
select doc_id, regexp_matches(content, '(?m)^#{1,6}\s') as headings, regexp_matches(content, '\[[^\]]+\]\([^)]+\)') as links,
 regexp_matches(content, '!\[') as images, regexp_matches(content, '(?m)^\|[\s:|-]+\|\s*$') as tables, content like '%…' as truncated from doc_texts""")
def f20(v):
    t = F.col("content")
    return v.doc_texts.select(
        "doc_id", T.has_headings(t).alias("headings"), T.has_links(t).alias("links"), T.has_images(t).alias("images"),
        T.has_tables(t).alias("tables"), T.was_truncated(t).alias("truncated"),
    )


_ATTEMPTS = """
select 'u' || cast(cast(floor(event_id / 2) as bigint) as string) as url, event_id % 2 + 1 as attempt,
 case when event_type in ('view', 'click') then repeat('x', cast(user_id % 90 as int)) else '' end as body,
 case when event_type = 'error' then case cast(floor(value * 100) as bigint) % 3 when 0 then 'This operation was aborted' when 1 then 'Unlocker 502: bad' else 'socket hang up' end end as error
from {events}"""
step("attempts", _ATTEMPTS.replace("{events}", "events"))


@query("f22_extraction_outcome", """
with c as (select *, case when error is null and length(body) > 40 then 'content' when error is null then 'empty' when error like '%abort%' then 'timeout'
 when error like 'Unlocker%' then 'http_error' else 'network' end as class from attempts),
t as (select *, case when attempt = 2 or class in ('content', 'timeout', 'http_error') then attempt else 9 end as o from c)
select url, attempt, case when class = 'content' then body end as content, case when class <> 'content' then class end as miss
from (select *, row_number() over (partition by url order by o) as rn from t) where rn = 1""")
def f22(v):
    return extraction.extraction_outcomes(v.sql(_ATTEMPTS))


# --- prompts and requests ---------------------------------------------------

_BODY = "coalesce(content, snippet, '')"
step("src_numbered", f"""
select *, {_BODY} as body, row_number() over (partition by query_id, provider order by seq) as i,
 title || ' (' || domain || ')' || coalesce(' — ' || published, '') as dated_title from source_log""")


@query("f23_context", f"""
select query_id, provider, string_agg('[' || cast(i as varchar) || '] ' || title || ' (' || domain || ')' || chr(10) || body, chr(10) || chr(10) order by i) as context
from src_numbered group by 1, 2""")
def f23(v):
    return nested_fetches(v).select("query_id", "provider", P.context(F.col("sources")).alias("context"))


JUDGE_REFS = ["openai/gpt-x", "fireworks/accounts/a/models/m1", "anthropic/claude-x"]
step("page_reqs", """
select query_id, url, 'Question: ' || query || chr(10) || chr(10) || 'Page: ' || title || chr(10) || 'Domain: ' || domain || chr(10) || 'Published: ' ||
 coalesce(published, 'unknown date') || chr(10) || chr(10) || 'Content:' || chr(10) || case when content = '' then '(no content extracted)' else substring(content, 1, 1600) end as prompt from pool""")
step("judge_refs", "select * from (values ('openai/gpt-x', 'gpt-x', 'openai'), ('fireworks/accounts/a/models/m1', 'm1', 'sync'), ('anthropic/claude-x', 'claude-x', 'anthropic')) t(model, judge, route)")
step("page_requests", """
select query_id, url, prompt, model, judge, route, cast(ceil(length(prompt) / 4.0) as bigint) + 1024 as tokens,
 substring(sha256(query_id || chr(0) || url || chr(0) || judge), 1, 32) as wire_id from page_reqs cross join judge_refs""")


def page_requests(v):
    judges = F.array(*[F.lit(j) for j in JUDGE_REFS])
    return planning.with_route(requests.page_requests(pool.build_pool(v.source_log), judges))


@query("f24_b1_page_requests", "select query_id, url, judge, prompt, tokens from page_requests")
def f24(v):
    return page_requests(v).select("query_id", "url", "judge", "prompt", "tokens")


@query("b03_request_routes", "select route, count(*) as n, cast(sum(tokens) as bigint) as tokens from page_requests group by 1")
def b03(v):
    return page_requests(v).groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


@query("b04_wire_ids", "select query_id, url, judge, wire_id from page_requests")
def b04(v):
    return page_requests(v).select("query_id", "url", "judge", "wire_id")


@query("b02_request_chunks", """
with recursive o as (select route, tokens, row_number() over (partition by route order by query_id, url, judge, wire_id) as i from page_requests),
r as (select route, i, tokens, 0 as chunk, 1 as n, tokens as used from o where i = 1 union all
 select o.route, o.i, o.tokens, case when r.n + 1 > 25 or r.used + o.tokens > 40000 then r.chunk + 1 else r.chunk end,
  case when r.n + 1 > 25 or r.used + o.tokens > 40000 then 1 else r.n + 1 end,
  case when r.n + 1 > 25 or r.used + o.tokens > 40000 then o.tokens else r.used + o.tokens end from r join o on o.route = r.route and o.i = r.i + 1)
select route, cast(chunk as bigint) as chunk, count(*) as n, cast(sum(tokens) as bigint) as tokens from r group by route, chunk""")
def b02(v):
    chunks = planning.chunk_requests(page_requests(v), ["query_id", "url", "judge"], max_tokens=40_000, max_requests=25, span_rows=500)
    return chunks.groupBy("route", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))


step("outcomes", """
select wire_id, query_id, url, judge, case when length(prompt) % 5 = 0 then null when length(prompt) % 5 = 1 then '{"rung": 9}' else '{"rung": ' || cast(length(prompt) % 4 as varchar) || '}' end as text,
 case when length(prompt) % 10 = 0 then 'rate limited' end as error from page_requests where length(prompt) % 15 <> 0""")


@query("b05_outcome_sweep", """
select r.query_id, r.url, r.judge, o.text, case when o.text is null then coalesce(o.error, 'no batch result') end as error
from page_requests r left join outcomes o on r.wire_id = o.wire_id""")
def b05(v):
    reqs = page_requests(v)
    n = F.length("prompt")
    text = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, '{"rung": 9}').otherwise(F.format_string('{"rung": %d}', n % 4))
    got = reqs.where(n % 15 != 0).select(
        "wire_id", text.alias("text"), F.when(n % 10 == 0, F.lit("rate limited")).alias("error"), F.lit(0).alias("seq")
    )
    return planning.match_outcomes(reqs, got).select("query_id", "url", "judge", "text", "error")


@query("f25_set_requests", """
select query_id, provider, 'Query: ' || min(query) || chr(10) || chr(10) || 'Fetched sources (title, domain — date, then extracted content):' || chr(10) ||
 string_agg('[' || cast(i as varchar) || '] ' || dated_title || chr(10) || case when body = '' then '(no content extracted)' else substring(body, 1, 1600) end, chr(10) || chr(10) order by i) as prompt
from src_numbered where provider <> 'p3' group by 1, 2""")
def f25(v):
    fetches = latest.judgeable_fetches(nested_fetches(v), F.size("sources"))
    return requests.set_requests(fetches, F.array(F.lit("x"))).select("query_id", "provider", "prompt")


@query("f26_run1_requests", """
select query_id, provider, 'Query: ' || min(query) || chr(10) || chr(10) || 'Fetched sources (domain — date, then extracted content):' || chr(10) ||
 string_agg('[' || cast(i as varchar) || '] ' || domain || ' — ' || coalesce(published, 'unknown date') || chr(10) || case when body = '' then '(no content extracted)' else substring(body, 1, 500) end, chr(10) || chr(10) order by i) as retrieval,
 'Query: ' || min(query) || chr(10) || chr(10) || 'Answer:' || chr(10) || 'answer of ' || provider || chr(10) || chr(10) || 'Sources it used:' || chr(10) ||
 string_agg('[' || cast(i as varchar) || '] ' || dated_title, chr(10) order by i) as answer
from src_numbered group by 1, 2""")
def f26(v):
    said = F.concat(F.lit("answer of "), F.col("provider"))
    return nested_fetches(v).select(
        "query_id", "provider", P.retrieval_request(F.col("query"), F.col("sources")).alias("retrieval"),
        P.answer_request(F.col("query"), said, F.col("sources")).alias("answer"),
    )


# --- verdicts ---------------------------------------------------------------

_RAW = """
select l_orderkey, l_partkey, l_linenumber, l_shipdate, l_suppkey, l_extendedprice, l_returnflag as judge, cast(floor(l_quantity) as int) % 6 as n,
 case l_linenumber
  when 1 then '{{"rung": ' || cast(cast(floor(l_quantity) as int) % 6 as string) || ', "score": ' || cast(cast(floor(l_quantity) as int) % 6 as string) || ', "verdict": " Knew ", "rationale": "plain"}}'
  when 2 then '```json' || chr(10) || '{{"rung": "' || cast(cast(floor(l_quantity) as int) % 6 as string) || '", "score": "' || cast(cast(floor(l_quantity) as int) % 6 as string) || '", "verdict": "wrong"}}' || chr(10) || '```'
  when 3 then 'It is this: {{"rung": ' || cast(cast(floor(l_quantity) as int) % 6 as string) || '.4, "score": ' || cast(cast(floor(l_quantity) as int) % 6 as string) || '.4, "verdict": "maybe", "rationale": "a brace }} inside"}}'
  when 4 then '{{"rung": null, "score": null}}' when 5 then '{{}}' when 6 then 'no idea' else '{{"rung": "high", "score": "high", "verdict": "unknown"}}' end as raw
from {lineitem}"""
step("raw_verdicts", _RAW.replace("{lineitem}", "lineitem").replace("{{", "{").replace("}}", "}"))
_KEYS = "l_orderkey, l_partkey, cast(l_linenumber as bigint) as l_linenumber, l_suppkey, l_extendedprice, cast(l_shipdate as date)::varchar as l_shipdate"


def _verdicts(v, kind):
    out = requests.parse_verdicts(v.sql(_RAW), kind)
    return out.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice",
        F.to_date("l_shipdate").cast("string").alias("l_shipdate"), "value", "rationale",
    )


def _scale_sql(field: str) -> str:
    return f"""
select {_KEYS}, cast(case when l_linenumber <= 3 and n <= 3 then n end as bigint) as value,
 case when l_linenumber = 6 then 'judge returned unparseable output' when l_linenumber > 3 or n > 3 then 'judge returned an out-of-range or missing {field}'
  when l_linenumber = 1 then 'plain' when l_linenumber = 3 then 'a brace }} inside' else '' end as rationale from raw_verdicts""".replace("}}", "}")


@query("f27_f28_rung_verdicts", _scale_sql("rung"))
def f28(v):
    return _verdicts(v, "rung")


@query("f29_set_verdicts", _scale_sql("score"))
def f29(v):
    return _verdicts(v, "set")


@query("f30_clamped_verdicts", f"""
select {_KEYS}, cast(case when l_linenumber <= 3 then n else 0 end as bigint) as value,
 case l_linenumber when 6 then 'judge returned unparseable output' when 1 then 'plain' when 3 then 'a brace }} inside' else '' end as rationale from raw_verdicts""".replace("}}", "}"))
def f30(v):
    return _verdicts(v, "clamped")


@query("f31_baseline_verdicts", f"""
select {_KEYS}, case l_linenumber when 1 then 'knew' when 2 then 'wrong' when 7 then 'unknown' end as value,
 case l_linenumber when 6 then 'grader returned unparseable output' when 1 then 'plain' when 2 then '' when 7 then '' else 'grader returned an unrecognised verdict' end as rationale from raw_verdicts""")
def f31(v):
    return _verdicts(v, "baseline")


# --- scorer -----------------------------------------------------------------

@query("x01_pluggable_scorer", """
select query_id, url, judge, cast(length(prompt) % 4 as double) as value, 'n=' || cast(length(prompt) as varchar) as rationale, cast(null as varchar) as error from page_requests""")
def x01(v):
    def by_length(batch):
        n = batch["prompt"].str.len()
        return batch.assign(value=n % 4, rationale="n=" + n.astype(str))

    reqs = page_requests(v).select("query_id", "url", "judge", "prompt")
    return requests.score_with(reqs, by_length, ["query_id", "url", "judge"])


@query("x01_landed_scorer", """
select r.query_id, r.url, r.judge, case when r.judge <> 'm1' then length(prompt) % 4 end as value, case when r.judge <> 'm1' then 'landed' end as rationale,
 case when r.judge = 'm1' then 'no batch result' end as error from page_requests r""")
def x01b(v):
    reqs = page_requests(v)
    landed = reqs.where("judge <> 'm1'").select("query_id", "url", "judge", (F.length("prompt") % 4).alias("value"), F.lit("landed").alias("rationale"))
    return requests.landed_scores(reqs, landed, ["query_id", "url", "judge"])


# --- cost -------------------------------------------------------------------

_RATES = """
select 'p' || cast(s_suppkey % 9 as string) as provider, case when s_suppkey % 9 < 6 then 20 end as per_call,
 case when s_suppkey % 9 < 6 then cast(floor(sum(s_acctbal)) as bigint) % 900 end as balance from {supplier} group by 1, 2, s_suppkey % 9"""
step("rates", _RATES.replace("{supplier}", "supplier"))
step("remaining", """
select t.* from todo t anti join (select query_id, provider from fetch_faults where fault not in ('transport', 'account')) d
 on t.query_id = d.query_id and t.provider = d.provider""")
step("estimate", """
select r.provider, count(m.query_id) as calls, per_call * count(m.query_id) as min_cost, per_call * count(m.query_id) * 3 as max_cost, balance,
 coalesce(per_call * count(m.query_id) * 3 > balance, false) as over_balance from rates r left join remaining m on r.provider = m.provider group by 1, per_call, balance""")


def estimate(v):
    from ..operators import dims

    todo = dims.remaining(_todo(v), latest.resumable_fetches(v.fetch_log), latest.FETCH_KEY)
    return planning.cost_estimate(todo, v.sql(_RATES))


@query("a47_cost_estimate", "select * from estimate")
def a47(v):
    return estimate(v)


@query("a48_affordable_calls", """
select o_orderkey, per as per_call, cast(floor(o_totalprice / (per * 3)) as bigint) as at_worst, cast(floor(o_totalprice / per) as bigint) as at_best
from (select *, cast(4 + case when o_orderstatus = 'F' then 2 * (3 + o_orderkey % 10) else 0 end as bigint) as per from orders)""")
def a48(v):
    per = planning.credits_per_call(3 + F.col("o_orderkey") % 10, F.when(F.col("o_orderstatus") == "F", "clean").otherwise("raw"))
    rows = v.orders.withColumn("per_call", per.cast("bigint"))
    worst, best = planning.calls_affordable(F.col("o_totalprice"), F.col("per_call"))
    return rows.select("o_orderkey", "per_call", worst.alias("at_worst"), best.alias("at_best"))


@query("a49_budget_gate", """
select cast(coalesce(sum(min_cost), 0) as bigint) as total_min, cast(coalesce(sum(max_cost), 0) as bigint) as total_max,
 count(*) filter (over_balance) as n_over_balance, coalesce(sum(max_cost), 0) > 100 as blocked from estimate""")
def a49(v):
    return planning.cost_totals(estimate(v), ceiling=100)
