"""Queries for response audits and page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import DB_ERROR_PATTERNS, ENTITY_INDICATORS, INTERNAL_INDICATORS, JS_ENDPOINT_PATTERNS, UNIX_FILE_INDICATORS, WINDOWS_FILE_INDICATORS
from wardlight.operators import pages as pages_op
from wardlight.operators import web_audit as web
from wardlight.registry.core import query
from wardlight.views import duck, lit, values

CHECKS = {k: v for table in (web.HEADER_CHECKS, web.COOKIE_CHECKS, web.METHOD_CHECKS) for k, v in table.items()}
META = {"meta": "select k as \"check\", severity, cvss_score::double as cvss_score, cwe, owasp, confidence from (" + values([(k, *v) for k, v in CHECKS.items()], "k, severity, cvss_score, cwe, owasp, confidence") + ")"}


@query("header_audit", duck("""
select f.resp_id, f.url, m.* from (
 select resp_id, url, unnest(list_filter([
  case when h_hsts is null then 'hsts_missing' end,
  case when try_cast(regexp_extract(h_hsts, 'max-age=([^;]*)', 1) as bigint) < 15768000 then 'hsts_max_age_short' end,
  case when h_hsts is not null and not contains(lower(h_hsts),'includesubdomains') then 'hsts_no_subdomains' end,
  case when h_csp is null then 'csp_missing' end,
  case when contains(h_csp,'unsafe-inline') then 'csp_unsafe_inline' end,
  case when contains(h_csp,'unsafe-eval') then 'csp_unsafe_eval' end,
  case when contains(h_csp,'default-src *') or (h_csp is not null and not contains(h_csp,'default-src ''none''') and not contains(h_csp,'script-src')) then 'csp_permissive' end,
  case when h_xfo is null and not contains(coalesce(lower(h_csp),''),'frame-ancestors') then 'frame_missing' end,
  case when h_xfo is not null and upper(h_xfo) not in ('DENY','SAMEORIGIN') and not contains(coalesce(lower(h_csp),''),'frame-ancestors') then 'frame_misconfigured' end,
  case when not contains(coalesce(lower(h_xcto),''),'nosniff') then 'nosniff_missing' end,
  case when h_referrer is null then 'referrer_missing' end,
  case when lower(h_referrer) in ('unsafe-url','no-referrer-when-downgrade') then 'referrer_permissive' end,
  'permissions_missing',
  case when regexp_matches(lower(coalesce(h_server,'')), 'apache|nginx|iis|tomcat|lighttpd') then 'server_banner' end,
  case when not contains(coalesce(h_cache,''),'no-store') and not contains(coalesce(h_cache,''),'private') then 'cache_control' end
 ], lambda x: x is not null)) as "check" from responses) f join meta m on m."check" = f."check" """, "responses", **META).replace("select f.resp_id, f.url, m.*", "select f.resp_id, f.url, m.\"check\", m.severity, m.cvss_score, m.cwe, m.owasp, m.confidence"))
def header_audit(t):
    return web.header_audit(t.responses())


COOKIES = ["page_id as resp_id", "concat('c', cast(page_id % 5 as string)) as name", "page_id % 2 = 0 as http_only", "page_id % 3 = 0 as secure",
           "case page_id % 4 when 0 then 'Strict' when 1 then 'lax' when 2 then 'None' end as same_site"]


@query("cookie_audit", duck("""
select f.resp_id, f.name, m."check", m.severity, m.cvss_score, m.cwe, m.owasp, m.confidence from (
 select resp_id, name, unnest(list_filter([case when not http_only then 'cookie_http_only' end, case when not secure then 'cookie_secure' end,
  case when coalesce(lower(same_site),'') not in ('strict','lax') then 'cookie_same_site' end], lambda x: x is not null)) as "check" from cookies) f join meta m on m."check" = f."check" """,
    cookies="select " + ", ".join(COOKIES) + " from pages", **META))
def cookie_audit(t):
    return web.cookie_audit(t.pages().selectExpr(*COOKIES))


@query("cors_audit", duck("""
select resp_id, url, case when contains(h_acao,'https://probe.example') then 'reflected' else 'wildcard' end as kind, h_acao as allow_origin from responses
where h_acac = 'true' and (contains(h_acao,'https://probe.example') or h_acao = '*')""", "responses"))
def cors_audit(t):
    return web.cors_audit(t.responses(), "https://probe.example")


SENT = "case resp_id % 7 when 0 then 'TRACE' when 1 then 'PUT' when 2 then 'DELETE' when 3 then 'connect' else method end"


@query("methods_audit", duck(f"""
select f.resp_id, f.url, m."check", f.methods, m.severity, m.cvss_score, m.cwe, m.owasp, m.confidence from (
 select resp_id, url, upper(m0) as m1, case when upper(m0) = 'OPTIONS' then array_to_string(list_filter(['TRACE','PUT','DELETE','CONNECT'], lambda x: contains(upper(h_allow), x)), ', ') else upper(m0) end as methods
 from (select *, {SENT} as m0 from responses)
 where (upper(m0) = 'OPTIONS' and status not in (0,400,405) and h_allow is not null) or (upper(m0) = 'TRACE' and status = 200 and contains(body,'track('))
  or (upper(m0) = 'PUT' and status in (200,201,204)) or (upper(m0) = 'DELETE' and status in (200,204)) or (upper(m0) = 'CONNECT' and status in (200,201))) f join meta m on m."check" = f.m1 """, "responses", **META))
def methods_audit(t):
    return web.methods_audit(t.responses().withColumn("method", F.expr(SENT)), "track(")


ERROR_BODY = ("concat(body, case resp_id % 8 when 0 then ' ORA-01756: Quoted string not properly terminated' when 1 then ' You have an error in your SQL syntax; check the manual that fits your MySQL version'"
              " when 2 then ' org.postgresql.util.PSQLException: ERROR: syntax error at or near' when 3 then ' Microsoft OLE DB Provider for SQL Server' when 4 then ' sqlite3.OperationalError' else '' end)")


def _first(patterns, what):
    return "case " + " ".join(f"when regexp_matches(b, {lit(p)}) then {what(i, p)}" for i, p in enumerate(patterns)) + " end"


@query("db_error_scan", duck(
    f"select resp_id, url, ({_first(DB_ERROR_PATTERNS, lambda i, p: str(i + 1))})::int as pattern_no, {_first(DB_ERROR_PATTERNS, lambda i, p: f'regexp_extract(b, {lit(p)})')} as matched"
    f" from (select resp_id, url, lower({ERROR_BODY}) as b from responses) where " + " or ".join(f"regexp_matches(b, {lit(p)})" for p in DB_ERROR_PATTERNS), "responses"))
def db_error_scan(t):
    return web.db_error_scan(t.responses().withColumn("body", F.expr(ERROR_BODY)))


MARK_BODY = "concat(body, case resp_id % 6 when 0 then ' root:x:0:0:root' when 1 then ' [BOOT LOADER] x' when 2 then ' <b>Redis Version 7</b>' when 3 then ' [extensions]' when 4 then ' daemon:x: /bin/sh' else '' end)"


def _contains_first(words, fold):
    e = lambda w: f"contains({'lower(b)' if fold else 'b'}, {lit(w.lower() if fold else w)})"
    return "case " + " ".join(f"when {e(w)} then {lit(w)}" for w in words) + " end"


@query("indicator_scan", duck(
    f"select * from (select resp_id, url, 'file' as kind, coalesce({_contains_first(UNIX_FILE_INDICATORS, False)}, {_contains_first(WINDOWS_FILE_INDICATORS, True)}) as indicator from marked"
    f" union all select resp_id, url, 'entity', {_contains_first(ENTITY_INDICATORS, False)} from marked union all select resp_id, url, 'internal', {_contains_first(INTERNAL_INDICATORS, True)} from marked) where indicator is not null",
    "responses", marked=f"select resp_id, url, {MARK_BODY} as b from responses"))
def indicator_scan(t):
    return web.indicator_scan(t.responses().withColumn("body", F.expr(MARK_BODY)))


INPUT = "case when resp_id % 3 = 0 then concat('zz', cast(resp_id as string)) else substring(body, 30, 12) end"


@query("reflection_check", duck(f"select resp_id, url, i as input from (select *, {INPUT} as i from responses) where i <> '' and contains(body, i)", "responses"))
def reflection_check(t):
    return web.reflection_check(t.responses().withColumn("input", F.expr(INPUT))).select("resp_id", "url", "input")


EXPECTED = "cast(7 * (resp_id % 10) as string)"


@query("expected_value_check", duck(f"select resp_id, url, e as expected from (select *, {EXPECTED} as e from responses) where contains(body, e)", "responses"))
def expected_value_check(t):
    return web.expected_value_check(t.responses().withColumn("expected", F.expr(EXPECTED))).select("resp_id", "url", "expected")


@query("baseline_exclude", duck(f"""
select r.resp_id, r.url, r.e as expected from (select *, {EXPECTED} as e from responses) r where contains(r.body, r.e)
 and not exists (select 1 from responses b where b.resp_id + 1 = r.resp_id and contains(b.body, r.e))""", "responses"))
def baseline_exclude(t):
    r = t.responses()
    hits = web.expected_value_check(r.withColumn("expected", F.expr(EXPECTED)))
    base = r.select((F.col("resp_id") + 1).alias("resp_id"), "body")
    return web.baseline_exclude(hits, base, ["resp_id"]).select("resp_id", "url", "expected")


CHAIN = "case when resp_id % 10 = 3 then array('https://a.example/', concat('https://other.example/', cast(resp_id as string))) else array(url) end"


@query("redirect_check", duck(
    "select resp_id, url, case when contains(h_location,'other.example') then 'Location header: ' || h_location else 'Redirect chain included: https://other.example/' || cast(resp_id as varchar) end as evidence"
    " from responses where contains(h_location,'other.example') or resp_id % 10 = 3", "responses"))
def redirect_check(t):
    return web.redirect_check(t.responses().withColumn("redirects", F.expr(CHAIN)), "other.example")


HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


@query("latency_anomaly", duck(
    f"select r.resp_id, r.host, r.ms, b.m as baseline_ms from (select *, {HOST} as host from responses) r join (select {HOST} as host, min(ms) as m from responses group by 1) b on b.host = r.host where r.ms >= 4500 and r.ms >= b.m + 3000", "responses"))
def latency_anomaly(t):
    r = t.responses().select("resp_id", F.expr(HOST).alias("host"), "ms")
    base = r.groupBy("host").agg(F.min("ms").alias("baseline_ms"))
    return web.latency_anomaly(r, base, "host")


def _pairs(t):
    return t.responses().select(F.col("resp_id").alias("pair_id"), F.col("resp_id").alias("a_id"), (F.col("resp_id") + 1).alias("b_id"))


# every page next to itself with a small change, so that status and length leave some pairs open
NEAR = "case when resp_id % 4 = 0 then replace(body, 'a', 'e') when resp_id % 4 = 1 then concat(body, ' ok') else body end"


def near_pairs(t):
    r = t.responses()
    b = r.select(F.col("resp_id").alias("b_id"), F.col("url").alias("b_url"), F.expr("cast(case when resp_id % 9 = 0 then 503 else status end as int)").alias("b_status"), F.expr(NEAR).alias("b_body"))
    a = r.select(F.col("resp_id").alias("pair_id"), F.col("url").alias("a_url"), F.col("status").alias("a_status"), F.col("body").alias("a_body"))
    return a.join(b, F.col("pair_id") == F.col("b_id"))


@query("response_diff", duck("""
select a.resp_id as pair_id, a.status <> b.status as status_changed, abs(length(a.body) - length(b.body))::int as length_delta, a.status <> b.status or abs(length(a.body) - length(b.body)) >= 20 as significant
from responses a join responses b on b.resp_id = a.resp_id + 1""", "responses"))
def response_diff(t):
    return web.response_diff(web.response_pairs(t.responses(), _pairs(t)), similarity=False)


SIMILARITY_SQL = f"""
 select pair_id, case when sum(x + y) > 0 then 2 * sum(least(x, y)) / sum(x + y)::double else 1.0 end as similarity from (
  select pair_id, w, count(*) filter (where side = 'a') as x, count(*) filter (where side = 'b') as y from (
   select pair_id, 'a' as side, unnest(list_filter(regexp_split_to_array(a_body, '[^0-9A-Za-z_]+'), lambda v: v <> '')) as w from near
   union all select pair_id, 'b', unnest(list_filter(regexp_split_to_array(b_body, '[^0-9A-Za-z_]+'), lambda v: v <> '')) from near) group by 1, 2) group by 1"""
NEAR_SQL = f"select resp_id as pair_id, url as a_url, status as a_status, body as a_body, url as b_url, case when resp_id % 9 = 0 then 503 else status end as b_status, {NEAR} as b_body from responses"


@query("sequence_similarity", duck(f"""
select pair_id, changed as status_changed, delta as length_delta, case when not decided then round(coalesce(similarity, 1.0), 9) end as similarity, decided or round(coalesce(similarity, 1.0), 9) <= 0.95 as significant
from (select *, changed or delta >= 20 as decided from (select pair_id, a_status <> b_status as changed, abs(length(a_body) - length(b_body))::int as delta from near)) left join ({SIMILARITY_SQL}) using (pair_id)""", "responses", near=NEAR_SQL))
def sequence_similarity(t):
    """Full comparison with the word overlap for the pairs that status and length leave open."""
    return web.response_diff(near_pairs(t)).withColumn("similarity", F.round("similarity", 9))


@query("edit_similarity", duck(f"""
select resp_id as pair_id, round(1 - levenshtein(url, b) / greatest(length(url), length(b))::double, 6) as similarity from (select *, replace(url, 'a', 'ei') as b from responses)""", "responses"))
def edit_similarity(t):
    """Addresses next to changed ones; an edit distance is for short values, bodies go through the word overlap."""
    return t.responses().select(F.col("resp_id").alias("pair_id"), F.round(web.edit_similarity(F.col("url"), F.expr("replace(url, 'a', 'ei')")), 6).alias("similarity"))


@query("diff_evidence", duck(f"""
select pair_id, printf('Boolean difference in parameter ''q'': true %s status %d length %d, false %s status %d length %d, delta %d, similarity %.2f%%', a_url, a_status, length(a_body), b_url, b_status, length(b_body),
 abs(length(a_body) - length(b_body)), round(coalesce(similarity, 1.0), 6) * 100) as evidence from near left join ({SIMILARITY_SQL}) using (pair_id)""", "responses", near=NEAR_SQL))
def diff_evidence(t):
    return web.diff_evidence(near_pairs(t), "q")


@query("canary_echo", duck(
    "select resp_id, url, c as canary from (select resp_id, url, b, case when resp_id % 2 = 0 then concat('track(', cast(resp_id as varchar), ')') else 'id-none' end as c from (select *, body as b from responses)) where contains(b, c)", "responses"))
def canary_echo(t):
    r = t.responses()
    issued = r.select("resp_id", F.expr("case when resp_id % 2 = 0 then concat('track(', cast(resp_id as string), ')') else 'id-none' end").alias("canary"))
    return web.canary_echo(r, issued)


@query("canary_callback", duck("""
select p.canary, p.probe_id, c.callback_id, p.issued_at, c.received_at from probes p join callbacks c on regexp_extract(c.path,'id-[0-9]+') = p.canary
 and c.received_at between p.issued_at and p.issued_at + interval 30 minute""", "probes", "callbacks"))
def canary_callback(t):
    return web.canary_callback(t.probes(), t.callbacks(), 1800).select("canary", "probe_id", "callback_id", "issued_at", "received_at")


# ---------------------------------------------------------------------------- pages
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("page_links", duck(f"""
select page_id, url, case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h else {ORIGIN} || h end as target from (select page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) as h from more)
where h <> '' and not regexp_matches(h, '^(javascript:|mailto:|tel:|#)') and (starts_with(h,'/') or regexp_extract(h, '^[a-z]+://([^/?#]*)', 1) = regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))""",
    more="select page_id, url, html || '<a class=\"x\" href=\"mailto:a@b\">m</a><a href=\"#top\">t</a><a href=\"' || url || '\">self</a><a href=\"https://elsewhere.example/\">e</a>' as html from pages"))
def page_links(t):
    more = t.pages().withColumn("html", F.expr("concat(html, '<a class=\"x\" href=\"mailto:a@b\">m</a><a href=\"#top\">t</a><a href=\"', url, '\">self</a><a href=\"https://elsewhere.example/\">e</a>')"))
    return pages_op.page_links(more)


FORM_TEXT = ("concat(html, '<form action=\"/find', cast(page_id % 7 as string), '\"', case when page_id % 2 = 0 then ' method=\"post\"' else '' end, '><input name=\"q\" value=\"v', cast(page_id as string), '\"><input type=\"submit\" name=\"go\"><textarea name=\"note\"></textarea></form>',"
             " case when page_id % 5 = 0 then '<form action=\"https://elsewhere.example/x\"><input name=\"a\"></form>' else '<form><select name=\"s\"></select><input type=\"hidden\" name=\"t\" value=\"1\"></form>' end)")


@query("page_forms", duck(f"""
select page_id, 0 as pos, {ORIGIN} || '/find' || cast(page_id % 7 as varchar) as url, case when page_id % 2 = 0 then 'POST' else 'GET' end as method,
 case when page_id % 2 = 0 then 'q:body:v' || cast(page_id as varchar) || ' note:body:' else 'q:query:v' || cast(page_id as varchar) || ' note:query:' end as params from pages
union all select page_id, 1, url, 'GET', 's:query: t:query:1' from pages where page_id % 5 <> 0"""))
def page_forms(t):
    f = pages_op.page_forms(t.pages().withColumn("html", F.expr(FORM_TEXT)))
    text = F.array_join(F.transform("params", lambda p: F.concat_ws(":", p["name"], p["location"], p["default"])), " ")
    return f.select("page_id", "pos", "url", "method", text.alias("params"))


@query("page_scripts", duck(f"""
select page_id, url, 'inline' as kind, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as value from pages
union all select page_id, url, 'src', {ORIGIN} || '/static/app' || cast(page_id as varchar) || '.js' from pages"""))
def page_scripts(t):
    more = t.pages().withColumn("html", F.expr("concat(html, '<script src=\"/static/app', cast(page_id as string), '.js\"></script><script src=\"https://cdn.example/x.js\"></script>')"))
    return pages_op.page_scripts(more)


SCRIPT_TEXT = ("concat('fetch(\"/api/items/', cast(page_id as string), '\"); axios.post(\"/save?x=1\", d); axios.get(\"/list', cast(page_id % 9 as string), '\"); $.ajax({type: 1, url: \"/old', cast(page_id % 3 as string), '\"}); const API_URL = \"', case when page_id % 2 = 0 then 'https://elsewhere.example/a' else '/base' end, '\"; go(\"/v2/users\"); q(\"/graphql\"); fetch(`/tmpl/a`); r(\"relative/x\")')")


@query("js_endpoints", duck(f"""
select distinct page_id, url, case when starts_with(c,'http') then c else {ORIGIN} || c end as endpoint from (select page_id, url, unnest(['/api/items/' || cast(page_id as varchar), '/list' || cast(page_id % 9 as varchar), '/old' || cast(page_id % 3 as varchar), '/v2/users', '/graphql', '/tmpl/a']) as c from pages
 union all select page_id, url, '/base' from pages where page_id % 2 = 1)"""))
def js_endpoints(t):
    return pages_op.js_endpoints(t.pages().select("page_id", "url", F.expr(SCRIPT_TEXT).alias("value")))


SITEMAP = "concat('<urlset><url><loc> ', url, '</loc></url><url><loc>https://elsewhere.example/a</loc></url><url><loc>', regexp_extract(url, '^[a-z]+://[^/?#]*', 0), '/m', cast(page_id as string), '</loc></url></urlset>')"


@query("sitemap_urls", duck(f"""
select host, target from (select distinct {HOST} as host, url as target from pages union select {HOST}, {ORIGIN} || '/m' || cast(page_id as varchar) from pages)"""))
def sitemap_urls(t):
    return pages_op.sitemap_urls(t.pages().select("url", F.expr(SITEMAP).alias("body")))


ROBOTS = "concat('User-agent: *\\nDisallow: /admin', cast(page_id % 3 as string), '\\nAllow: /pub*\\nDisallow: relative\\nDisallow: /d', cast(page_id as string))"


@query("robots_paths", duck(f"""
select distinct url, {ORIGIN} || p as target from (select url, unnest(['/admin' || cast(page_id % 3 as varchar), '/pub', '/d' || cast(page_id as varchar)]) as p from pages)"""))
def robots_paths(t):
    return pages_op.robots_paths(t.pages().select("url", F.expr(ROBOTS).alias("body")))


REQUEST = [
    "page_id as seq", "url as page_url", "case when page_id % 4 = 3 then 'https://elsewhere.example/x' else concat(regexp_extract(url, '^[a-z]+://[^/?#]*', 0), '/call', cast(page_id % 6 as string), '?t=1') end as url",
    "'post' as method", "case when page_id % 2 = 0 then concat('id=', cast(page_id as string), '&name=a%20b&empty=') end as post_data",
]


@query("recorded_request_endpoints", duck(f"""
select page_id as seq, 'POST' as method, {ORIGIN} || '/call' || cast(page_id % 6 as varchar) || '?t=1' as url, case when page_id % 2 = 0 then 'id=' || cast(page_id as varchar) || ' name=a b' else '' end as params from pages where page_id % 4 <> 3"""))
def recorded_request_endpoints(t):
    e = pages_op.recorded_request_endpoints(t.pages().selectExpr(*REQUEST))
    return e.select("seq", "method", "url", F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["default"])), " ").alias("params"))


def all_endpoints(t):
    q = pages_op.query_endpoints(t.pages())
    r = pages_op.recorded_request_endpoints(t.pages().selectExpr(*REQUEST)).withColumn("seq", F.col("seq") + 1_000_000_000)
    return q, r


EP = {
    "rec": f"select page_id + 1000000000 as seq, 'POST' as method, {ORIGIN} || '/call' || cast(page_id % 6 as varchar) as url, page_id from pages where page_id % 4 <> 3",
    "qry": "select page_id as seq, 'GET' as method, rtrim(regexp_extract(url, '^[a-z]+://[^?#]*'), '/') as url, page_id, regexp_extract(url,'[?]([^#]*)',1) as q from pages where regexp_matches(url, '[?][^#=]*=[^#&]')",
}


@query("endpoint_union", duck("""
select seq, method || ':' || url as key from (select seq, method, url from rec union all select seq, method, url from qry) qualify row_number() over (partition by method || ':' || url order by seq) = 1""", **EP))
def endpoint_union(t):
    return pages_op.endpoint_union(*all_endpoints(t)).select("seq", "key")


@query("endpoint_merge", duck("""
select k.key, k.method, k.url, coalesce(p.params, '') as params from (select distinct method || ':' || url as key, method, url from (select method, url from rec union all select method, url from qry)) k
left join (select key, string_agg(name || '=' || value, ' ' order by seq, pos) as params from (
  select * from (select 'POST:' || url as key, seq, 1 as pos, 'id' as name, cast(page_id as varchar) as value from rec where page_id % 2 = 0 union all select 'POST:' || url, seq, 2, 'name', 'a b' from rec where page_id % 2 = 0
   union all select 'GET:' || url, seq, pos, url_decode(regexp_extract(kv,'^[^=]*')), url_decode(regexp_replace(kv,'^[^=]*=','')) from (select *, unnest(string_split(q,'&')) as kv, unnest(generate_series(1,len(string_split(q,'&')))) as pos from qry) where regexp_matches(kv,'^[^=]*=.'))
  qualify row_number() over (partition by key, name order by seq, pos) = 1) group by 1) p on p.key = k.key""", **EP))
def endpoint_merge(t):
    q, r = all_endpoints(t)
    m = pages_op.endpoint_merge(q.unionByName(r))
    return m.select("key", "method", "url", F.coalesce(F.array_join(F.transform("params", lambda p: F.concat(p["name"], F.lit("="), p["default"])), " "), F.lit("")).alias("params"))


@query("per_host_cap", duck(f"select host, url from (select distinct {HOST} as host, url from pages) qualify row_number() over (partition by host order by url) <= 2"))
def per_host_cap(t):
    return pages_op.per_host_cap(t.pages().select(F.expr(HOST).alias("host"), "url").distinct(), 2, ["url"])
