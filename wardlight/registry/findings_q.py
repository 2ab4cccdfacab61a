"""Queries for scores, dedup, dashboards, windows and the cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import cache as cache_op
from wardlight.operators import dedup, history, ordered, scoring, secrets
from wardlight.operators import findings as fnd
from wardlight.operators import lines as lines_op
from wardlight.catalog.fixed import CLASS_CVSS, SECRET_PATTERNS
from wardlight.registry.core import query
from wardlight.registry.sources_q import scratch_folder
from wardlight.views import duck, lit, values

COUNTS = ", ".join(f"count(*) filter (where severity = '{s}') as n_{s.lower()}" for s in ("Critical", "High", "Medium", "Low", "Info"))
CC = values(list(CLASS_CVSS.items()), "k, v")
RESOLVED = "coalesce(f.cvss_score, (select v from cc where k = f.vuln_class), case f.severity when 'Critical' then 9.5 when 'High' then 7.5 when 'Medium' then 5.0 when 'Low' then 2.0 when 'Info' then 0.5 end, 5.0)::double"
GRADE = "case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end"
SCORED = f"""
select s.*, greatest(0, 100 - 15*n_critical - 10*n_high - 5*n_medium - 2*n_low)::bigint as score from (
 select scan_id, scan_type, coalesce(n_critical,0) as n_critical, coalesce(n_high,0) as n_high, coalesce(n_medium,0) as n_medium, coalesce(n_low,0) as n_low,
  coalesce(n_info,0) as n_info, coalesce(n_findings,0) as n_findings, round_even(coalesce(m,0.0),1) as max_cvss
 from scans left join (select scan_id, {COUNTS}, count(*) as n_findings, max({RESOLVED}) as m from findings f group by 1) using (scan_id)) s"""


@query("severity_counts", duck(f"select scan_id, {COUNTS} from findings group by 1", "findings"))
def severity_counts(t):
    return scoring.severity_counts(t.findings())


@query("scan_score", duck(f"select scan_id, scan_type, n_critical, n_high, n_medium, n_low, n_info, n_findings, max_cvss, score, {GRADE} as grade from ({SCORED})", "findings", "scans", cc=CC))
def scan_score(t):
    return scoring.scan_score(t.scans().select("scan_id", "scan_type"), t.findings())


@query("scan_score_worst", duck(
    f"select scan_id, greatest(0, floor(100 - 10*coalesce(m, 0.0)))::bigint as score from scans left join (select scan_id, max({RESOLVED}) as m from findings f group by 1) using (scan_id)", "findings", "scans", cc=CC))
def scan_score_worst(t):
    return scoring.scan_score_worst(t.scans().select("scan_id"), t.findings())


@query("findings_per_file", duck("select file, count(*) as n_findings from findings group by 1", "findings"))
def findings_per_file(t):
    return scoring.findings_per_file(t.findings())


@query("dashboard_type_severity", duck(f"select scan_type, {COUNTS} from findings join scans using (scan_id) group by 1", "findings", "scans"))
def dashboard_type_severity(t):
    return history.type_severity(t.scans(), t.findings())


AS_OF = "2024-01-31 00:00:00"


@query("dashboard_trend", duck("""
select d.day::date as day, st.scan_type, coalesce(n,0)::bigint as n_findings from (select unnest(generate_series(date '2024-01-25', date '2024-01-31', interval 1 day)) as day) d
 join (select unnest(['sast','dast','port','secret','dependency']) as scan_type) st on true
 left join (select s.ts::date as day, scan_type, count(f.seq) as n from scans s left join findings f using (scan_id) group by 1, 2) x on x.day = d.day::date and x.scan_type = st.scan_type""", "findings", "scans"))
def dashboard_trend(t):
    return history.trend(t.scans(), t.findings(), AS_OF)


@query("dashboard_trend_first_week", duck("""
select d.day::date as day, st.scan_type, coalesce(n,0)::bigint as n_findings from (select unnest(generate_series(date '2024-01-01', date '2024-01-07', interval 1 day)) as day) d
 join (select unnest(['sast','dast','port','secret','dependency']) as scan_type) st on true
 left join (select s.ts::date as day, scan_type, count(f.seq) as n from scans s left join findings f using (scan_id) group by 1, 2) x on x.day = d.day::date and x.scan_type = st.scan_type""", "findings", "scans"))
def dashboard_trend_first_week(t):
    return history.trend(t.scans(), t.findings(), "2024-01-07 00:00:00")


@query("dashboard_summary", duck("""
select total_scans, average_score, case when average_score >= 75 then 'Low' when average_score >= 50 then 'Medium' when average_score >= 25 then 'High' else 'Critical' end as risk, minutes_since from (
 select count(*) as total_scans, floor(avg(score) + 0.5)::bigint as average_score, floor(epoch(timestamp '2024-01-31 00:00:00' - max(ts)) / 60)::bigint as minutes_since from scans)""", "scans"))
def dashboard_summary(t):
    return history.summary(t.scans(), AS_OF)


@query("recent_scans", duck(f"""
select s.scan_id, s.scan_type, s.ts, s.target, s.score, coalesce(n_critical,0) as n_critical, coalesce(n_high,0) as n_high, coalesce(n_medium,0) as n_medium, coalesce(n_low,0) as n_low, coalesce(n_info,0) as n_info
from (select * from scans order by ts desc, scan_id desc limit 5) s left join (select scan_id, {COUNTS} from findings group by 1) using (scan_id)""", "findings", "scans"))
def recent_scans(t):
    return history.recent_scans(t.scans(), t.findings())


@query("history_card", duck(f"""
select scan_id, scan_type, case scan_type when 'sast' then 'Code Scan' when 'dast' then 'External Scan' when 'port' then 'Port Scan' when 'secret' then 'Secret Scan' else scan_type end as label,
 n_critical, n_high, n_medium, n_low, n_info, n_findings, max_cvss, score, {GRADE} as grade from ({SCORED})""", "findings", "scans", cc=CC))
def history_card(t):
    return history.history_card(t.scans(), t.findings())


# ---------------------------------------------------------------------------- dedup and windows
@query("dedup_shortest_trace", duck("""
select seq, file, rule_id, line, trace_len, 'rule' as by_key from findings qualify row_number() over (partition by file, rule_id, line order by trace_len, seq) = 1
union all select seq, file, vuln_class, line, trace_len, 'class' from findings qualify row_number() over (partition by file, vuln_class, line order by trace_len, seq) = 1""", "findings"))
def dedup_shortest_trace(t):
    f = t.findings().select("seq", "file", "rule_id", "vuln_class", "line", "trace_len")
    a = dedup.dedup_shortest_trace(f).select("seq", "file", "rule_id", "line", "trace_len", F.lit("rule").alias("by_key"))
    b = dedup.dedup_shortest_trace(f, per_file_class=True).select("seq", "file", F.col("vuln_class").alias("rule_id"), "line", "trace_len", F.lit("class").alias("by_key"))
    return a.unionByName(b)


@query("dedup_first_seen", duck("select seq, file, line from findings qualify row_number() over (partition by file, line order by seq) = 1", "findings"))
def dedup_first_seen(t):
    return dedup.dedup_first_seen(t.findings().select("seq", "file", "line"), ["file", "line"])


WORD_PATTERNS = [("token", 'token = "[0-9a-f]+"'), ("license", "[Ll]icen[sc]e"), ("digits", "[0-9]{12,}"), ("hash", "#{3}"), ("end", "\\.$")]


@query("first_match_wins", duck(
    "select file, line, case " + " ".join(f"when regexp_matches(text, '{p}') then '{n}'" for n, p in WORD_PATTERNS) + " end as pattern from src_lines where "
    + " or ".join(f"regexp_matches(text, '{p}')" for n, p in WORD_PATTERNS), "src_lines"))
def first_match_wins(t):
    return t.src_lines().select("file", "line", dedup.first_match(F.col("text"), WORD_PATTERNS).alias("pattern")).filter("pattern is not null")


@query("ssa_version", duck(
    "select file, line, name, name || '_' || cast(v as varchar) as versioned, v as version from (select file, line, name, row_number() over (partition by file, name order by line) as v from span_events where kind = 'def')", "span_events"))
def ssa_version(t):
    d = ordered.running_number(t.span_events().filter("kind = 'def'").select("file", "line", "name"), ["file", "name"], "line", "version", chunk=1000)
    return d.withColumn("versioned", F.concat("name", F.lit("_"), F.col("version").cast("string")))


@query("reaching_definition", duck(
    "select file, line, name, d as def_line from (select *, max(case when kind = 'def' then line end) over (partition by file, name order by line rows between unbounded preceding and 1 preceding) as d from span_events) where kind = 'use'", "span_events"))
def reaching_definition(t):
    e = t.span_events().select("file", "line", "name", "kind")
    d = ordered.last_before(e, ["file", "name"], "line", F.when(F.col("kind") == "def", F.col("line")), "def_line", chunk=1000)
    return d.filter("kind = 'use'").drop("kind")


@query("line_event_order", duck(
    "select file, line, kind, kind_ord, seq, name from (select file, line // 3 as line, 'assignment' as kind, 0 as kind_ord, line as seq, name from span_events where kind = 'def'"
    " union all select file, line // 3, 'call', 1, line, event_type from span_events where kind = 'use')", "span_events"))
def line_event_order(t):
    e = t.span_events().withColumn("seq", F.col("line")).withColumn("line", F.expr("line div 3"))
    return lines_op.line_event_order(e.filter("kind = 'def'"), e.filter("kind = 'use'").withColumn("name", F.col("event_type")))


@query("findings_union", duck("""
select 'taint' as part, seq, rule_id, line, cast(null as varchar) as url from findings where severity = 'Critical'
union all select 'pattern', seq, rule_id, line, cast(null as varchar) from findings where severity <> 'Critical'
union all select 'header', cast(page_id as varchar), 'header_rule', null, url from pages""", "findings"))
def findings_union(t):
    f = t.findings()
    a = f.filter("severity = 'Critical'").select(F.lit("taint").alias("part"), "seq", "rule_id", "line")
    b = f.filter("severity <> 'Critical'").select(F.lit("pattern").alias("part"), "seq", "rule_id", "line")
    c = t.pages().select(F.lit("header").alias("part"), F.col("page_id").cast("string").alias("seq"), F.lit("header_rule").alias("rule_id"), "url")
    return fnd.findings_union(a, b, c)


# ---------------------------------------------------------------------------- cache
VALID = "rule_hash = 'cur' and try_cast(stored_at as timestamp) >= timestamp '2024-01-31 00:00:00' - interval 10 day"


@query("scan_cache_load", duck(f"select k, access_count, stored_at, doc_id from scan_cache where {VALID}", "scan_cache"))
def scan_cache_load(t):
    return cache_op.scan_cache_load(t.scan_cache(), "cur", AS_OF, 10).select("k", "access_count", "stored_at", "doc_id")


def doc_keys(t):
    return t.read("documents").select("doc_id", cache_op.content_key(F.col("source"), F.col("doc_id").cast("string"), F.col("text")).alias("k"))


DUCK_KEYS = "select doc_id, sha256(concat(source,cast(doc_id as varchar),text)) as k from documents"


@query("cache_lookup", duck(f"select doc_id, k, exists (select 1 from older_cache c where c.k = d.k and {VALID}) as hit from keys d", "older_cache", keys=DUCK_KEYS))
def cache_lookup(t):
    return cache_op.cache_lookup(doc_keys(t), cache_op.scan_cache_load(t.older_cache(), "cur", AS_OF, 10))


@query("cache_misses", duck(f"select doc_id from keys where k not in (select k from older_cache where {VALID})", "older_cache", keys=DUCK_KEYS))
def cache_misses(t):
    return cache_op.cache_misses(doc_keys(t), cache_op.scan_cache_load(t.older_cache(), "cur", AS_OF, 10)).select("doc_id")


CONTACTS = [("contact_phone", r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}"), ("contact_mail", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+")]
LINES = "select doc_id, file, text, unnest(string_split(text, chr(10))) as line_text, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from (select doc_id, source || '/' || doc_id || '.txt' as file, replace(text, chr(13) || chr(10), chr(10)) as text from documents)"
MATCHES = " union all ".join(f"select file, doc_id, line, '{r}' as rule_id, unnest(regexp_extract_all(line_text, {lit(p)}, 0)) as match from lines" for r, p in CONTACTS)


@query("incremental_scan", duck(f"select file, line, rule_id, match, doc_id % 3 <> 0 as cached from ({MATCHES})", lines=LINES))
def incremental_scan(t):
    """A first scan of the documents that were there, then one of all of them: what was stored comes back, the rest is scanned."""
    docs = t.read("documents")
    files = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"), F.col("text").alias("content"), "doc_id")
    folder = scratch_folder(t, "results")
    digest = F.sha2(F.lit(str(CONTACTS)), 256)
    digest = t.spark.range(1).select(digest).first()[0]
    scan = lambda f: secrets.detect_secret_patterns(lines_op.source_lines(f), CONTACTS).select("file", "line", "rule_id", "match")
    cache_op.incremental_scan(files.filter("doc_id % 3 <> 0").select("file", "content"), scan, digest, folder, AS_OF)
    return cache_op.incremental_scan(files.select("file", "content"), scan, digest, folder, AS_OF)[0]


@query("cache_evict_topn", duck("select k, access_count from scan_cache order by access_count desc, k limit 100", "scan_cache"))
def cache_evict_topn(t):
    return cache_op.cache_evict(t.scan_cache(), 100).select("k", "access_count")


@query("cache_trim_half", duck(
    "select k, stored_at from (select *, row_number() over (order by coalesce(epoch(try_cast(stored_at as timestamp)), -1) desc, k) as rn, count(*) over () as n from scan_cache) where rn <= n // 2", "scan_cache"))
def cache_trim_half(t):
    return cache_op.cache_trim_half(t.scan_cache()).select("k", "stored_at")


@query("scan_cache_save", duck("select k, rule_hash, access_count, stored_at, doc_id from scan_cache", "scan_cache"))
def scan_cache_save(t):
    path = cache_op.scan_cache_save(t.scan_cache(), scratch_folder(t, "cache"))
    return cache_op.load_version(t.spark, path)


@query("cache_stats", duck(f"""
select hits, total - hits as misses, total, round(100.0*hits/total, 1) as hit_rate, (select count(*) from scan_cache where {VALID}) as stored,
 (select count(*) from scan_cache) - (select count(*) from scan_cache where {VALID}) as evicted
from (select count(*) as total, count(*) filter (where k in (select k from scan_cache where {VALID})) as hits from keys)""", "scan_cache", keys=DUCK_KEYS))
def cache_stats(t):
    cache = t.scan_cache()
    good = cache_op.scan_cache_load(cache, "cur", AS_OF, 10)
    return cache_op.cache_stats(cache_op.cache_lookup(doc_keys(t), good), good, cache.join(good.select("k"), "k", "left_anti"))
