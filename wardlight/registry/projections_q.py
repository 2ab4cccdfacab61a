"""Queries for projections, filters and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import CLASS_CVSS, CONFIG_CHECK_BY_NAME, CRAWL_ASSET_SUFFIXES, LANGUAGE_BY_EXT, REPORT_CVSS, SCAN_ASSET_SUFFIXES
from wardlight.catalog.rules import rule_rows
from wardlight.functions import cols
from wardlight.operators import files as files_op
from wardlight.operators import findings as fnd
from wardlight.operators import lines as lines_op
from wardlight.registry.core import query
from wardlight.session import dealt
from wardlight.views import duck, lit, values

BASE = "regexp_replace(file,'^.*/','')"


@query("file_route", duck(
    f"select f.file, lower(regexp_extract({BASE},'\\.[^.]*$')) as ext, l.language, c.config_check from"
    " (select file from src_files union all select file from code_files) f"
    f" left join languages l on l.ext = lower(regexp_extract({BASE},'\\.[^.]*$')) left join cfg c on c.name = lower({BASE})",
    "src_files", "code_files", "languages", cfg=values(list(CONFIG_CHECK_BY_NAME.items()), "name, config_check")))
def file_route(t):
    return files_op.file_route(t.src_files().select("file").unionByName(t.code_files().select("file")))


def _kw(i):
    return [p for r in rule_rows() for p in r[i]]


KW = sorted(set(files_op.keywords(_kw(12))) | set(files_op.keywords(_kw(11))))


@query("prescan_gate", duck(
    "select file from src_files f where contains(content,'\"') or contains(content,'''') or contains(content,'`') or contains(content,'=')"
    " or exists (select 1 from kw where contains(lower(f.content), kw.w))", "src_files", kw=values([(w,) for w in KW], "w")))
def prescan_gate(t):
    return files_op.prescan_gate(t.src_files(), t.rules()).select("file")


@query("source_lines", duck("select file, line, text from src_lines", "src_lines"))
def source_lines(t):
    return t.src_lines().select("file", "line", "text")


RAW_WORDS = ("case l_linenumber when 1 then 'CRITICAL' when 2 then 'Error ' when 3 then 'warning' when 4 then 'medium'"
             " when 5 then ' INFO' when 6 then cast(null as string) else lower(l_shipmode_) end").replace("lower(l_shipmode_)", "concat('level ', l_returnflag, case when l_quantity > 25 then ' high' else ' low' end)")


def _dialect_sql(d):
    tests, exact, default, missing = fnd.DIALECTS[d]
    s = f"case when w is null or w = '' then '{missing}'"
    for texts, sev in tests:
        for x in texts:
            s += f" when {'lower(trim(w)) = ' + lit(x) if exact else 'contains(lower(trim(w)), ' + lit(x) + ')'} then '{sev}'"
    return s + f" else '{default}' end as sev_{d}"


@query("severity_normalize", duck(
    "select w as word, count(*) as n, " + ", ".join(_dialect_sql(d) for d in fnd.DIALECTS) + " from raw group by all",
    raw=f"select {RAW_WORDS} as w from lineitem"))
def severity_normalize(t):
    raw = t.read("lineitem").select(F.expr(RAW_WORDS).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return raw.select("word", "n", *[fnd.severity_normalize(F.col("word"), d).alias(f"sev_{d}") for d in fnd.DIALECTS])


RAW_PATH = ("case when line % 3 = 0 then concat('C:', chr(92), 'work', chr(92), 'temp', chr(92), 'u', cast(scan_id as string), chr(92), replace(file,'/',chr(92)))"
            " when line % 3 = 1 then concat('/var/temp/x/', file) else file end")


def _duck_norm(p):
    s = f"replace({p},chr(92),'/')"
    return f"case when regexp_matches({s}, '(^|/)temp(/|$)') then regexp_replace({s}, '^(.*?/)?temp(/[^/]*(/|$)|$)', '') else {s} end"


@query("path_normalize", duck(
    f"select seq, {RAW_PATH} as raw_path, {_duck_norm(RAW_PATH)} as path from findings", "findings"))
def path_normalize(t):
    return t.findings(heavy=True).select("seq", F.expr(RAW_PATH).alias("raw_path")).select("seq", "raw_path", fnd.path_normalize(F.col("raw_path")).alias("path"))


@query("finding_fingerprint", duck(
    "select seq, lower(hex('bandit:' || file || ':' || cast(line as varchar) || ':' || vuln_class)) as id,"
    " sha256('bandit:' || file || ':' || cast(line as varchar) || ':' || vuln_class) as digest from findings", "findings"))
def finding_fingerprint(t):
    args = (F.lit("bandit"), F.col("file"), F.col("line"), F.col("vuln_class"))
    return t.findings(heavy=True).select("seq", fnd.fingerprint(*args).alias("id"), fnd.fingerprint(*args, digest=True).alias("digest"))


RAW_FINDING = [
    "case when line % 11 = 0 then '' else 'Bandit' end as tool", f"case when line % 13 = 0 then cast(null as string) else {RAW_PATH} end as file",
    "case when line % 7 = 0 then cast(null as bigint) else line end as line", "case when line % 17 = 0 then '  ' else concat('  ', vuln_class, ' ') end as issue",
    "case when line % 5 = 0 then cast(null as string) when line % 5 = 1 then upper(severity) else severity end as severity",
]


@query("normalize_findings", duck(f"""
select lower(hex(tool || ':' || file_path || ':' || cast(start_line as varchar) || ':' || snippet)) as id, tool, severity, file_path, start_line, start_line as end_line, snippet from (
 select lower(coalesce(tool,'')) as tool, {_duck_norm("coalesce(file,'')")} as file_path, coalesce(line,0) as start_line, trim(coalesce(issue,'')) as snippet,
  case lower(trim(coalesce(severity,'Low'))) when 'medium' then 'Medium' when 'high' then 'High' else 'Low' end as severity from raw)
where tool <> '' and file_path <> '' and snippet <> ''""", "findings", raw="select " + ", ".join(RAW_FINDING) + " from findings"))
def normalize_findings(t):
    return fnd.normalize_findings(t.findings(heavy=True).selectExpr(*RAW_FINDING))


REPORT_SQL = [
    "c_custkey as report_id", "case when c_custkey % 2 = 0 then 'bandit' else 'semgrep' end as tool",
    "case when c_custkey % 12 = 11 then '{\"results\": [' when c_custkey % 2 = 0 then"
    " concat('{\"results\": [{\"filename\": \"src/a', cast(c_custkey as string), '.py\", \"line_number\": ', cast(c_nationkey as string), ', \"issue_text\": \"use of ', c_mktsegment,"
    " '\", \"issue_severity\": \"', case c_custkey % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end, '\"}, {\"filename\": null, \"line_number\": 1}, {\"line_number\": 2, \"issue_severity\": \"\"}]}')"
    " else concat('{\"results\": [{\"path\": \"src/b', cast(c_custkey as string), '.js\", \"extra\": {\"message\": \"', c_mktsegment, '\", \"severity\": \"',"
    " case c_custkey % 3 when 0 then 'ERROR' when 1 then 'WARNING' else 'INFO' end, '\"}}, {\"path\": \"null\", \"extra\": {}}, {\"path\": \"x.js\"}]}') end as content",
]


@query("standardize_tool_report", duck("""
select * from (select report_id, tool,
 case when tool = 'bandit' then case when json_exists(r,'$.filename') then r->>'$.filename' else 'unknown' end else case when json_exists(r,'$.path') then r->>'$.path' else 'unknown' end end as file,
 case when tool = 'bandit' then cast(r->>'$.line_number' as bigint) end as line,
 case when tool = 'bandit' then coalesce(r->>'$.issue_text','No description provided') else coalesce(r->>'$.extra.message','No description provided') end as issue,
 case when tool = 'bandit' then case upper(r->>'$.issue_severity') when 'HIGH' then 'High' when 'MEDIUM' then 'Medium' else 'Low' end
  else case upper(r->>'$.extra.severity') when 'ERROR' then 'High' when 'WARNING' then 'Medium' when 'INFO' then 'Low' else 'Medium' end end as severity
 from (select report_id, tool, unnest(cast(json_extract(content,'$.results[*]') as json[])) as r from rep where json_valid(content)))
where file is not null and file not in ('null','')""", rep="select " + ", ".join(REPORT_SQL) + " from customer"))
def standardize_tool_report(t):
    return fnd.standardize_tool_report(t.read("customer").selectExpr(*REPORT_SQL))


@query("cvss_resolve", duck("""
select f.seq, coalesce(f.cvss_score, c.v, case f.severity when 'Critical' then 9.5 when 'High' then 7.5 when 'Medium' then 5.0 when 'Low' then 2.0 when 'Info' then 0.5 end, 5.0)::double as cvss,
 r.score as report_score, r.vector as report_vector from findings f left join cc c on c.k = f.vuln_class left join rr r on r.k = f.vuln_class""",
    "findings", cc=values(list(CLASS_CVSS.items()), "k, v"), rr="select k, score::double as score, vector from (" + values([(k, *v) for k, v in REPORT_CVSS.items()], "k, score, vector") + ")"))
def cvss_resolve(t):
    score, vector = fnd.report_cvss(F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("vuln_class"))
    return t.findings(heavy=True).select("seq", fnd.cvss_resolve(F.col("cvss_score"), F.col("vuln_class"), F.col("severity")).alias("cvss"),
                               score.alias("report_score"), vector.alias("report_vector"))


@query("severity_from_cvss", duck(
    "select seq, case when v >= 9 then 'Critical' when v >= 7 then 'High' when v >= 4 then 'Medium' else 'Low' end as severity from (select seq, coalesce(cvss_score, line % 11) as v from findings)", "findings"))
def severity_from_cvss(t):
    return t.findings().select("seq", fnd.severity_from_cvss(F.coalesce("cvss_score", F.col("line") % 11)).alias("severity"))


LICENSE_HITS = "contains(text, 'token =') or contains(lower(text), 'license')"


@query("evidence_snippet", duck(f"""
select h.file, h.line, string_agg(case when l.line = h.line then '→ ' else '  ' end || cast(l.line as varchar) || ': ' || l.text, chr(10) order by l.line) as evidence
from (select distinct file, line from src_lines where {LICENSE_HITS}) h join src_lines l on l.file = h.file and l.line between h.line - 1 and h.line + 1 group by 1, 2""", "src_lines"))
def evidence_snippet(t):
    lines = t.src_lines()
    return lines_op.evidence_snippet(lines.filter(LICENSE_HITS), t.src_files())


@query("taint_trace_build", duck("""
select seq, max(trace_len) as steps, string_agg(cast(i as varchar) || '@' || cast(line + i as varchar) || ' ' || case when i = trace_len then left('Sink: ' || repeat(vuln_class || '(tainted) ', 20), 120) else 'Source of ' || vuln_class end, '|' order by i) as trace
from (select f.*, unnest(generate_series(1, trace_len)) as i from findings f) group by seq""", "findings"))
def taint_trace_build(t):
    # findings meet by key before they become steps: the steps of a finding are not shuffled
    steps = dealt(t.findings().select("seq", "line", "trace_len", "vuln_class"), "seq", grows=4).withColumn("ord", F.explode(F.expr("sequence(1, cast(trace_len as int))"))).select(
        "seq", "ord", (F.col("line") + F.col("ord")).alias("line"),
        F.when(F.col("ord") == F.col("trace_len"), lines_op.text_cap(F.concat(F.lit("Sink: "), F.repeat(F.concat("vuln_class", F.lit("(tainted) ")), 20)), 120))
        .otherwise(F.concat(F.lit("Source of "), "vuln_class")).alias("description"))
    tr = fnd.taint_trace_build(steps)
    text = F.transform("taint_trace", lambda x: F.concat(x["step"].cast("string"), F.lit("@"), x["line"].cast("string"), F.lit(" "), x["description"]))
    return tr.select("seq", F.size("taint_trace").cast("bigint").alias("steps"), F.array_join(text, "|").alias("trace"))


TOKEN = "(\\w+) = \"([0-9a-f]{40,})\""


@query("secret_evidence_mask", duck("""
select file, line, name || ' = "' || v || '"' as evidence,
 name || ' = "' || left(v,4) || repeat('*', length(v)-4) || '"' as masked
from (select file, line, regexp_extract(text, '(\\w+) = "([0-9a-f]{40,})"', 1) as name, regexp_extract(text, '(\\w+) = "([0-9a-f]{40,})"', 2) as v from src_lines) where v <> ''""", "src_lines"))
def secret_evidence_mask(t):
    hit = t.src_lines().select("file", "line", F.regexp_extract("text", TOKEN, 1).alias("name"), F.regexp_extract("text", TOKEN, 2).alias("v")).filter("v <> ''")
    return hit.select("file", "line", fnd.secret_evidence(F.col("name"), F.col("v"), mask=False).alias("evidence"), fnd.secret_evidence(F.col("name"), F.col("v")).alias("masked"))


ASSET_URL = ("case page_id % 6 when 1 then concat(regexp_replace(url, '[?#].*$', ''), '.PNG?v=1') when 2 then concat(regexp_replace(url, '[?#].*$', ''), '.json')"
             " when 3 then concat(regexp_replace(url, '[?#].*$', ''), '.exe') else url end")


def _asset_sql(suffixes):
    return "regexp_matches(lower(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$')"


@query("static_asset_filter", duck(
    f"select page_id, u as url, 'scan' as list from p where not {_asset_sql(SCAN_ASSET_SUFFIXES)} union all select page_id, u as url, 'crawl' as list from p where not {_asset_sql(CRAWL_ASSET_SUFFIXES)}",
    p=f"select page_id, {ASSET_URL} as u from pages"))
def static_asset_filter(t):
    p = t.pages().select("page_id", F.expr(ASSET_URL).alias("url"))
    a = files_op.static_asset_filter(p, SCAN_ASSET_SUFFIXES).withColumn("list", F.lit("scan"))
    return a.unionByName(files_op.static_asset_filter(p, CRAWL_ASSET_SUFFIXES).withColumn("list", F.lit("crawl")))


@query("endpoint_normalize", duck(
    "select page_id, 'GET:' || rtrim(regexp_extract(url, '^[a-z]+://[^?#]*'), '/') as key from pages"))
def endpoint_normalize(t):
    return t.pages().select("page_id", cols.endpoint_key(F.lit("get"), F.col("url")).alias("key"))


@query("query_params", duck("""
select page_id, name, value from (
 select page_id, pos, url_decode(regexp_extract(kv,'^[^=]*')) as name, url_decode(regexp_replace(kv,'^[^=]*=','')) as value,
  row_number() over (partition by page_id, url_decode(regexp_extract(kv,'^[^=]*')) order by pos) as rn
 from (select page_id, unnest(string_split(q,'&')) as kv, unnest(generate_series(1,len(string_split(q,'&')))) as pos
   from (select page_id, regexp_extract(url || case when contains(url,'#') then '' else case when contains(url,'?') then '&page=7&a%20b=c%2Fd&empty=' else '' end end, '[?]([^#]*)', 1) as q from pages)) where regexp_matches(kv,'^[^=]*=.'))
where rn = 1"""))
def query_params(t):
    url = F.expr("concat(url, case when contains(url,'#') then '' else case when contains(url,'?') then '&page=7&a%20b=c%2Fd&empty=' else '' end end)")
    return t.pages().select("page_id", F.explode(cols.query_pairs(cols.url_part(url, "QUERY"))).alias("p")).select("page_id", "p.name", "p.value")


@query("text_cap", duck(
    "select file, line, " + ", ".join(f"substring(text,1,{n}) as t{n}" for n in (80, 120, 500)) + " from src_lines where length(text) > 80", "src_lines"))
def text_cap(t):
    return t.src_lines().filter("length(text) > 80").select("file", "line", *[lines_op.text_cap(F.col("text"), n).alias(f"t{n}") for n in (80, 120, 500)])
