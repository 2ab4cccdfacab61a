"""Queries for whole scans; their DuckDB side is put together from the texts of the single operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.rules import rule_rows
from wardlight.plans import response_scan, static_scan
from wardlight.plans.static_scan import DETECTORS
from wardlight.catalog.fixed import DB_ERROR_PATTERNS, ENTITY_INDICATORS, INTERNAL_INDICATORS, UNIX_FILE_INDICATORS, WINDOWS_FILE_INDICATORS
from wardlight.registry.core import ORACLES, query
from wardlight.registry.web_q import CHAIN, COOKIES, ERROR_BODY, MARK_BODY
from wardlight.views import duck, lit, values

PARTS = {n: ORACLES[n] for n in ("taint_paths", "detect_shell_true", "detect_weak_crypto", "secret_dispatch", "detect_redos",
                                 "detect_env_debug", "detect_privileged_container", "header_audit", "db_error_scan")}
SCAN_SQL = f"""
select h.file, h.line, h.rule_id, k.vuln_class, coalesce(h.sev, k.severity) as severity, coalesce(h.conf, k.confidence) as confidence, coalesce(k.cwe, '') as cwe, coalesce(k.owasp, '') as owasp,
 coalesce(k.remediation, '') as remediation, len(string_split(h.steps, ' > '))::int as trace_len, h.steps from (
 select file, line, rule_id, any_value(sev) as sev, any_value(conf) as conf, arg_min(steps, len(string_split(steps, ' > '))) as steps from (
 select file, sink_line as line, rule_id, cast(null as varchar) as sev, cast(null as varchar) as conf, steps from ({PARTS['taint_paths']})
 union all select file, line, rule_id, severity_override, confidence_override, line || ' used here' from ({PARTS['detect_shell_true']})
 union all select file, line, rule_id, null, null, line || ' used here' from ({PARTS['detect_weak_crypto']})
 union all select file, line, rule_id, null, null, line || ' used here' from ({PARTS['secret_dispatch']}) where file like 'src/u%' and not contains(lower(value),'your_key_here') and not contains(lower(value),'placeholder') and not contains(lower(value),'example')
 union all select file, line, 'redos_pattern', null, null, line || ' used here' from ({PARTS['detect_redos']}) where file like 'src/u%'
 union all select file, line, 'config_env_debug', null, null, line || ' used here' from ({PARTS['detect_env_debug']})
 union all select file, line, 'config_privileged', null, null, line || ' used here' from ({PARTS['detect_privileged_container']})
 union all select 'src/u' || cast(c_custkey as varchar) || '/package.json', null, 'config_outdated_package', null, null, ' used here' from customer where c_custkey % 28 = 26
 ) group by all
) h join known k on k.rule_id = h.rule_id"""
KNOWN = {"known": values([(r[0], r[2], r[3], r[8], r[4], r[5], r[-1]) for r in rule_rows()] + [(*d, None, None, None) for d in DETECTORS], "rule_id, vuln_class, severity, confidence, cwe, owasp, remediation")}


@query("static_scan", duck(SCAN_SQL, **KNOWN))
def q_static_scan(t):
    """Every detector over the code files, deduplicated and enriched."""
    found = static_scan.static_scan(t.code_files().select("file", "content"), t.rules())
    return found.select("file", "line", "rule_id", "vuln_class", "severity", "confidence", "cwe", "owasp", "remediation", "trace_len",
                        F.array_join(F.transform("taint_trace", lambda s: F.concat(F.coalesce(s["line"].cast("string"), F.lit("")), F.lit(" "), F.substring_index(s["description"], ":", 1))), " > ").alias("steps"))


def _any(words, fold):
    b = "lower(body)" if fold else "body"
    return "(" + " or ".join(f"contains({b}, {lit(w.lower() if fold else w)})" for w in words) + ")"


COOKIE = "struct_pack(" + ", ".join(f"{c.rsplit(' as ', 1)[1]} := {c.rsplit(' as ', 1)[0].replace('page_id', 'resp_id')}" for c in COOKIES[1:]) + ")"
# the log that is audited: error texts and indicators in some bodies, a cookie and redirect steps on every response
LOG = {"log": f"select *, {COOKIE} as k from (select * replace ({MARK_BODY} as body) from (select * replace ({ERROR_BODY} as body) from responses where resp_id % 9 not in (4,5)))"}
AUDIT = f"""
select min(seq) as seq, rule_id, rtrim(regexp_extract(url, '^[a-z]+://[^?#]*'), '/') as url, any_value(severity) as severity from (
 select resp_id as seq, "check" as rule_id, url, severity from ({PARTS['header_audit']}) where resp_id % 9 not in (4,5)
 union all select resp_id, case when contains(h_acao,'https://probe.example') then 'cors_reflected' else 'cors_wildcard' end, url, 'High' from log
  where h_acac = 'true' and (contains(h_acao,'https://probe.example') or h_acao = '*')
 union all select resp_id, 'method_options', url, 'Medium' from log where method = 'OPTIONS' and status not in (0,400,405) and h_allow is not null
 union all select resp_id, 'db_error', url, 'Critical' from log where {" or ".join(f"regexp_matches(lower(body), {lit(p)})" for p in DB_ERROR_PATTERNS)}
 union all select resp_id, 'indicator_file', url, 'High' from log where {_any(UNIX_FILE_INDICATORS, False)} or {_any(WINDOWS_FILE_INDICATORS, True)}
 union all select resp_id, 'indicator_entity', url, 'High' from log where {_any(ENTITY_INDICATORS, False)}
 union all select resp_id, 'indicator_internal', url, 'High' from log where {_any(INTERNAL_INDICATORS, True)}
 union all select resp_id, 'open_redirect', url, 'Medium' from log where contains(h_location,'other.example') or resp_id % 10 = 3
 union all select resp_id, 'cookie_http_only', url, 'Medium' from log where not k.http_only
 union all select resp_id, 'cookie_secure', url, 'Medium' from log where not k.secure
 union all select resp_id, 'cookie_same_site', url, 'Medium' from log where coalesce(lower(k.same_site),'') not in ('strict','lax')
) group by 2, 3"""


def audited(t):
    cookie = F.struct(*[F.expr(c.replace("page_id", "resp_id").rsplit(" as ", 1)[0]).alias(c.rsplit(" as ", 1)[1]) for c in COOKIES[1:]])
    r = t.responses().withColumn("body", F.expr(ERROR_BODY)).withColumn("body", F.expr(MARK_BODY))
    return r.withColumn("cookies", F.array(cookie)).withColumn("redirects", F.expr(CHAIN))


@query("response_scan", duck(AUDIT, "responses", **LOG))
def q_response_scan(t):
    """Whole audit of the response log, first seen per rule and address."""
    return response_scan.response_findings(audited(t)).select("seq", "rule_id", "url", "severity")


@query("response_scan_score", duck(f"""
select host, n_findings, greatest(0, 100 - 15*n_critical - 10*n_high - 5*n_medium - 2*n_low)::bigint as score from (
 select h.host, count(a.rule_id) as n_findings, count(*) filter (where severity = 'Critical') as n_critical, count(*) filter (where severity = 'High') as n_high, count(*) filter (where severity = 'Medium') as n_medium, count(*) filter (where severity = 'Low') as n_low
 from (select distinct regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as host from pages) h left join ({AUDIT}) a on regexp_extract(a.url, '^[a-z]+://([^/?#]*)', 1) = h.host group by 1)""", "responses", **LOG))
def q_response_scan_score(t):
    return response_scan.response_scores(audited(t)).select("host", "n_findings", "score")
