"""Queries for configuration checks, advisories, prompts, replies, patches and rule enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import ADVISORIES, REFUSAL_PHRASES, REPORT_CVSS
from wardlight.catalog.rules import rule_rows
from wardlight.operators import findings as fnd
from wardlight.operators import lines as lines_op
from wardlight.operators import triage
from wardlight.registry.core import query
from wardlight.registry.projections_q import LICENSE_HITS
from wardlight.registry.sources_q import DUCK_DEPS, DUCK_MANIFEST, manifests
from wardlight.sources import records
from wardlight.views import duck, lit, values


@query("advisory_match", duck(f"""
select file, pkg, version, 'High' as severity from ({DUCK_DEPS}) where pkg = 'express' and (starts_with(version,'3.') or starts_with(version,'^3.') or starts_with(version,'2.') or starts_with(version,'1.'))""", m=DUCK_MANIFEST))
def advisory_match(t):
    adv = t.spark.createDataFrame(ADVISORIES, "pkg string, prefixes array<string>, severity string")
    return triage.advisory_match(records.manifest_read(manifests(t)), adv)


CFG = {"cfg_lines": "select file, unnest(generate_series(1,len(string_split(content,chr(10))))) as line, unnest(string_split(content,chr(10))) as text from code_files"}


def cfg_lines(t):
    return lines_op.source_lines(t.code_files().select("file", "content"))


@query("detect_env_debug", duck("""
select file, line, trim(text) as evidence from cfg_lines where ends_with(file,'/.env') and trim(text) <> '' and not starts_with(trim(text),'#') and contains(upper(text),'DEBUG') and (contains(upper(text),'TRUE') or contains(text,'1'))""", "code_files", **CFG))
def detect_env_debug(t):
    return triage.detect_env_debug(cfg_lines(t))


@query("detect_privileged_container", duck("""
select file, line, trim(text) as evidence from cfg_lines where ends_with(file,'docker-compose.yml') and (contains(lower(text),'privileged: true') or contains(lower(text),'privileged: "true"'))""", "code_files", **CFG))
def detect_privileged_container(t):
    return triage.detect_privileged_container(cfg_lines(t))


def line_hits(t):
    return t.src_lines().filter(LICENSE_HITS).select(
        F.concat_ws("#", "file", F.lpad(F.col("line").cast("string"), 6, "0")).alias("seq"), "file", "line", "text", F.lit("text to review").alias("issue"))


HITS = {"hits": f"select file || '#' || lpad(cast(line as varchar), 6, '0') as seq, file, line, text from src_lines where {LICENSE_HITS}"}


@query("prompt_context", duck("""
select h.seq, h.file, 'A scan reported: text to review' || chr(10) || 'Where: ' || h.file || ', line ' || cast(h.line as varchar) || chr(10)
 || 'Rewrite the file below so that the report no longer applies; answer with the file only.' || chr(10) || '---' || chr(10) || f.content as prompt from hits h join src_files f on f.file = h.file""", "src_files", "src_lines", **HITS))
def prompt_context(t):
    return triage.prompt_context(line_hits(t), t.src_files())


@query("patch_apply", duck("""
select file, content, max_n::int as n_patches from (
 select f.file, s.n, s.content, max(s.n) over (partition by f.file) as max_n from src_files f join steps s on s.file = f.file) where n = max_n""", "src_files", "src_lines", recursive=True, **HITS,
    ordered="select file, text as old, '[line ' || cast(line as varchar) || ' removed: ' || left(text, 3) || ']' as new, row_number() over (partition by file order by seq) as i from hits where text <> ''",
    steps="select file, content, 0::bigint as n from src_files where file in (select file from ordered) union all select s.file, replace(s.content, o.old, o.new), s.n + 1 from steps s join ordered o on o.file = s.file and o.i = s.n + 1"))
def patch_apply(t):
    patches = line_hits(t).select("file", "seq", F.col("text").alias("old"),
                                  F.concat(F.lit("[line "), F.col("line").cast("string"), F.lit(" removed: "), F.substring("text", 1, 3), F.lit("]")).alias("new"))
    return triage.patch_apply(t.src_files().select("file", "content"), patches)


FENCED = "case when conv_id % 3 = 0 then concat('Sure:\\n```sql\\n', text, '\\n```\\nand\\n```\\nx\\n```') when conv_id % 3 = 1 then concat('  ', text, '\\n') else text end"
DUCK_FENCED = FENCED.replace("'Sure:\\n```sql\\n'", "'Sure:' || chr(10) || '```sql' || chr(10)").replace("'\\n```\\nand\\n```\\nx\\n```'", "chr(10) || '```' || chr(10) || 'and' || chr(10) || '```' || chr(10) || 'x' || chr(10) || '```'").replace("'\\n'", "chr(10)")


@query("fence_strip", duck(f"""
select conv_id, turn, trim(case when regexp_extract(r, '(?s)```\\w*\\n(.*?)\\n```', 1) <> '' then regexp_extract(r, '(?s)```\\w*\\n(.*?)\\n```', 1) else r end, ' ' || chr(10) || chr(13) || chr(9)) as code from (select conv_id, turn, {DUCK_FENCED} as r from conversations)"""))
def fence_strip(t):
    return t.read("conversations").select("conv_id", "turn", triage.fence_strip(F.expr(FENCED)).alias("code"))


REPLY = "case when conv_id % 7 = 3 then concat('I''m sorry, ', text) when conv_id % 7 = 5 then concat(text, ' As an AI I stop') else text end"


@query("reply_quality_filter", duck(f"""
select conv_id, turn, r as text from (select conv_id, turn, {REPLY} as r from conversations where role = 'assistant') where length(trim(r, ' ' || chr(10) || chr(13) || chr(9))) >= 50 and not ({' or '.join(f'contains(lower(r), {lit(p)})' for p in REFUSAL_PHRASES)})"""))
def reply_quality_filter(t):
    r = t.read("conversations").filter("role = 'assistant'").select("conv_id", "turn", F.expr(REPLY).alias("text"))
    return triage.reply_quality_filter(r)


RULE_IDS = [r[0] for r in rule_rows()]
ENRICH = {
    "cat": values([(r[0], r[3], r[8], r[4], r[5], r[6], r[9]) for r in rule_rows()], "rule_id, severity, confidence, cwe, owasp, score, issue"),
    "named": "select f.seq, f.file, f.line, f.vuln_class, case when f.trace_len = 4 then 'Low' end as severity_override, case when f.trace_len = 3 then 'Tentative' end as confidence_override, case n when 0 then 'unknown' else r.rule_id end as rule_id"
             " from (select *, cast(substring(rule_id, 6) as int) as n from findings) f left join (" + values(list(enumerate(RULE_IDS)), "i, rule_id") + ") r on r.i = f.n",
}


@query("finding_rule_enrich", duck("""
select n.seq, n.rule_id, n.file, n.line, n.vuln_class, coalesce(n.severity_override, c.severity) as severity, coalesce(n.confidence_override, c.confidence) as confidence, c.cwe, c.owasp, c.score::double as cvss_score, c.issue
from named n join cat c on c.rule_id = n.rule_id""", "findings", **ENRICH))
def finding_rule_enrich(t):
    ids = F.array(*[F.lit(r) for r in RULE_IDS])
    n = F.substring("rule_id", 6, 10).cast("int")
    hits = t.findings().select(
        "seq", "file", "line", "vuln_class", F.when(n == 0, "unknown").otherwise(F.get(ids, n)).alias("rule_id"),
        F.expr("case when trace_len = 4 then 'Low' end").alias("severity_override"), F.expr("case when trace_len = 3 then 'Tentative' end").alias("confidence_override"))
    return fnd.finding_rule_enrich(hits, t.rules()).select("seq", "rule_id", "file", "line", "vuln_class", "severity", "confidence", "cwe", "owasp", "cvss_score", "issue")
