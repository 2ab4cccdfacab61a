"""Queries for the detectors on lines, literals and file names, and the flagship score."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import CREDENTIAL_EXCLUDED, CREDENTIAL_NAMES, REDOS_PATTERNS, SECRET_PATTERNS
from wardlight.functions import cols
from wardlight.operators import extract, files as files_op, lines as lines_op, scoring, secrets
from wardlight.operators.dedup import first_by
from wardlight.registry.core import query
from wardlight.views import duck, lit

GATE = "(contains(text,'=') or contains(text,'sk-') or contains(text,'ghp_') or contains(text,'xoxb-'))"


def all_lines(t):
    """Lines of the documents and of the code files."""
    code = lines_op.source_lines(t.code_files().select("file", "content"))
    return t.src_lines().select("file", "line", "text").unionByName(code)


ALL = {"all_lines": "select file, line, text from src_lines union all select file, unnest(generate_series(1,len(string_split(content,chr(10))))) as line,"
                    " unnest(string_split(content,chr(10))) as text from code_files"}
PATTERN_SQL = " union all ".join(
    f"select file, line, '{r}' as rule_id, {i} as ord, unnest(regexp_extract_all(text, {lit(p)}, 0)) as match from all_lines" for i, (r, p) in enumerate(SECRET_PATTERNS))
STRINGS = {"strings": "select file, line, unnest(regexp_extract_all(text, '\"(?:\\\\.|[^\"\\\\])*\"|''(?:\\\\.|[^''\\\\])*''|`[^`]*`', 0)) as literal from all_lines"}
QA = r"""[A-Za-z_][\w.-]*\s*=\s*(?:"[^"]*"|'[^']*'|`[^`]*`)"""
ASSIGNED = {"assigned": f"select file, line, regexp_extract(m, '^([A-Za-z_][\\w.-]*)', 1) as target, regexp_extract(m, '(?s)=\\s*(.*)$', 1) as literal"
                        f" from (select file, line, unnest(regexp_extract_all(text, {lit(QA)}, 0)) as m from all_lines)"}
TRIM = "trim(literal, '\"''`')"
BITS = "round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6)"
ENTROPY_SQL = (f"select file, line, literal, {BITS} as bits from (select file, line, literal, occ, c, count(*)::double as n"
               " from (select file, line, literal, occ, unnest(string_split(v,'')) as c from (select file, line, literal, " + TRIM + " as v, row_number() over () as occ from strings) where length(v) > 20) where c <> '' group by all) group by file, line, literal, occ")


@query("detect_secret_patterns", duck(f"select file, line, rule_id, ord, match from ({PATTERN_SQL})", "src_lines", "code_files", **ALL))
def detect_secret_patterns(t):
    return secrets.detect_secret_patterns(all_lines(t)).select("file", "line", "rule_id", "ord", "match")


@query("extract_strings", duck("select file, line, literal from strings", "src_lines", "code_files", **ALL, **STRINGS))
def extract_strings(t):
    return extract.extract_strings(all_lines(t))


@query("string_entropy", duck(
    f"select file, line, {BITS} as bits from (select file, line, c, count(*)::double as n"
    " from (select file, line, unnest(string_split(text,'')) as c from src_lines where text <> '') group by all) group by file, line", "src_lines"))
def string_entropy(t):
    return t.src_lines().filter("text <> ''").select("file", "line", F.round(cols.entropy_bits(F.col("text")), 6).alias("bits"))


@query("detect_secret_entropy", duck(f"select file, line, literal, bits from ({ENTROPY_SQL}) where bits > 3.5", "src_lines", "code_files", **ALL, **STRINGS))
def detect_secret_entropy(t):
    d = secrets.detect_secret_entropy(extract.extract_strings(all_lines(t)), min_bits=3.5)
    return d.select("file", "line", "literal", F.round("bits", 6).alias("bits"))


CRED_WHERE = ("(" + " or ".join(f"contains(translate(lower(target),'-.','__'), '{n}')" for n in CREDENTIAL_NAMES) + f") and length({TRIM}) >= 8 and not ("
              + " or ".join(f"contains(lower({TRIM}), '{n}')" for n in CREDENTIAL_EXCLUDED) + ")")


@query("detect_credential_variable", duck(f"select file, line, target, {TRIM} as value from assigned where {CRED_WHERE}", "src_lines", "code_files", **ALL, **ASSIGNED))
def detect_credential_variable(t):
    return secrets.detect_credential_variable(secrets.quoted_assignments(all_lines(t))).select("file", "line", "target", "value")


BASENAME = "regexp_replace(file,'^.*/','')"
SENSITIVE = f"regexp_matches({BASENAME}, '^(\\.env|.*\\.pem|.*\\.key|id_rsa|credentials\\.json)$')"


@query("detect_sensitive_file", duck(f"select file from code_files where {SENSITIVE}", "code_files"))
def detect_sensitive_file(t):
    return secrets.detect_sensitive_file(t.code_files().select("file"))


MOVED = "case when line = 2 then replace(file, 'src/', 'pkg/test/') else file end"


@query("secret_fp_filter", duck(
    f"select file, line, value from (select {MOVED} as file, line, {TRIM} as value from assigned) where not (contains(lower(file),'/test') or contains(lower(file),'/spec') or contains(lower(file),'/mock'))"
    " and trim(value) <> '' and not (contains(lower(value),'your_key_here') or contains(lower(value),'<api_key>') or contains(lower(value),'example') or contains(lower(value),'placeholder'))",
    "src_lines", "code_files", **ALL, **ASSIGNED))
def secret_fp_filter(t):
    a = secrets.quoted_assignments(all_lines(t)).select(F.expr(MOVED).alias("file"), "line", secrets.unquote(F.col("literal")).alias("value"))
    return secrets.secret_fp_filter(a)


@query("secret_dispatch", duck(f"""
select file, line, rule_id, min(value) as value from (
 select file, line, rule_id, match as value from ({PATTERN_SQL})
 union all select file, line, 'secret_entropy', {TRIM} from ({ENTROPY_SQL}) where bits > 4.5
 union all select file, line, 'secret_credential', {TRIM} from assigned where {CRED_WHERE}
 union all select file, 0, 'secret_file', {BASENAME} from (select file from src_files union all select file from code_files) where {SENSITIVE}) group by 1, 2, 3""",
    "src_lines", "code_files", **ALL, **STRINGS, **ASSIGNED))
def secret_dispatch(t):
    return secrets.secret_dispatch(all_lines(t), t.src_files().select("file").unionByName(t.code_files().select("file")))


CLEAN = "case when literal like 'r\"%' then literal[3:-2] when literal[1] in ('\"','''') then literal[2:-2] else literal end"
REDOS_SQL = f"""
select file, line, min(struct_pack(shape := shape, pattern := p)) as m from (
 select file, line, p, case when regexp_matches(p, {lit(REDOS_PATTERNS[0])}) then 1
   when len(list_filter(regexp_extract_all(p, '\\(([^|()]+)\\|([^|()]+)\\)[+*]', 0), lambda x: regexp_extract(x, '\\(([^|()]+)\\|', 1) = regexp_extract(x, '\\|([^|()]+)\\)', 1))) > 0 then 2
   when regexp_matches(p, {lit(REDOS_PATTERNS[2])}) then 3 end as shape
 from (select file, line, {CLEAN} as p from strings where length(literal) >= 5)) where shape is not null group by 1, 2"""


@query("detect_redos", duck(f"select file, line, m.shape as shape, m.pattern as pattern from ({REDOS_SQL})", "src_lines", "code_files", **ALL, **STRINGS))
def detect_redos(t):
    return secrets.detect_redos(extract.extract_strings(all_lines(t)))


# ---------------------------------------------------------------------------- flagship
def score_sources(lines):
    """Per source: secrets by line, first pattern wins, scored; sources without hits score 100."""
    hits = secrets.detect_secret_patterns(lines, keep=("source", "file", "line"))
    first = first_by(hits.select("source", "file", "line", "ord", "pos", "rule_id"), ["file", "line"], ["ord", "pos"])
    f = first.select("source", "file", "line", F.lit("Hardcoded Secret").alias("vuln_class"), F.lit("High").alias("severity"), F.lit(None).cast("double").alias("cvss_score"))
    return f


FLAG = " union all ".join(f"select source, file, line from src_lines where regexp_matches(text, {lit(p)})" for _, p in SECRET_PATTERNS)


@query("source_secret_score", duck(f"""
select source, n_findings, case when n_findings > 0 then 7.5 else 0.0 end::double as max_cvss, score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 60 then 'C' when score >= 40 then 'D' else 'F' end as grade
from (select s.source, coalesce(n,0) as n_findings, greatest(0, 100 - 10*coalesce(n,0))::bigint as score from (select distinct source from documents) s
 left join (select source, count(*) as n from (select distinct source, file, line from ({FLAG})) group by 1) x on x.source = s.source)""", "src_lines"))
def source_secret_score(t):
    sources = t.read("documents").select("source").distinct()
    scored = scoring.scan_score(sources, score_sources(t.src_lines()), by="source")
    return scored.select("source", "n_findings", "max_cvss", "score", "grade")
