"""Queries for facts of code files, rule matching and taint.

DuckDB finds the same facts with its own regular expressions and position scans. For results of a whole analysis the
expectation was worked out by hand per program and is joined with the customers that the files were derived from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import FRAMEWORK_ORDER, FRAMEWORK_SIGNALS, FRAMEWORK_SOURCES, SHELL_FUNCTIONS, WEAK_CRYPTO_TEXTS
from wardlight.catalog.rules import rule_rows
from wardlight.catalog.programs import PROGRAMS
from wardlight.functions.cols import explode_once
from wardlight.operators import extract, flows, framework, intervals, lines as lines_op, pages as pages_op, rules_match, structure_checks, taint
from wardlight.operators.patterns import PatternSet
from wardlight.registry.core import query
from wardlight.session import checkpointed
from wardlight.views import ORDER_STEP, duck, lit, values

N = len(PROGRAMS)
HASH = "case when language = 'python' then regexp_replace(text, '(^|\\s+)#[^\"'']*$', '') else regexp_replace(text, '\\s*//[^\"'']*$', '') end"
T = r"[A-Za-z_$][\w.$]*(?:\[[^\]=]*\])?"
OPS = r"([-+*/%|&.]?)"
RX = {
    "python": rf"^\s*({T})\s*(?::\s*[A-Za-z_][\w\[\], .]*)?\s*{OPS}=\s*([^=\s].*?)\s*$",
    "javascript": rf"^\s*(?:export\s+)?(?:(?:let|const|var)\s+)?({T})\s*{OPS}=\s*([^=\s>].*?);?\s*$",
    "go": rf"^\s*(?:var\s+)?({T})(?:\s*,\s*[A-Za-z_]\w*)*(?:\s+[A-Za-z_*\[\].]+)?\s*(:|[-+*/%|&]?)=\s*([^=\s].*?)\s*$",
    "php": rf"^\s*(\$\w+(?:->\w+)*(?:\[[^\]=]*\])?)\s*{OPS}=\s*([^=\s>].*?);?\s*$",
}
TYPED_RX = rf"^\s*(?:[A-Za-z_][\w<>\[\],.:]*[\s*&]+)*\*?({T})\s*{OPS}=\s*([^=\s].*?);?\s*$"
PICK = "case language " + " ".join(f"when '{k}' then {lit(v)}" for k, v in RX.items()) + f" else {lit(TYPED_RX)} end"


def pick(i):
    return "case language " + " ".join(f"when '{k}' then regexp_extract(text, {lit(v)}, {i})" for k, v in RX.items()) + f" else regexp_extract(text, {lit(TYPED_RX)}, {i}) end"


HD = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\((.*?)\)\s*(?:->.*)?:", "javascript": r"(?:^|[^\w$])function\s*(\w*)\s*\(([^)]*)\)",
    "go": r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(([^)]*)\)", "php": r"^\s*function\s+(\w+)\s*\(([^)]*)\)",
    "c": r"^[A-Za-z_][\w\s*&:<>]*?[\s*&]([A-Za-z_]\w*)\s*\(([^;{]*)\)\s*\{?\s*$",
}
HD_TYPED = r"^\s*(?:(?:public|private|protected|static)\s+)+[\w<>\[\],.]+\s+(\w+)\s*\(([^)]*)\)"


def head(i):
    return "case language " + " ".join(f"when '{k}' then regexp_extract(text, {lit(v)}, {i})" for k, v in HD.items()) + f" else regexp_extract(text, {lit(HD_TYPED)}, {i}) end"


CALL = r"^(?:new\s+)?[A-Za-z_$][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*\s*\("
BALANCED = CALL[:-2] + r"\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\)"
WORDS = "('if','while','for','switch','catch','return','function','def','func','elif','and','or','not','in')"
FACTS = {
    "stmts": f"select file, pid, k, language, line, text as raw, trim({HASH}, ' ' || chr(9)) as text from code_lines where trim({HASH}, ' ' || chr(9)) not in ('','{{') and not starts_with(trim(text), '#') and not starts_with(trim(text), '//')",
    "asg0": f"select file, pid, k, language, line, {pick(1)} as target, {pick(2)} as op, {pick(3)} as rhs from stmts where contains(text,'=')",
    "asg": "select file, pid, k, language, line, target, op, case when op in ('',':') then rhs else target || ' ' || op || ' ' || rhs end as value from asg0 where target <> ''",
    "loc": "select *, case when contains(target,'[') and ends_with(target,']') then 'index' when contains(target,'.') then 'field' else 'var' end as kind,"
           " case when contains(target,'[') and ends_with(target,']') then regexp_extract(target,'^[^\\[]*') when contains(target,'.') then regexp_extract(target,'^[^.]*') else target end as base,"
           " case when contains(target,'[') and ends_with(target,']') then trim(regexp_extract(target,'\\[(.*)\\]$',1), '\"''') when contains(target,'.') then regexp_replace(target,'^[^.]*\\.','') else '' end as member from asg",
    "funcs0": f"select file, pid, k, language, line, raw, {head(1)} as n, {head(2)} as params from stmts where {head(0)} <> ''",
    "funcs": "select f.file, f.pid, f.k, f.language, case when f.n = '' then '<anonymous>' else f.n end as name, f.params, f.line as start_line,"
             " case when f.language = 'python' then coalesce((select max(s.line) from stmts s where s.file = f.file and s.line > f.line and s.line <"
             "   coalesce((select min(x.line) from stmts x where x.file = f.file and x.line > f.line and length(x.raw) - length(ltrim(x.raw)) <= length(f.raw) - length(ltrim(f.raw))), 1000000)), f.line)"
             "  else (select min(s.line) from stmts s where s.file = f.file and s.line > f.line and starts_with(s.text,'}') and length(s.raw) - length(ltrim(s.raw)) = length(f.raw) - length(ltrim(f.raw))) end as end_line from funcs0 f",
    "calls0": f"select *, regexp_replace(regexp_extract(substring(text,col), {lit(CALL)}), '\\s*\\($', '') as function_name, coalesce(nullif(regexp_extract(substring(text,col), {lit(BALANCED)}), ''), substring(text,col)) as full_text"
              " from (select *, unnest(generate_series(1,length(text))) as col from stmts where contains(text,'('))"
              f" where regexp_matches(substring(text,col), {lit(CALL)}) and (col = 1 or not regexp_matches(substring(text,col-1,1), '[\\w$]')) and (col < 3 or not regexp_matches(substring(text,col-2,2), '^([\\w$]\\.|->|::)$')) and not regexp_matches(substring(text,1,col-1), '(^|[^\\w$])new\\s+$')",
    "calls": f"select c.file, c.pid, c.k, c.language, c.line, c.col, c.function_name, c.full_text from calls0 c where c.function_name not in {WORDS} and not exists (select 1 from funcs0 f where f.file = c.file and f.line = c.line and f.n = c.function_name)",
}


def facts(*extra_names, need=("code_lines",)):
    names = list(FACTS)
    last = max(names.index(n) for n in extra_names)
    return {n: FACTS[n] for n in names[: last + 1]}


def fduck(body, *names, ctes=(), recursive=False, **extra):
    return duck(body, "code_lines", *ctes, recursive=recursive, **facts(*names), **extra)


def stmts(t):
    return extract.statements(t.code())


@query("extract_assignments", fduck("select file, language, line, target, op, value from asg where not contains(target,'[')", "asg"))
def extract_assignments(t):
    return extract.extract_assignments(stmts(t), subscripts=False)


@query("extract_calls", fduck("select file, line, col::int as col, function_name, full_text from calls", "calls"))
def extract_calls(t):
    return extract.extract_calls(stmts(t)).select("file", "line", "col", "function_name", "full_text")


# the same facts over the inline scripts of stored pages
PAGE_LINES = """select file, 0 as pid, page_id as k, 'javascript' as language, unnest(generate_series(1, len(string_split(value, chr(10))))) as line, unnest(string_split(value, chr(10))) as text
 from (select page_id, 'page' || cast(page_id as varchar) || '.js' as file, unnest(regexp_extract_all(html, '(?s)<script>(.*?)</script>', 1)) as value from pages)"""


def page_duck(body, *names):
    return duck(body, page_lines=PAGE_LINES, **{n: q.replace("from code_lines", "from page_lines") for n, q in facts(*names).items()})


def script_stmts(t):
    inline = pages_op.page_scripts(t.pages()).filter("kind = 'inline'")
    return extract.statements(inline.select(F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".js")).alias("file"), F.lit("javascript").alias("language"), F.col("value").alias("content")))


@query("script_calls", page_duck("select file, line, col::int as col, function_name, full_text from calls", "calls"))
def script_calls(t):
    return extract.extract_calls(script_stmts(t)).select("file", "line", "col", "function_name", "full_text")


@query("script_assignments", page_duck("select file, line, target, value from asg", "asg"))
def script_assignments(t):
    return extract.extract_assignments(script_stmts(t)).select("file", "line", "target", "value")


ARGS_SQL = """
select file, line, col::int as col, string_agg(arg, ' ; ' order by seg) as args from (
 select file, line, col, seg, trim(string_agg(ch, '' order by i)) as arg from (
  select *, sum(case when cut then 1 else 0 end) over (partition by file, line, col order by i) as seg from (
   select file, line, col, i, ch, ch = ',' and depth = 0 and q % 2 = 0 as cut from (
    select *, sum(case when ch in ('(','[','{') then 1 when ch in (')',']','}') then -1 else 0 end) over w as depth, sum(case when ch = '"' then 1 else 0 end) over w as q
    from (select file, line, col, unnest(generate_series(1,length(inner_text))) as i, unnest(string_split(inner_text,'')) as ch
      from (select *, regexp_replace(regexp_replace(full_text, '^[^(]*\\(', ''), '\\)$', '') as inner_text from calls) where inner_text <> '')
    window w as (partition by file, line, col order by i))))
 where not cut group by 1, 2, 3, 4) group by 1, 2, 3"""


@query("split_args", fduck(ARGS_SQL, "calls"))
def split_args(t):
    c = extract.extract_calls(stmts(t)).select("file", "line", "col", "full_text")
    return extract.split_args(c, "full_text").filter(F.size("args") > 0).select("file", "line", "col", F.array_join("args", " ; ").alias("args"))


PARAM = ("case when language in ('python','javascript') then regexp_replace(regexp_replace(p,'\\s*:.*$',''),'^[*.\\s]+','') when language = 'go' then regexp_extract(p,'^(\\w+)',1) else regexp_extract(p,'([$\\w]+)$',1) end")
PLIST = {"plist": f"select file, pid, k, name, start_line, end_line, pos, param from (select file, pid, k, name, start_line, end_line, pos, {PARAM} as param from (select *, trim(regexp_replace(unnest(string_split(params,',')),'\\s*=.*$','')) as p, unnest(generate_series(1,len(string_split(params,',')))) as pos from funcs)) where param <> ''"}


@query("extract_functions", fduck(
    "select f.file, f.language, f.name, coalesce(string_agg(p.param, ',' order by p.pos), '') as params, f.start_line, f.end_line from funcs f left join plist p on p.file = f.file and p.start_line = f.start_line group by 1, 2, 3, 5, 6", "funcs", **PLIST))
def extract_functions(t):
    f = extract.extract_functions(stmts(t))
    return f.withColumn("params", F.array_join("params", ","))


@query("extract_returns", fduck("select file, line, regexp_extract(text, '^\\s*return\\s+(.+?)\\s*$', 1) as value from stmts where language = 'python' and regexp_matches(text, '^\\s*return\\s+.')", "stmts"))
def extract_returns(t):
    return extract.extract_returns(stmts(t))


@query("taint_location_parse", fduck("select file, line, target, kind, base, member from loc", "loc"))
def taint_location_parse(t):
    a = extract.extract_assignments(stmts(t))
    return a.select("file", "line", "target", *[c.alias(k) for k, c in extract.taint_location(F.col("target")).items()])


@query("route_handler_flag", fduck(
    "select f.file, f.name, f.start_line, exists (select 1 from code_lines l where l.file = f.file and l.line between f.start_line - 4 and f.start_line - 1 and starts_with(trim(l.text),'@') and regexp_matches(l.text,'route|get|post|put|delete')) as is_handler from funcs f", "funcs"))
def route_handler_flag(t):
    f = extract.extract_functions(stmts(t))
    return extract.route_handler_flag(f, lines_op.source_lines(t.code().select("file", "content"))).select("file", "name", "start_line", "is_handler")


# ---------------------------------------------------------------------------- spans
SPANS = {"spans": "select file, 'outer_' || cast(c as varchar) as name, 100*c + 1 as start_line, 100*c + 70 as end_line from (select distinct file, line // 100 as c from span_events)"
                  " union all select file, 'inner_' || cast(c as varchar), 100*c + 30, 100*c + 50 from (select distinct file, line // 100 as c from span_events)"}


def spans(t):
    c = t.span_events().select("file", F.expr("line div 100").alias("c")).distinct()
    a = c.select("file", F.concat(F.lit("outer_"), F.col("c").cast("string")).alias("name"), (F.col("c") * 100 + 1).alias("start_line"), (F.col("c") * 100 + 70).alias("end_line"))
    b = c.select("file", F.concat(F.lit("inner_"), F.col("c").cast("string")).alias("name"), (F.col("c") * 100 + 30).alias("start_line"), (F.col("c") * 100 + 50).alias("end_line"))
    return a.unionByName(b)


@query("enclosing_function", duck(
    "select e.file, e.line, e.name, coalesce(arg_max(s.name, s.start_line), '<module>') as func from span_events e left join spans s on s.file = e.file and e.line between s.start_line and s.end_line group by 1, 2, 3", "span_events", **SPANS))
def enclosing_function(t):
    return intervals.enclosing_function(t.span_events().select("file", "line", "name"), spans(t)).select("file", "line", "name", "func")


@query("module_scope_filter", duck(
    "select e.file, e.line, e.name from span_events e where not exists (select 1 from spans s where s.file = e.file and e.line between s.start_line and s.end_line)", "span_events", **SPANS))
def module_scope_filter(t):
    return intervals.module_scope_filter(t.span_events().select("file", "line", "name"), spans(t))


# ---------------------------------------------------------------------------- rules
TOKENS = "list_distinct(list_concat([trim(lower({x}))], list_filter(regexp_split_to_array(trim(lower({x})), '[.\\s:>(]+'), lambda p: length(p) > 1), case when contains({x},'.') then [regexp_extract(trim(lower({x})),'[^.]*$')] else [] end))"


def tok(x):
    return TOKENS.format(x=x)


CAND = {
    "rtok": f"select distinct language, rule_id, unnest({tok('pattern')}) as token from rule_patterns where kind = 'sink'",
    "ctok": f"select distinct file, line, col, language, function_name, full_text, unnest(list_concat({tok('function_name')}, {tok(chr(39) + chr(39) + ' || regexp_extract(full_text, ' + chr(39) + '^[^(]*' + chr(39) + ')')})) as token from calls",
    "cand": "select distinct c.file, c.line, c.col, c.function_name, c.full_text, c.language, r.rule_id from ctok c join rtok r on r.language = c.language and r.token = c.token"
            " where exists (select 1 from rule_patterns p where p.rule_id = r.rule_id and p.kind = 'sink' and (contains(lower(c.full_text), p.pattern) or contains(lower(c.function_name), p.pattern)))",
}


@query("sink_candidates", fduck("select file, line, col::int as col, function_name, rule_id from cand", "calls", ctes=("rule_patterns",), **CAND))
def sink_candidates(t):
    return rules_match.sink_candidates(extract.extract_calls(stmts(t)), t.rules())


@query("sink_match_scan", fduck(
    "select distinct c.file, c.line, c.col::int as col, c.function_name, p.rule_id from calls c join rule_patterns p on p.language = c.language and p.kind = 'sink' and contains(lower(c.full_text || chr(10) || c.function_name), p.pattern)", "calls", ctes=("rule_patterns",)))
def sink_match_scan(t):
    return rules_match.sink_match_scan(extract.extract_calls(stmts(t)), t.rules())


@query("source_attribution", fduck(
    "select distinct a.file, a.line, p.rule_id from asg a join rule_patterns p on p.language = a.language and p.kind = 'source' and contains(lower(a.value), p.pattern)", "asg", ctes=("rule_patterns",)))
def source_attribution(t):
    return rules_match.source_attribution(extract.extract_assignments(stmts(t)), "value", t.rules(), ("file", "line"))


@query("sanitizer_exclude", duck("""
select l.file, l.line, p.rule_id from src_lines l join rule_patterns p on p.kind = 'sink' and p.language = 'python' and contains(lower(l.text), p.pattern)
where not exists (select 1 from rule_patterns s where s.kind = 'sanitizer' and s.rule_id = p.rule_id and contains(lower(l.text), s.pattern)) group by all""", "src_lines", "rule_patterns"))
def sanitizer_exclude(t):
    """Document lines as the texts: sinks of the Python rules found in them, minus sanitized ones."""
    lines = t.src_lines().select("file", "line", F.col("text").alias("full_text"), F.lit("python").alias("language"))
    hits = rules_match.pattern_scan(lines, F.col("full_text"), t.rules(), "sinks")
    return rules_match.sanitizer_exclude(hits, t.rules()).select("file", "line", "rule_id").distinct()


PART_CALLS = "select l_orderkey, l_linenumber, p_partkey, case p_size % 4 when 0 then 'python' when 1 then 'javascript' when 2 then 'java' else 'go' end as language"
PART_CALLS += ", concat('x.', replace(p_name, ' ', '.'), '(v', l_linenumber, ', run_', p_type, '.exec)') as full_text from {lineitem} join {part} on p_partkey = l_partkey"


@query("part_rule_sinks", duck(f"""
select c.l_orderkey, c.l_linenumber, count(*) as n_patterns, count(distinct s.pattern) as n_texts from ({PART_CALLS.format(lineitem="lineitem", part="part")}) c
join (select distinct language, rule_id, lower(unnest(sinks)) as pattern from part_rules) s on s.language = c.language and contains(lower(c.full_text), s.pattern) group by all""", "part_rules"))
def part_rule_sinks(t):
    """A rule for each part looked for in a call for each line item: how many sinks of all these rules lie in it."""
    calls = t.spark.sql(PART_CALLS.format(lineitem="{lineitem}", part="{part}"), lineitem=t.read("lineitem"), part=t.read("part"))
    sinks = PatternSet(t.part_rules(), "sinks")
    rules = sinks.rows.groupBy("language", "pattern").agg(F.count("*").alias("n"))
    hit = sinks.contained(calls, F.col("full_text")).join(rules, ["language", "pattern"])
    return hit.groupBy("l_orderkey", "l_linenumber").agg(F.sum("n").alias("n_patterns"), F.count_distinct("pattern").alias("n_texts"))


@query("rule_index_build", duck(f"select distinct language, rule_id, unnest({tok('sink')}) as token from (select language, rule_id, unnest(sinks) as sink from part_rules)", "part_rules"))
def rule_index_build(t):
    return rules_match.rule_index_build(t.part_rules())


SAN_PAIRS = "regexp_extract_all(value, '([\\w.$]+)\\s*\\(\\s*([\\w$]+)', {g})"
SANS = sorted({(r[1], s.lower().rstrip("(")) for r in rule_rows() for s in r[13]})
ID = "[A-Za-z_$][\\w$]*"
USES = {
    "sans": values(SANS, "language, san"),
    "idents": f"select distinct file, pid, k, language, line, value, target, unnest(regexp_extract_all(value, '{ID}')) as ident from asg",
    "wrapped": "select i.file, i.line, i.ident from idents i where exists (select 1 from sans s where s.language = i.language and regexp_matches(lower(i.value), regexp_escape(s.san) || '\\s*\\(\\s*' || regexp_escape(lower(i.ident)) || '($|[^\\w$])'))",
    "placeheld": f"select file, line, ident from idents where (contains(value,'?') or contains(value,'%s') or contains(lower(value),':param') or contains(lower(value),'filter_by(') or contains(lower(value),'filter(')) and not list_contains(regexp_extract_all(split_part(value, ',', 1), '{ID}'), ident)",
}


@query("sanitizer_wraps", fduck("select file, line, ident as var from wrapped", "asg", **USES))
def sanitizer_wraps(t):
    stems = t.rules().withColumn("sanitizers", F.transform("sanitizers", lambda s: F.rtrim(s, F.lit("("))))
    a = extract.extract_assignments(stmts(t)).filter(F.contains("value", F.lit("(")))
    wrapped = taint.wrapped_identifiers(F.col("value"), PatternSet(stems, "sanitizers").inside(F.col("value")))
    return explode_once(a, ["file", "line"], F.array_intersect(wrapped, taint.identifiers(F.col("value"))), "var")


@query("parameterized_query_check", fduck("select file, line, ident as var from placeheld", "asg", **USES))
def parameterized_query_check(t):
    a = extract.extract_assignments(stmts(t))
    return a.select("file", "line", F.explode(taint.parameterised_identifiers(F.col("value"))).alias("var"))


FW_SQL = "select f.file, s.fw, sum(s.w) as score from code f join sig s on s.lang = f.language and regexp_matches(lower(f.content), s.p) group by 1, 2"
FW = {
    "sig": values([(a, b, p, w) for a, b, p, w in FRAMEWORK_SIGNALS], "lang, fw, p, w"),
    "fwo": values(list(zip(FRAMEWORK_ORDER, range(len(FRAMEWORK_ORDER)))), "fw, o"),
    "fwd": f"select c.file, c.language, coalesce(x.fw, 'generic') as framework, case when x.fw is null then 0.5 else round(least(x.score::double, 1.0), 6) end::double as confidence from code c left join (select s.*, row_number() over (partition by file order by score desc, o) as rn from ({FW_SQL}) s join fwo using (fw)) x on x.file = c.file and x.rn = 1",
}


@query("framework_detect", duck("select file, language, framework, confidence from fwd", "code", **FW))
def framework_detect(t):
    return framework.framework_detect(t.code().select("file", "language", "content")).drop("content")


FWS = {"fws": values([(k, s) for k, v in FRAMEWORK_SOURCES.items() for s in v], "fw, source")}
RULE_SOURCES = {"rsrc": values([(r[1], r[0], s) for r in rule_rows() for s in r[11]], "language, rule_id, source"),
                "rids": values([(r[1], r[0]) for r in rule_rows()], "language, rule_id")}


@query("framework_augment", duck("""
select f.language, f.framework, f.n_files, r.rule_id, count(distinct s.source) as n_sources, sum(length(s.source))::bigint as chars
from (select language, framework, count(*) as n_files from fwd group by 1, 2) f join rids r on r.language = f.language
join (select distinct language, rule_id, fw, source from (select language, rule_id, fw.fw, source from rsrc, (select distinct fw from fws) fw
   union all select language, rule_id, fws.fw, fws.source from rids, fws union all select language, rule_id, f2.fw, g.source from rids, (select distinct fw from fws) f2, fws g where g.fw = 'generic')) s
 on s.language = r.language and s.rule_id = r.rule_id and s.fw = f.framework group by 1, 2, 3, 4""", "code", **FW, **FWS, **RULE_SOURCES))
def framework_augment(t):
    a = framework.framework_augment(framework.framework_detect(t.code().select("file", "language", "content")), t.rules())
    total = F.aggregate("sources", F.lit(0).cast("bigint"), lambda acc, s: acc + F.length(s))
    return a.select("language", "framework", "n_files", "rule_id", F.size("sources").cast("bigint").alias("n_sources"), total.alias("chars"))


# ---------------------------------------------------------------------------- structural checks
@query("detect_shell_true", fduck(f"""
select file, line, 'python_cmdi' as rule_id, severity_override, confidence_override from (
 select file, line, col, case when regexp_matches(full_text, '^[\\w.]+\\("[^"+%]*",') then 'Low' end as severity_override, case when regexp_matches(full_text, '^[\\w.]+\\("[^"+%]*",') then 'Tentative' end as confidence_override
 from calls where contains(lower(full_text),'shell=true') and ({' or '.join(f"contains(lower(function_name),'{x}')" for x in SHELL_FUNCTIONS)})) qualify row_number() over (partition by file, line order by col) = 1""", "calls"))
def detect_shell_true(t):
    return structure_checks.detect_shell_true(extract.extract_calls(stmts(t)), t.rules()).select("file", "line", "rule_id", "severity_override", "confidence_override")


@query("detect_weak_crypto", fduck(
    "select file, line, 'python_weak_hash' as rule_id, case " + " ".join(f"when contains(lower(full_text), {lit(x.lower())}) then {lit(x.lower())}" for x in WEAK_CRYPTO_TEXTS)
    + " end as pattern from calls where (" + " or ".join(f"contains(lower(full_text), {lit(x.lower())})" for x in WEAK_CRYPTO_TEXTS) + ") and language = 'python' qualify row_number() over (partition by file, line order by col) = 1", "calls"))
def detect_weak_crypto(t):
    return structure_checks.detect_weak_crypto(extract.extract_calls(stmts(t)), t.rules()).select("file", "line", "rule_id", "pattern")


# ---------------------------------------------------------------------------- call graph
EDGES = {
    "cedges": "select c.file, c.pid, c.k, coalesce((select arg_max(f.name, f.start_line) from funcs f where f.file = c.file and c.line between f.start_line and f.end_line and f.end_line > f.start_line), '<module>') as caller,"
              " regexp_extract(c.function_name, '[^.]*$') as callee, c.line, c.full_text from calls c where exists (select 1 from funcs f where f.file = c.file and f.name = regexp_extract(c.function_name, '[^.]*$'))"}


@query("call_edges", fduck("select file, caller, callee, line, full_text from cedges", "calls", **EDGES))
def call_edges(t):
    s = stmts(t)
    return taint.call_edges(extract.extract_calls(s, keep=("func",)), extract.extract_functions(s)).select("file", "caller", "callee", "line", "full_text")


@query("callers_callees", fduck("""
select f.file, f.name, (select count(*) from cedges e where e.file = f.file and e.callee = f.name) as n_sites,
 coalesce((select string_agg(distinct caller, ',' order by caller) from cedges e where e.file = f.file and e.callee = f.name), '') as callers,
 coalesce((select string_agg(distinct callee, ',' order by callee) from cedges e where e.file = f.file and e.caller = f.name), '') as callees,
 not exists (select 1 from cedges e where e.file = f.file and e.callee = f.name) as uncalled from (select distinct file, name from funcs) f""", "calls", **EDGES))
def callers_callees(t):
    s = stmts(t)
    f = checkpointed(extract.extract_functions(s))
    return taint.callers_callees(taint.call_edges(extract.extract_calls(s, keep=("func",)), f), f)


def expected(rows, cols, select):
    """Hand-worked rows per program number, joined with the customers of that program."""
    return duck(f"select {select} from expect e join code_files c on c.pid = e.pid", "code_files", expect=values(rows, "pid, " + cols))


KSUB = "replace({}, '@K@', cast(c.k as varchar))"


@query("param_seed", expected([(5, "ping", 10, "host", "target")], "callee, line, param, via", "c.file, e.callee, e.line::bigint as line, e.param, e.via"))
def param_seed(t):
    f = taint.CodeFacts(t.code(), t.rules())
    return taint.param_seed(taint.call_edges(f.calls, f.functions), f.functions, taint.module_taint(f))


@query("module_taint", expected([(5, "target", 2), (10, "cmd", 3), (18, "$id", 2)], "base, line", "c.file, e.base, e.line::bigint as line"))
def module_taint(t):
    return taint.module_taint(taint.CodeFacts(t.code(), t.rules()))


@query("handler_param_seed", expected([(9, 6, "host"), (9, 6, "count")], "start_line, base", "c.file, e.start_line::bigint as start_line, e.base"))
def handler_param_seed(t):
    return taint.handler_param_seed(taint.CodeFacts(t.code(), t.rules()))


@query("function_returns_taint", expected(
    [(p, n) for p, n in [(0, "get_user_@K@"), (1, "get_item"), (2, "find"), (3, "search"), (4, "read_name"), (6, "pick"), (7, "pick"), (8, "poll"), (13, "<anonymous>"), (14, "render"),
                         (15, "handle"), (16, "Load"), (17, "find"), (19, "main"), (21, "show"), (22, "build"), (23, "attempt")]],
    "name", f"c.file, {KSUB.format('e.name')} as name"))
def function_returns_taint(t):
    return taint.function_returns_taint(taint.CodeFacts(t.code(), t.rules()))


FIXPOINT = [
    (0, "get_user_@K@", "python_sqli", 8, "query", 7), (3, "search", "python_sqli", 7, "sql", 6), (6, "pick", "python_cmdi", 10, "path", 7), (8, "poll", "python_cmdi", 8, "prev", 9),
    (9, "ping", "python_cmdi", 8, "line", 7), (10, "<module>", "python_cmdi", 5, "full", 4), (13, "<anonymous>", "js_sqli", 6, "sql", 5), (14, "render", "js_xss", 6, "who", 2),
    (15, "handle", "go_sqli", 5, "query", 4), (15, "handle", "go_cmdi", 6, "id", 3), (16, "Load", "csharp_sqli", 7, "text", 6), (17, "find", "java_sqli", 5, "sql", 4),
    (18, "<module>", "php_sqli", 4, "$sql", 3), (19, "main", "c_strcpy", 4, "name", 3), (22, "build", "python_cmdi", 10, "line", 7), (23, "attempt", "python_cmdi", 10, "value", 7),
]


@query("code_taint_fixpoint", expected(FIXPOINT, "func, rule_id, sink_line, var, origin_line",
       f"c.file, {KSUB.format('e.func')} as func, e.rule_id, e.sink_line::bigint as sink_line, e.var, e.origin_line::bigint as origin_line"))
def code_taint_fixpoint(t):
    return taint.taint_fixpoint(taint.CodeFacts(t.code(), t.rules())).drop("sink_text")


@query("interprocedural_taint", expected([(5, "run", 8, "python_cmdi", 5, "cmd")], "callee, call_line, rule_id, sink_line, var",
       "c.file, e.callee, e.call_line::bigint as call_line, e.rule_id, e.sink_line::bigint as sink_line, e.var"))
def interprocedural_taint(t):
    return flows.interprocedural_taint(taint.CodeFacts(t.code(), t.rules()))


# whole paths by program: lines and what happens there; the text behind "used here" is the statement
PATHS = [
    (0, "get_user_@K@", "python_sqli", 8, "query", "6 enters as name > 7 moves on as query > 8 used here"),
    (3, "search", "python_sqli", 7, "sql", "5 enters as params[name] > 6 moves on as sql > 7 used here"),
    (4, "lookup", "python_sqli", 9, "sql", "7 enters in read_name > 7 moves on as who > 8 moves on as sql > 9 used here"),
    (5, "run", "python_cmdi", 5, "cmd", "2 enters as target > 10 handed to ping as host > 8 handed to run as cmd > 5 used here"),
    (6, "pick", "python_cmdi", 10, "path", "7 enters as path > 10 used here"),
    (8, "poll", "python_cmdi", 8, "prev", "10 enters as cur > 9 moves on as prev > 8 used here"),
    (9, "ping", "python_cmdi", 8, "line", "6 enters as parameter host > 7 moves on as line > 8 used here"),
    (10, "<module>", "python_cmdi", 5, "full", "3 enters as cmd > 4 moves on as full > 5 used here"),
    (13, "<anonymous>", "js_sqli", 6, "sql", "4 enters as id > 5 moves on as sql > 6 used here"),
    (14, "render", "js_xss", 6, "who", "2 enters as who > 6 used here"),
    (15, "handle", "go_sqli", 5, "query", "3 enters as id > 4 moves on as query > 5 used here"),
    (15, "handle", "go_cmdi", 6, "id", "3 enters as id > 6 used here"),
    (16, "Load", "csharp_sqli", 7, "text", "5 enters as id > 6 moves on as text > 7 used here"),
    (17, "find", "java_sqli", 5, "sql", "3 enters as id > 4 moves on as sql > 5 used here"),
    (18, "<module>", "php_sqli", 4, "$sql", "2 enters as $id > 3 moves on as $sql > 4 used here"),
    (19, "main", "c_strcpy", 4, "name", "3 enters as name > 4 used here"),
    (22, "build", "python_cmdi", 10, "line", "7 enters as line > 10 used here"),
    (23, "attempt", "python_cmdi", 10, "value", "7 enters as value > 10 used here"),
]


def paths(found):
    steps = F.array_join(F.transform("taint_trace", lambda s: F.concat(s["line"].cast("string"), F.lit(" "), F.substring_index(s["description"], ":", 1))), " > ")
    return found.select("file", "func", "rule_id", "sink_line", "var", steps.alias("steps"))


@query("taint_paths", expected(PATHS, "func, rule_id, sink_line, var, steps",
       f"c.file, {KSUB.format('e.func')} as func, e.rule_id, e.sink_line::bigint as sink_line, e.var, e.steps"))
def taint_paths(t):
    """Whole paths from sources to sinks, calls included."""
    return paths(flows.taint_paths(taint.CodeFacts(t.code(), t.rules())))


@query("order_taint_paths", f"""
with l as (select l_orderkey as o, {ORDER_STEP} as step, row_number() over (partition by l_orderkey order by l_linenumber, {ORDER_STEP}) as i, count(*) over (partition by l_orderkey) as n from lineitem),
g as (select o, n, max(case when i > 1 and step = 'drop' then 1 else 0 end) as dropped,
 string_agg(case when i = 1 then '13 enters as v1' when step = 'keep' then (12 + i) || ' passes through keep > ' || (12 + i) || ' moves on as v' || i else (12 + i) || ' moves on as v' || i end, ' > ' order by i) as steps
 from l group by o, n)
select 'orders/o' || o || '.py' as file, 'run' as func, 'python_cmdi' as rule_id, 10::bigint as sink_line, 'line' as var, steps || ' > ' || (13 + n) || ' handed to run as line > 10 used here' as steps
from g where dropped = 0""")
def order_taint_paths(t):
    """Programs written from orders: a line item hands a value on, passes it through a helper that keeps it, or through
    one that drops it, so which path exists is in the data."""
    return paths(flows.taint_paths(taint.CodeFacts(t.order_code(), t.rules())))


LINE_FLOW = [
    (0, "python_sqli", "db.execute", 8, "query"), (1, "python_sqli", "db.execute", 7, "query"), (2, "python_sqli", "db.execute", 5, "uid"), (3, "python_sqli", "db.execute", 7, "sql"),
    (4, "python_sqli", "db.execute", 9, "sql"), (5, "python_cmdi", "os.system", 5, "cmd"), (6, "python_cmdi", "os.system", 10, "path"), (7, "python_cmdi", "os.system", 10, "path"),
    (9, "python_cmdi", "os.system", 8, "line"), (9, "python_cmdi", "os.system", 11, "host"), (10, "python_cmdi", "os.system", 5, "full"), (12, "python_cmdi", "subprocess.run", 6, "cmd"),
    (12, "python_cmdi", "subprocess.run", 7, "cmd"), (12, "python_weak_hash", "hashlib.md5", 8, "data"), (13, "js_sqli", "db.query", 6, "sql"), (14, "js_xss", "res.send", 4, "res"),
    (14, "js_xss", "res.send", 6, "res"), (15, "go_sqli", "db.Query", 5, "query"), (15, "go_cmdi", "exec.Command", 6, "id"), (16, "csharp_sqli", "new SqlCommand", 7, "text"),
    (17, "java_sqli", "statement.executeQuery", 5, "sql"), (18, "php_sqli", "mysqli_query", 4, "$sql"), (19, "c_strcpy", "strcpy", 4, "name"), (22, "python_cmdi", "os.system", 10, "line"),
    (23, "python_cmdi", "os.system", 10, "value"),
]


@query("line_taint_flow", expected(LINE_FLOW, "rule_id, function_name, line, var", "c.file, e.rule_id, e.function_name, e.line::bigint as line, e.var"))
def line_taint_flow(t):
    return taint.line_taint_flow(taint.CodeFacts(t.code(), t.rules()))


SRC = {"srcs": "select distinct f.file, lower(s.source) as source from fwd f join rsrc s on s.language = f.language union select f.file, lower(s.source) from fwd f join fws s on s.fw in (f.framework, 'generic')",
       "hasrc": "select distinct a.file, a.line from asg a join srcs s on s.file = a.file and contains(lower(a.value), s.source)"}


@query("taint_gen_kill", fduck("""
select l.file, l.line, 'gen' as effect, '' as name, kind, base, member from loc l join hasrc using (file, line)
union all select l.file, l.line, 'kill', i.ident, '', '', '' from loc l join idents i using (file, line) where not exists (select 1 from hasrc h where h.file = l.file and h.line = l.line)
  and ((i.file, i.line, i.ident) in (select file, line, ident from wrapped) or (i.file, i.line, i.ident) in (select file, line, ident from placeheld))
union all select l.file, l.line, 'flow', i.ident, kind, base, member from loc l join idents i using (file, line) where not exists (select 1 from hasrc h where h.file = l.file and h.line = l.line)
  and not ((i.file, i.line, i.ident) in (select file, line, ident from wrapped) or (i.file, i.line, i.ident) in (select file, line, ident from placeheld))""",
    "loc", ctes=("code",), **USES, **FW, **FWS, **RULE_SOURCES, **SRC))
def taint_gen_kill(t):
    return taint.taint_gen_kill(taint.CodeFacts(t.code(), t.rules()))


REACH = ("select l.file, l.base from loc l join hasrc using (file, line) union select l.file, l.base from reach r"
         " join idents i on i.file = r.file and i.ident = r.base join loc l on l.file = i.file and l.line = i.line")


@query("alias_propagation", fduck("select file, base from reach", "loc", ctes=("code",), recursive=True, **USES, **FW, **FWS, **RULE_SOURCES, **SRC, reach=REACH))
def alias_propagation(t):
    return taint.alias_propagation(taint.CodeFacts(t.code(), t.rules()))


TAINTED = "select l.file, l.base from loc l join hasrc using (file, line)"


@query("tainted_in_text", fduck(f"""
select distinct s.file, s.line, x.base from (select file, line, unnest(regexp_extract_all(text, '{ID}')) as base from stmts) s join tainted x on x.file = s.file and x.base = s.base""",
    "loc", ctes=("code",), **USES, **FW, **FWS, **RULE_SOURCES, **SRC, tainted=TAINTED))
def tainted_in_text(t):
    f = taint.CodeFacts(t.code(), t.rules())
    seeds = f.definitions().filter("from_source").select("file", "base")
    return taint.tainted_in_text(f.stmts.select("file", "line", "text"), seeds).select("file", "line", "base")


@query("taint_sinks", expected(
    [(0, 8, "python_sqli", "query"), (1, 7, "python_sqli", "query"), (3, 7, "python_sqli", "sql"), (6, 10, "python_cmdi", "path"), (7, 10, "python_cmdi", "path"), (8, 8, "python_cmdi", "prev"), (10, 5, "python_cmdi", "full"),
     (13, 6, "js_sqli", "sql"), (14, 4, "js_xss", "safe"), (14, 6, "js_xss", "who"), (15, 5, "go_sqli", "query"), (15, 6, "go_cmdi", "id"), (16, 7, "csharp_sqli", "text"), (16, 7, "csharp_sqli", "cmd"),
     (17, 5, "java_sqli", "sql"), (18, 4, "php_sqli", "$sql"), (19, 4, "c_strcpy", "name"), (22, 10, "python_cmdi", "line"), (23, 10, "python_cmdi", "value"), (0, 8, "python_sqli", "row"), (2, 5, "python_sqli", "row")],
    "line, rule_id, var", "c.file, e.line::bigint as line, e.rule_id, e.var"))
def taint_sinks(t):
    """Order-free state from the alias closure against the sink statements."""
    f = taint.CodeFacts(t.code(), t.rules())
    return taint.taint_sinks(f, taint.alias_propagation(f)).select("file", "line", "rule_id", "var")


SSA_SQL = f"""
select a.file, a.line, a.target || '_' || cast(v.version as varchar) as target, string_agg(coalesce(tk.name || '_' || cast(prev.version as varchar), tk.name), '' order by tk.pos) as value
from asg a join ver v using (file, line) join toks tk on tk.file = a.file and tk.line = a.line
left join (select t2.file, t2.line, t2.pos, max(w.version) as version from toks t2 join ver w on w.file = t2.file and w.target = t2.name and w.line < t2.line group by 1, 2, 3) prev on prev.file = tk.file and prev.line = tk.line and prev.pos = tk.pos
group by 1, 2, 3"""


@query("ssa_rewrite", fduck(SSA_SQL, "asg", ver="select file, line, target, row_number() over (partition by file, target order by line) as version from asg",
       toks=f"select file, line, unnest(regexp_extract_all(value, '{ID}|[^A-Za-z_$]+')) as name, unnest(generate_series(1, len(regexp_extract_all(value, '{ID}|[^A-Za-z_$]+')))) as pos from asg"))
def ssa_rewrite(t):
    return taint.ssa_rewrite(taint.CodeFacts(t.code(), t.rules()))


# edges per program, read off the program texts; "6x" is the end of the block opened at line 6, "6m" its merge point
IF_ELSE = "5>6 6>7:true 6>8:false 7>6x 6x>6m 8>9:true 9>8x 8x>6m 6m>10"
BLOCK_EDGES = {
    6: IF_ELSE, 7: IF_ELSE, 8: "5>7 7>8:true 8>7x 7x>7:loop_back 7>7m:false 7m>11", 14: "2>5 5>6:true 6>5x 5x>5m 5>5m:false 5m>7",
    16: "1>3:true 3>1x 1x>1m 1m>9", 17: "1>2:true 2>1x 1x>1m 1m>7", 22: IF_ELSE + " 8>6m:false",
    23: "5>6 6>7:true 6>8:error 7>6x 6x>8:error 6x>6m 8>9:true 9>8x 8x>6m 6m>10",
}


def _edge_rows():
    def node(x):
        return int(x.rstrip("xm")) * 4 + {"x": 1, "m": 2}.get(x[-1], 0)

    for pid, text in BLOCK_EDGES.items():
        for e in text.split():
            ends, _, cond = e.partition(":")
            a, b = ends.split(">")
            yield (pid, node(a), node(b), cond)


@query("block_edges", expected(list(_edge_rows()), "src, dst, condition", "c.file, e.src::bigint as src, e.dst::bigint as dst, e.condition"))
def block_edges(t):
    from wardlight.operators import blocks

    s = stmts(t)
    return blocks.block_edges(blocks.with_roles(s))
