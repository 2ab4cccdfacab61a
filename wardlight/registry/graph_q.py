"""Queries for graph operators and rule checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.catalog.fixed import ALLOWED_CLASSES, ALLOWED_CONFIDENCE, FORBIDDEN_SINKS, RULE_FIELDS, SANITIZER_LIKE
from wardlight.operators import graph, rules_check
from wardlight.registry.core import query
from wardlight.sources.tree import register_rules as register
from wardlight.views import duck, lit, values

GK = {
    "gen": "select s_suppkey as node, s_nationkey as loc from supplier where s_acctbal < 1500",
    "kill": "select distinct l_suppkey as node, l_partkey % 25 as loc from lineitem where l_quantity = 50 and l_discount = 0.1",
}


def gen_kill(t):
    """GEN: suppliers with a low balance make the location of their nation. KILL: pairs from the largest order lines at the
    highest discount. Locations are as many as nations, so facts grow with the nodes."""
    e = t.edges()
    gen = t.read("supplier").filter("s_acctbal < 1500").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("loc"))
    kill = t.read("lineitem").filter("l_quantity = 50 and l_discount = 0.1").select(F.col("l_suppkey").alias("node"), (F.col("l_partkey") % 25).alias("loc")).distinct()
    return e, gen, kill


@query("graph_neighbors", duck("select src as node, 'successor' as relation, dst as neighbor from edges union select dst, 'predecessor', src from edges", "edges"))
def graph_neighbors(t):
    return graph.graph_neighbors(t.edges())


@query("taint_transfer", duck("""
select node, loc from gen union select e.dst, g.loc from edges e join gen g on g.node = e.src where not exists (select 1 from kill k where k.node = e.dst and k.loc = g.loc)""", "edges", **GK))
def taint_transfer(t):
    e, gen, kill = gen_kill(t)
    return graph.taint_transfer(e, gen, gen, kill)


@query("taint_fixpoint", duck("select node, loc from st", "edges", recursive=True, **GK,
       st="select node, loc from gen union select e.dst, s.loc from st s join edges e on e.src = s.node where not exists (select 1 from kill k where k.node = e.dst and k.loc = s.loc)"))
def taint_fixpoint(t):
    e, gen, kill = gen_kill(t)
    return graph.taint_fixpoint(e, gen, kill)


@query("call_reachability", duck("select root, node, min(depth)::int as depth from r group by 1, 2", "edges", recursive=True,
       r="select s_suppkey as root, s_suppkey as node, 0 as depth from (select s_suppkey from supplier order by s_suppkey limit 5) union select r.root, e.dst, r.depth + 1 from r join edges e on e.src = r.node where r.depth < 5"))
def call_reachability(t):
    """From a short list of roots, so the result grows with the nodes and not with their square."""
    roots = t.read("supplier").select(F.col("s_suppkey").alias("node")).orderBy("node").limit(5)
    return graph.call_reachability(t.edges(), roots, 5)


def _url(v):
    return f"concat('http://h', cast({v} % 4 as string), '.example/p', cast({v} as string))"


def _host(v):
    return f"concat('h', cast({v} % 4 as string), '.example')"


@query("crawl_frontier", duck("select host, url, depth::int as depth from (select host, url, min(depth) as depth from c group by 1, 2)", "edges", recursive=True,
       links=f"select {_host('src')} as host, {_url('src')} as url, {_host('dst')} as target_host, {_url('dst')} as target from edges",
       seeds=f"select {_host('v')} as host, {_url('v')} as url from (select min(src) as v from edges group by src % 4)",
       c="select host, url, 0 as depth from seeds union select c.host, l.target, c.depth + 1 from c join links l on l.host = c.host and l.url = c.url and l.target_host = l.host where c.depth < 40"))
def crawl_frontier(t):
    e = t.edges()
    links = e.select(F.expr(_host("src")).alias("host"), F.expr(_url("src")).alias("url"), F.expr(_host("dst")).alias("target_host"), F.expr(_url("dst")).alias("target"))
    seeds = e.groupBy(F.expr("src % 4")).agg(F.min("src").alias("v")).select(F.expr(_host("v")).alias("host"), F.expr(_url("v")).alias("url"))
    return graph.crawl_frontier(links, seeds)


# ---------------------------------------------------------------------------- rule sets
def _lint_sql(level, msg, rem):
    parts = []
    for f in RULE_FIELDS:
        cond = f"{f} is null" if f in ("sources", "sinks", "sanitizers", "cvss_score") else f"({f} is null or {f} = '')"
        parts.append(f"select rule_id, 'missing or empty' as violation, '{f}' as detail from part_rules where {cond}")
    parts.append("select rule_id, 'class not allowed', vuln_class from part_rules where vuln_class not in (" + ", ".join(lit(c) for c in ALLOWED_CLASSES) + ")")
    parts.append("select rule_id, 'confidence not allowed', confidence from part_rules where confidence not in (" + ", ".join(lit(c) for c in ALLOWED_CONFIDENCE) + ")")
    parts.append(f"select rule_id, 'message too short', '{msg}' from part_rules where length(trim(message)) < {msg}")
    parts.append(f"select rule_id, 'remediation too short', '{rem}' from part_rules where length(trim(remediation)) < {rem}")
    parts.append("select rule_id, 'boilerplate remediation', '' from part_rules where contains(lower(remediation), 'validate and sanitize all user input')")
    parts.append("select rule_id, 'forbidden sink', s from (select rule_id, unnest(sinks) as s from part_rules) where " + " or ".join(f"contains(lower(s), {lit(w.lower())})" for w in FORBIDDEN_SINKS))
    parts.append("select rule_id, 'sanitizer in sources', s from (select rule_id, unnest(sources) as s from part_rules) where " + " or ".join(f"contains(lower(s), {lit(w)})" for w in SANITIZER_LIKE))
    parts.append("select rule_id, 'duplicate id', cast(count(*) as varchar) from part_rules group by 1 having count(*) > 1")
    return " union all ".join(parts)


@query("rule_lint", duck(f"select 'basic' as level, * from ({_lint_sql('basic', 50, 80)}) union all select 'strict', * from ({_lint_sql('strict', 80, 100)})", "part_rules"))
def rule_lint(t):
    r = t.part_rules()
    a = rules_check.rule_lint(r, "basic").withColumn("level", F.lit("basic"))
    return a.unionByName(rules_check.rule_lint(r, "strict").withColumn("level", F.lit("strict")))


@query("rule_corpus_profile", duck("""
select 'language' as dimension, language as value, count(*) as n_rules from part_rules group by 2 union all select 'vuln_class', vuln_class, count(*) from part_rules group by 2
union all select 'severity', severity, count(*) from part_rules group by 2 union all select 'confidence', confidence, count(*) from part_rules group by 2
union all select 'tokens', '', count(distinct tok) from (select unnest(list_concat([s], list_filter(regexp_split_to_array(s, '[.\\s:>(]+'), lambda p: length(p) > 1), case when contains(s,'.') then [regexp_extract(s,'[^.]*$')] else [] end)) as tok
 from (select trim(lower(unnest(sinks))) as s from part_rules))""", "part_rules"))
def rule_corpus_profile(t):
    return rules_check.rule_corpus_profile(t.part_rules())


def _hash_sql():
    body = " || '|' || ".join(f"coalesce({f},'~')" for f in RULE_FIELDS if f not in ("sources", "sinks", "sanitizers", "cvss_score"))
    body += " || '|' || array_to_string(sources, ',') || '|' || array_to_string(sinks, ',') || '|' || array_to_string(sanitizers, ',')"
    sums = ", ".join(f"sum(('0x' || substring(h, {1 + 15 * i}, 15))::bigint::hugeint) as s{i}" for i in range(4))
    return ("select n_rules, sha256(cast(s0 as varchar) || '-' || cast(s1 as varchar) || '-' || cast(s2 as varchar) || '-' || cast(s3 as varchar)) as digest from"
            f" (select count(*) as n_rules, {sums} from (select sha256({body}) as h from part_rules))")


@query("rule_set_hash", duck(_hash_sql(), "part_rules"))
def rule_set_hash(t):
    return rules_check.rule_set_hash(t.part_rules())


@query("register_rules", duck(f"""
select rule_id, language, vuln_class, 'user' as origin from part_rules where rule_id not in (select rule_id from bad) and rule_id not in ('rule_3','rule_4')
union all select rule_id, language, vuln_class, 'shipped' from base where rule_id not in (select rule_id from part_rules where rule_id not in (select rule_id from bad))
union all select rule_id, language, vuln_class, 'user' from part_rules where rule_id in ('rule_3','rule_4') and rule_id not in (select rule_id from bad)""", "part_rules",
    bad=f"select distinct rule_id from ({_lint_sql('basic', 50, 80)})", base="select rule_id, language, vuln_class from part_rules where severity = 'Low'"))
def register_rules(t):
    """User rules (all parts) over a shipped set (the low ones): faulty user rules stay out, good ones win."""
    r = t.part_rules()
    base = r.filter("severity = 'Low'").withColumn("severity", F.lit("shipped"))
    out = register(base, r)
    return out.select("rule_id", "language", "vuln_class", F.when(F.col("severity") == "shipped", "shipped").otherwise("user").alias("origin"))
