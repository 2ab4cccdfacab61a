"""Tables of one data folder and the relations derived from them.

Every derived relation exists twice: as a DataFrame built by Spark and as a DuckDB common table expression,
so operators can be compared on the same input. Shared select lists are plain SQL valid in both.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.catalog.fixed import LANGUAGE_BY_EXT
from wardlight.catalog.programs import PROGRAMS
from wardlight.catalog.rules import rule_rows, rules_df
from wardlight.session import dealt, spread

# ---------------------------------------------------------------------------- shared select lists
FINDING_COLS = [
    "concat_ws('-', lpad(cast(l_orderkey as string),12,'0'), lpad(cast(l_linenumber as string),2,'0'),"
    " lpad(cast(l_partkey as string),12,'0'), lpad(cast(l_suppkey as string),10,'0'),"
    " lpad(cast(cast(round(l_extendedprice*100) as bigint) as string),14,'0')) as seq",
    "l_orderkey % 500 as scan_id",
    "concat('rule_',cast(l_partkey % 40 as string)) as rule_id",
    "case l_partkey % 8 when 0 then 'SQLi' when 1 then 'XSS' when 2 then 'CMDi' when 3 then 'Hardcoded Secret'"
    " when 4 then 'Weak Crypto' when 5 then 'SSRF' when 6 then 'Race Condition' else 'DoS' end as vuln_class",
    "concat('src/f',cast(l_suppkey as string),'.py') as file",
    "cast(l_linenumber + l_suppkey % 50 as bigint) as line",
    "case when l_quantity>=46 then 'Critical' when l_quantity>=36 then 'High' when l_quantity>=16 then 'Medium'"
    " when l_quantity>=4 then 'Low' else 'Info' end as severity",
    "case l_returnflag when 'A' then 'Confirmed' when 'N' then 'Probable' else 'Tentative' end as confidence",
    "1 + (l_partkey + l_linenumber) % 4 as trace_len",
    "case when l_linestatus='F' then round(l_discount*100,1) end as cvss_score",
]
SCAN_COLS = [
    "event_id as scan_id",
    "case event_type when 'view' then 'sast' when 'click' then 'dast' when 'purchase' then 'port'"
    " when 'signup' then 'secret' else 'dependency' end as scan_type",
    "ts",
    "concat('target_',cast(user_id as string)) as target",
    "cast(100 - least(100, floor(value)) as int) as score",
]
RESPONSE_COLS = [
    "page_id as resp_id", "url", "case when page_id % 2 = 0 then 'GET' else 'OPTIONS' end as method",
    "cast(case page_id % 5 when 0 then 200 when 1 then 204 when 2 then 404 when 3 then 500 else 0 end as int) as status",
    "100 + (page_id * 37) % 6000 as ms", "html as body",
    "case when page_id % 9 = 4 then 'image/png' when page_id % 9 = 5 then 'application/pdf' else 'text/html' end as content_type",
    "case page_id % 4 when 0 then null when 1 then 'max-age=300' when 2 then 'max-age=31536000; includeSubDomains' else 'max-age=bad' end as h_hsts",
    "case page_id % 3 when 0 then null when 1 then 'default-src *; script-src ''unsafe-inline''' else 'default-src ''none''; frame-ancestors ''none''' end as h_csp",
    "case page_id % 3 when 0 then null when 1 then 'DENY' else 'ALLOW-ALL' end as h_xfo",
    "case when page_id % 2 = 0 then 'nosniff' end as h_xcto",
    "case page_id % 3 when 0 then null when 1 then 'unsafe-url' else 'no-referrer' end as h_referrer",
    "case when page_id % 5 = 0 then 'nginx/1.2' end as h_server",
    "case when page_id % 7 = 0 then '*' when page_id % 7 = 1 then 'https://probe.example' end as h_acao",
    "case when page_id % 2 = 0 then 'true' else 'false' end as h_acac",
    "case when page_id % 4 = 1 then 'GET, PUT, TRACE' end as h_allow",
    "case when page_id % 3 = 0 then 'no-store' end as h_cache",
    "case when page_id % 6 = 0 then 'https://other.example/x' end as h_location",
]
CALLBACK_COLS = [
    "concat('/cb/id-',cast(user_id as string)) as path", "ts as received_at", "event_id as callback_id",
]
PROBE_COLS = ["concat('id-',cast(user_id as string)) as canary", "ts as issued_at", "event_id as probe_id"]

HEADER_COLUMNS = {
    "h_hsts": "Strict-Transport-Security", "h_csp": "Content-Security-Policy", "h_xfo": "X-Frame-Options",
    "h_xcto": "X-Content-Type-Options", "h_referrer": "Referrer-Policy", "h_server": "Server",
    "h_acao": "Access-Control-Allow-Origin", "h_acac": "Access-Control-Allow-Credentials", "h_allow": "Allow",
    "h_cache": "Cache-Control", "h_location": "Location",
}


class Tables:
    """Lazy reader of the parquet tables below ``sf_dir`` plus the derived relations."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    # -- source lines ---------------------------------------------------------------------------
    def src_files(self) -> DataFrame:
        return spread(self.read("documents").select("doc_id", "source", "text")).select(
            F.concat(F.lit("src/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
            "source", "doc_id", F.col("text").alias("content"),
        )

    def src_lines(self) -> DataFrame:
        from wardlight.operators.lines import source_lines

        return source_lines(self.src_files().select("file", "source", "content"), keep=("file", "source"))

    # -- findings and scans ---------------------------------------------------------------------
    def findings(self, heavy: bool = False) -> DataFrame:
        """One finding per order line; ``heavy`` deals a small table out to all cores first."""
        base = self.read("lineitem")
        return (spread(base) if heavy else base).selectExpr(*FINDING_COLS)

    def scans(self) -> DataFrame:
        return self.read("events").selectExpr(*SCAN_COLS)

    # -- web ------------------------------------------------------------------------------------
    def responses(self) -> DataFrame:
        flat = spread(self.read("pages")).selectExpr(*RESPONSE_COLS)
        pairs = F.array(*[F.struct(F.lit(h).alias("k"), F.col(c).alias("v")) for c, h in HEADER_COLUMNS.items()])
        present = F.filter(pairs, lambda p: p["v"].isNotNull())
        return flat.withColumn("headers", F.map_from_entries(present)).drop(*HEADER_COLUMNS)

    def pages(self) -> DataFrame:
        return spread(self.read("pages"))

    def probes(self) -> DataFrame:
        return self.read("events").filter("event_type = 'signup'").selectExpr(*PROBE_COLS)

    def callbacks(self) -> DataFrame:
        return self.read("events").filter("event_type = 'purchase'").selectExpr(*CALLBACK_COLS)

    # -- code files -----------------------------------------------------------------------------
    def code_files(self) -> DataFrame:
        programs = self.spark.createDataFrame(
            [(i, n, c) for i, (n, c) in enumerate(PROGRAMS)], "pid int, name string, body string"
        )
        cust = spread(self.read("customer").select("c_custkey")).select("c_custkey", (F.col("c_custkey") % len(PROGRAMS)).cast("int").alias("pid"))
        return cust.join(F.broadcast(programs), "pid").select(
            "pid",
            F.concat(F.lit("src/u"), F.col("c_custkey").cast("string"), F.lit("/"), "name").alias("file"),
            F.replace("body", F.lit("@K@"), F.col("c_custkey").cast("string")).alias("content"),
        )

    def code(self) -> DataFrame:
        """Code files with a language, as the extractors take them."""
        from wardlight.operators.files import with_language

        return with_language(self.code_files()).filter(F.col("language").isNotNull())

    def order_code(self) -> DataFrame:
        """A program for each order, a statement for each of its line items (a few)."""
        items = self.read("lineitem").select("l_orderkey", "l_linenumber", F.expr(ORDER_STEP).alias("step"))
        each = spread(items).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "step"))).alias("items"))
        v = lambda i: F.concat(F.lit("v"), i.cast("string"))
        work = lambda x, i: F.concat(F.lit("    "), v(i + 1), F.lit(" = "), F.when(i == 0, F.concat(F.lit('request.args.get("o'), F.col("l_orderkey").cast("string"), F.lit('")'))).when(
            x["step"] == "join", F.concat(F.lit('"a" + '), v(i))).otherwise(F.concat(x["step"], F.lit("("), v(i), F.lit(")"))), F.lit("\n"))
        text = F.concat(F.lit(ORDER_HEAD), F.array_join(F.transform("items", work), ""), F.lit("    run("), v(F.size("items")), F.lit(")\n"))
        return each.select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".py")).alias("file"), F.lit("python").alias("language"), text.alias("content"))

    # -- rules ----------------------------------------------------------------------------------
    def rules(self) -> DataFrame:
        return rules_df(self.spark)

    def part_rules(self) -> DataFrame:
        """A rule set as large as ``part``: one rule per part, with the defects a rule check looks for."""
        return self.read("part").selectExpr(*PART_RULE_COLS)

    # -- graph ----------------------------------------------------------------------------------
    def edges(self) -> DataFrame:
        vertices = self.read("supplier").agg(F.count("*")).scalar()
        ends = self.read("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % vertices).alias("dst"))
        return dealt(ends, "src", "dst").distinct()

    # -- spans ----------------------------------------------------------------------------------
    def span_events(self) -> DataFrame:
        """Definitions and uses; a file is a user, a line is the event number."""
        return self.read("events").selectExpr(*[c for c in SPAN_COLS])

    # -- cache ----------------------------------------------------------------------------------
    def scan_cache(self) -> DataFrame:
        return self.read("documents").selectExpr(*_cache_cols("sha2({},256)"))

    def older_cache(self) -> DataFrame:
        """A cache from before a third of the documents came in, so that lookups have misses."""
        return self.scan_cache().filter("doc_id % 3 <> 0")


# what a line item does with the value of the one before
ORDER_STEP = "case when l_quantity > 45 then 'drop' when l_returnflag = 'R' then 'keep' else 'join' end"
ORDER_HEAD = '''from flask import request

def keep(part):
    return "p" + part

def drop(part):
    return "none"

def run(line):
    os.system(line)

def job():
'''
SPAN_COLS = [
    "user_id as file", "event_id as line", "concat('v',cast(event_id % 5 as string)) as name",
    "case when event_type in ('signup','purchase') then 'def' else 'use' end as kind", "event_type",
]


def _cache_cols(sha: str) -> list[str]:
    return [
        sha.format("concat(source,cast(doc_id as string),text)") + " as k",
        "case when doc_id % 10 = 0 then 'old' else 'cur' end as rule_hash",
        "doc_id % 7 as access_count",
        "case when doc_id % 11 = 0 then 'not-a-time' else concat('2024-01-', lpad(cast(1 + doc_id % 28 as string),2,'0'), 'T00:00:00') end as stored_at",
        "doc_id",
    ]


PART_RULE_COLS = [
    "concat('rule_',cast(p_partkey - case when p_partkey % 97 = 5 then 1 else 0 end as string)) as rule_id",
    "case p_size % 4 when 0 then 'python' when 1 then 'javascript' when 2 then 'java' else 'go' end as language",
    "case p_partkey % 9 when 0 then 'SQLi' when 1 then 'XSS' when 2 then 'CMDi' when 3 then 'SSRF' when 4 then 'ReDoS'"
    " when 5 then 'CSRF' when 6 then 'Weak Crypto' when 7 then 'RCE' else 'DoS' end as vuln_class",
    "case p_partkey % 5 when 0 then 'Critical' when 1 then 'High' when 2 then 'Medium' when 3 then 'Low' else 'Info' end as severity",
    "case when p_partkey % 31 = 7 then null else concat('CWE-',cast(p_size as string)) end as cwe",
    "case when p_partkey % 29 = 3 then '' else 'A03:2021' end as owasp",
    "case when p_partkey % 37 = 2 then null else round(p_size / 5.0, 1) end as cvss_score",
    "'CVSS:3.1/AV:N' as cvss_vector",
    "case p_partkey % 11 when 0 then 'Sure' when 1 then 'Tentative' else 'Confirmed' end as confidence",
    "concat('issue ',p_name) as issue",
    "case when p_partkey % 13 = 1 then 'short' when p_partkey % 13 = 2 then concat('a message between the two limits of length, for ', p_name)"
    " else concat('a message long enough to pass both of the length checks that are made on every rule: ', p_name) end as message",
    "array(concat('read.', replace(p_name,' ','.')), case when p_partkey % 41 = 0 then 'html.escape(' else 'get(' end) as sources",
    "array(concat(replace(p_name,' ','.'),'(') , case when p_partkey % 43 = 0 then 'fake_sink' else concat('run_', p_type, '.exec') end) as sinks",
    "array(concat('clean_', p_brand)) as sanitizers",
    "case when p_partkey % 17 = 1 then 'Validate and sanitize all user input.' when p_partkey % 17 = 2 then concat('a remediation that is only of middling length, though it is not short at all: ', p_name)"
    " else concat('a remediation long enough to pass both of the length checks that are made on every rule, as it should be: ', p_name) end as remediation",
]


# ---------------------------------------------------------------------------- DuckDB side
def lit(s: str | None) -> str:
    """SQL literal of a text."""
    return "null" if s is None else "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple], cols: str) -> str:
    """``select * from (values ...) t(cols)`` for python rows."""
    def one(v):
        if v is None or isinstance(v, str):
            return lit(v)
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(one(x) for x in v) + "]"
        return repr(v)

    body = ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)
    return f"select * from (values {body}) t({cols})"


def _pattern_rows() -> list[tuple]:
    out = []
    for r in rule_rows():
        for kind, i in (("source", 11), ("sink", 12), ("sanitizer", 13)):
            out += [(r[0], r[1], r[2], kind, p.lower()) for p in r[i]]
    return out


_DUCK_PART = ", ".join(PART_RULE_COLS).replace("array(", "list_value(")

CTE: dict[str, tuple[list[str], str]] = {
    "src_files": ([], "select concat('src/',source,'/',cast(doc_id as varchar),'.txt') as file, source, doc_id, text as content from documents"),
    "src_lines": (["src_files"], "select file, source, unnest(generate_series(1,len(string_split(content,chr(10))))) as line,"
                  " unnest(string_split(content,chr(10))) as text from src_files"),
    "findings": ([], "select " + ", ".join(FINDING_COLS) + " from lineitem"),
    "scans": ([], "select " + ", ".join(SCAN_COLS) + " from events"),
    "responses": ([], "select " + ", ".join(RESPONSE_COLS) + " from pages"),
    "probes": ([], "select " + ", ".join(PROBE_COLS) + " from events where event_type='signup'"),
    "callbacks": ([], "select " + ", ".join(CALLBACK_COLS) + " from events where event_type='purchase'"),
    "programs": ([], values([(i, n, c) for i, (n, c) in enumerate(PROGRAMS)], "pid, name, body")),
    "code_files": (["programs"], "select p.pid, concat('src/u',cast(c_custkey as varchar),'/',p.name) as file, c_custkey as k,"
                   f" replace(p.body,'@K@',cast(c_custkey as varchar)) as content from customer c join programs p on c.c_custkey % {len(PROGRAMS)} = p.pid"),
    "languages": ([], values(list(LANGUAGE_BY_EXT.items()), "ext, language")),
    "code": (["code_files", "languages"], "select f.*, l.language from code_files f join languages l on l.ext = lower(regexp_extract(regexp_replace(f.file,'^.*/',''),'\\.[^.]*$'))"),
    "code_lines": (["code"], "select file, pid, k, language, unnest(generate_series(1,len(string_split(content,chr(10))))) as line,"
                   " unnest(string_split(content,chr(10))) as text from code"),
    "rule_patterns": ([], values(_pattern_rows(), "rule_id, language, vuln_class, kind, pattern")),
    "part_rules": ([], f"select {_DUCK_PART} from part"),
    "edges": ([], "select distinct l_suppkey src, l_partkey % (select count(*) from supplier) dst from lineitem"),
    "span_events": ([], "select " + ", ".join(SPAN_COLS) + " from events"),
    "scan_cache": ([], "select " + ", ".join(_cache_cols("sha256({})")) + " from documents"),
    "older_cache": (["scan_cache"], "select * from scan_cache where doc_id % 3 <> 0"),
}


def duck(body: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """Put the named common table expressions (with what they need) and ``extra`` ones before ``body``."""
    order: list[str] = []

    def add(n):
        for d in CTE[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} as ({CTE[n][1]})" for n in order] + [f"{n} as ({q})" for n, q in extra.items()]
    if not parts:
        return body
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
