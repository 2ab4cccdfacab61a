"""Queries for readers, writers and JSON round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.registry.core import query
from wardlight.session import scratch_path
from wardlight.sources import records, tree
from wardlight.views import RESPONSE_COLS, Tables, duck, lit


def scratch_folder(t: Tables, name: str) -> str:
    """Folder for tables a query writes."""
    return scratch_path(t.spark, name)


@query("response_log_read", duck(
    "select resp_id, url, status, cast(length(body) as int) as body_chars from responses"
    " where not regexp_matches(content_type, '^(image/|video/|audio/|application/octet-stream|application/pdf|application/zip|font/)')",
    "responses"))
def response_log_read(t):
    return records.response_log_read(t.responses()).select("resp_id", "url", "status", F.length("body").alias("body_chars"))


@query("history_read", duck(
    "select scan_id, scan_type, ts, target, score from scans order by ts desc, scan_id desc limit 50", "scans"))
def history_read(t):
    return records.history_read(t.scans(), 50)


@query("history_append", duck("select scan_type, count(*) as scans, min(ts) as first_ts, max(ts) as last_ts, cast(sum(score) as bigint) as score_sum from scans group by 1", "scans"))
def history_append(t):
    """Append the scans of each type in turn, then roll up what was written."""
    path = scratch_folder(t, "history")
    scans = t.scans()
    records.history_append(scans.filter("scan_type in ('sast','dast')"), path)
    records.history_append(scans.filter("scan_type not in ('sast','dast')"), path)
    return records.history_load(t.spark, path).groupBy("scan_type").agg(
        F.count("*").alias("scans"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("score").alias("score_sum"))


def full_findings(t):
    """F2 findings with the texts and trace of the full record."""
    f = t.findings(heavy=True)
    step = F.transform(
        F.sequence(F.lit(1), F.col("trace_len").cast("int")),
        lambda i: F.struct(i.alias("step"), (F.col("line") + i).alias("line"), F.col("file").alias("file"), F.concat(F.lit("step "), i.cast("string")).alias("description")),
    )
    return f.select(
        F.col("seq").alias("id"), "rule_id", "vuln_class", F.lit("sast").alias("scan_type"), "file", "line", "severity",
        "confidence", "cvss_score", F.concat(F.lit("say \""), "rule_id", F.lit("\"")).alias("issue"), step.alias("taint_trace"),
    )


@query("findings_json_export", duck("""
select seq, json_extract_string(j,'$.issue') as issue, json_extract_string(j,'$.severity') as severity,
  cast(json_extract(j,'$.line') as bigint) as line, cast(json_extract(j,'$.cvss_score') as double) as cvss_score,
  cast(json_array_length(j,'$.taint_trace') as bigint) as steps, json_extract_string(j,'$.taint_trace[0].description') as first_step
from (select seq, to_json(struct_pack(issue := 'say "' || rule_id || '"', severity := severity, line := line, cvss_score := cvss_score,
  taint_trace := list_transform(generate_series(1, trace_len), lambda i: struct_pack(step := i, description := 'step ' || cast(i as varchar))))) as j from findings)
""", "findings"))
def findings_json_export(t):
    """Export to JSON, read back field by field; one parse of a text gives all fields."""
    j = records.findings_json_export(full_findings(t), keep=("id",))
    fields = "issue string, severity string, line bigint, cvss_score double, taint_trace array<struct<description:string>>"
    return j.select(F.col("id").alias("seq"), F.from_json("json", fields).alias("f")).select(
        "seq", "f.issue", "f.severity", "f.line", "f.cvss_score", F.size("f.taint_trace").cast("bigint").alias("steps"),
        F.get("f.taint_trace", F.lit(0))["description"].alias("first_step"))


@query("findings_json_import", duck("""
select seq as id, case when length(rule_id) = 6 then '' else rule_id end as rule_id, file, line, case when severity = 'Info' then 'Medium' else severity end as severity,
  'High' as confidence, 'sast' as scan_type, '' as issue, cast(0 as bigint) as steps, cvss_score from findings""", "findings"))
def findings_json_import(t):
    """JSON records with some fields left out take the defaults."""
    f = t.findings(heavy=True)
    texts = f.select(F.to_json(F.struct(
        F.col("seq").alias("id"), F.when(F.length("rule_id") != 6, F.col("rule_id")).alias("rule_id"), "file", "line",
        F.when(F.col("severity") != "Info", F.col("severity")).alias("severity"), "cvss_score")).alias("json"))
    return records.findings_json_import(texts).select(
        "id", "rule_id", "file", "line", "severity", "confidence", "scan_type", "issue", F.size("taint_trace").cast("bigint").alias("steps"), "cvss_score")


MANIFEST_SQL = (
    "select concat('app/', cast(c_custkey as string), '/package.json') as file, case when c_custkey % 10 = 7 then '{\"dependencies\": {\"express\": '"
    " else concat('{\"name\": \"app\", \"dependencies\": {\"express\": \"', case c_custkey % 4 when 0 then '3.' when 1 then '^3.' when 2 then '4.' else '13.' end,"
    " cast(c_nationkey as string), '.0\", \"left\": \"1.', cast(c_custkey as string), '\"}', case when c_custkey % 3 = 0 then"
    " concat(', \"devDependencies\": {\"left\": \"9.', cast(c_custkey as string), '\", \"jest\": \"29\"}') else '' end, '}') end as content from {customer}"
)


def manifests(t):
    return t.spark.sql(MANIFEST_SQL.replace("{customer}", "parquet.`" + t.sf_dir + "/customer.parquet`"))


DUCK_MANIFEST = MANIFEST_SQL.replace("{customer}", "customer")
DUCK_DEPS = """
select file, pkg, version from (
  select file, unnest(json_keys(content,'$.dependencies')) as pkg, content from m where json_valid(content)) d,
  lateral (select json_extract_string(content, '$.dependencies.' || pkg) as version) v
where json_extract(content, '$.devDependencies.' || pkg) is null
union all
select file, pkg, json_extract_string(content, '$.devDependencies.' || pkg) as version from (
  select file, unnest(json_keys(content,'$.devDependencies')) as pkg, content from m where json_valid(content) and json_extract(content,'$.devDependencies') is not null)
"""


@query("manifest_read", duck(DUCK_DEPS, m=DUCK_MANIFEST))
def manifest_read(t):
    return records.manifest_read(manifests(t))


@query("source_tree_scan", duck(
    "select file, lower(regexp_extract(regexp_replace(file,'^.*/',''),'\\.[^.]*$')) as ext, cast(octet_length(encode(content)) as bigint) as size from tree_files"
    " where not regexp_matches(file, '(^|/)(node_modules|build|\\.git)/') and octet_length(encode(content)) <= 2097152"
    " and regexp_matches(file, '(\\.py|\\.Go|\\.hpp)$')",
    tree_files="select concat(case doc_id % 5 when 0 then 'node_modules/' when 1 then 'lib/.git/' when 2 then 'lib/build/' else 'lib/' end, 'd/',"
               " case doc_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'note' else 'c' end, cast(doc_id as varchar), case doc_id % 4 when 0 then '.py' when 1 then '.Go' when 2 then '.txt' else '.hpp' end) as file, text as content from documents"))
def source_tree_scan(t):
    """Write the documents out as a tree of files, then scan the tree."""
    root = scratch_folder(t, "tree")
    files = t.read("documents").select(
        F.expr("concat(case doc_id % 5 when 0 then 'node_modules/' when 1 then 'lib/.git/' when 2 then 'lib/build/' else 'lib/' end, 'd/',"
               " case doc_id % 4 when 0 then 'a' when 1 then 'b' when 2 then 'note' else 'c' end, cast(doc_id as string), case doc_id % 4 when 0 then '.py' when 1 then '.Go' when 2 then '.txt' else '.hpp' end)").alias("file"), "text")
    write_tree(files, root)
    return tree.source_tree_scan(t.spark, root).select("file", "ext", "size")


def write_tree(files, root):
    """Write ``(file, text)`` rows as files below ``root``, a path or an address that Arrow's file systems know."""

    def write(batches):
        import pandas as pd
        from pyarrow import fs as afs

        fs, base = afs.FileSystem.from_uri(root) if ":" in root else (afs.LocalFileSystem(), root)
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["text"]):
                path = f"{base}/{name}"
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(path) as f:
                    f.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(pdf)]})

    files.mapInPandas(write, "n bigint").agg(F.sum("n")).collect()


RULE_YAML_SQL = (
    "concat('rule_id: ', case when p_partkey % 19 = 4 then '' else concat('part_', cast(p_partkey - case when p_partkey % 20 = 9 then 1 else 0 end as string)) end,"
    " '\\nlanguage: python\\nvuln_class: SQLi\\nseverity: High\\ncvss_score: ', cast(p_size as string), '\\nsources:\\n- ', replace(p_name,' ','.'), '\\nsinks:\\n- run(\\n- ', p_type, '.exec\\n')"
)


@query("rule_catalog_load", duck(
    "select 'part_' || cast(id as varchar) as rule_id, language, severity, arg_max(cvss, p_partkey) as cvss_score, arg_max(src, p_partkey) as source, arg_max(sink, p_partkey) as last_sink from ("
    "select p_partkey - case when p_partkey % 20 = 9 then 1 else 0 end as id, p_partkey, 'python' as language, 'High' as severity, cast(p_size as double) as cvss, replace(p_name,' ','.') as src,"
    " p_type || '.exec' as sink from part where p_partkey % 19 <> 4) group by 1, 2, 3"))
def rule_catalog_load(t):
    """Write one YAML rule per part, a thousand to a file, then load the folder."""
    root = scratch_folder(t, "rules")
    each = t.read("part").select("p_partkey", F.expr("p_partkey div 1000").alias("k"), F.expr(RULE_YAML_SQL).alias("text"))
    docs = F.array_sort(F.collect_list(F.struct("p_partkey", "text")))
    files = each.groupBy("k").agg(docs.alias("docs")).select(
        F.format_string("python/r%012d.yaml", "k").alias("file"), F.array_join(F.col("docs.text"), "---\n").alias("text"))
    write_tree(files, root)
    r = tree.rule_catalog_load(t.spark, root)
    return r.select("rule_id", "language", "severity", "cvss_score", F.get("sources", F.lit(0)).alias("source"), F.element_at("sinks", -1).alias("last_sink"))
