"""Operators against brute force on small inputs, and the round trips of readers and writers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from wardlight.catalog.rules import rules_df
from wardlight.functions import cols
from wardlight.functions.code import calls_udf, in_runs, outline_udf
from wardlight.operators import cache, dedup, extract, findings, graph, intervals, lines, ordered, pages, patterns, rules_check, rules_match, scoring, secrets, taint, triage, web_audit
from wardlight.operators.patterns import PatternSet
from wardlight.session import dealt
from wardlight.sources import records, tree

R = random.Random(7)


def test_running_number_and_last_before(spark):
    rows = sorted({(R.choice("ab"), R.randrange(5000)) for _ in range(600)})
    rows = [(k, n, R.random() < 0.3) for k, n in rows]
    df = spark.createDataFrame(rows, "k string, n bigint, d boolean")
    num = {(r.k, r.n): r.v for r in ordered.running_number(df, ["k"], "n", "v", chunk=70).collect()}
    last = {(r.k, r.n): r.v for r in ordered.last_before(df, ["k"], "n", F.when(F.col("d"), F.col("n")), "v", chunk=70).collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        for i, (_, n, _) in enumerate(mine):
            assert num[(k, n)] == i + 1
            before = [m for _, m, d in mine[:i] if d]
            assert last[(k, n)] == (before[-1] if before else None)


@pytest.mark.parametrize("n", [0, 1, 17, 250, 499, 500, 900])
def test_newest_rows(spark, n):
    rng = random.Random(3)
    rows = [(rng.choice([5, 5, 5, 6, 9, -1]), f"{rng.randrange(16**8):08x}{i:04d}") for i in range(500)]
    df = spark.createDataFrame(rows, "s bigint, k string")
    got = {r.k for r in ordered.newest_rows(df, n, "s", "k").collect()}
    assert got == {k for _, k in sorted(rows, key=lambda r: (-r[0], r[1]))[:n]}


def test_first_by_on_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", R.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v bigint, seq bigint")
    got = {r.k: (r.v, r.seq) for r in dedup.first_by(df, ["k"], ["v", "seq"]).collect()}
    best = {}
    for k, v, s in rows:
        best[k] = min(best.get(k, (99, 0)), (v, s))
    assert got == best


def test_enclosing(spark):
    spans = [("f", f"s{i}", a, a + R.randrange(1, 900)) for i, a in enumerate(R.sample(range(3000), 60))]
    pts = [("f", n) for n in R.sample(range(4000), 200)] + [("g", 1)]
    sp = spark.createDataFrame(spans, "file string, name string, start_line bigint, end_line bigint")
    p = spark.createDataFrame(pts, "file string, line bigint")
    got = {(r.file, r.line): r.func_start for r in intervals.enclosing_function(p, sp, bucket=64).collect()}
    out = {(r.file, r.line) for r in intervals.module_scope_filter(p, sp, bucket=64).collect()}
    for f, n in pts:
        inside = [a for ff, _, a, b in spans if ff == f and a <= n <= b]
        assert got[(f, n)] == max(inside, default=0)
        assert ((f, n) in out) == (not inside)


def test_graph_fixpoint_against_sets(spark):
    edges = {(R.randrange(30), R.randrange(30)) for _ in range(60)}
    gen = {(n, n) for n in range(0, 30, 7)}
    kill = {(n, loc) for n in range(0, 30, 4) for loc in (7, 21)}
    e = spark.createDataFrame(sorted(edges), "src bigint, dst bigint")
    g, k = spark.createDataFrame(sorted(gen), "node bigint, loc bigint"), spark.createDataFrame(sorted(kill), "node bigint, loc bigint")
    state = set(gen)
    while True:
        new = {(d, loc) for n, loc in state for s, d in edges if s == n} - kill
        if new <= state:
            break
        state |= new
    assert {tuple(r) for r in graph.taint_fixpoint(e, g, k).collect()} == state


def test_crawl_cap_binds(spark):
    links = [("h", f"u{i:02d}", "h", f"u{j:02d}") for i in range(30) for j in (2 * i + 1, 2 * i + 2) if j < 60]
    df = spark.createDataFrame(links, "host string, url string, target_host string, target string")
    seeds = spark.createDataFrame([("h", "u00")], "host string, url string")
    got = sorted(tuple(r) for r in graph.crawl_frontier(df, seeds, max_depth=3, cap=9).collect())
    assert [g[1] for g in got] == [f"u{i:02d}" for i in range(9)]
    assert max(g[2] for g in graph.crawl_frontier(df, seeds, max_depth=2, cap=99).collect()) == 2


def simulate(body, depth=0):
    """Abstract run of a random program: set of tainted names per sink line, all paths joined."""
    hits = set()

    def run(block, state):
        for s in block:
            if s[0] == "set":
                _, line, t, kind, v = s
                state = state | {t} if kind == "src" or (kind == "copy" and v in state) else state - {t}
            elif s[0] == "sink":
                if s[2] in state:
                    hits.add((s[1], s[2]))
            elif s[0] == "if":
                state = run(s[2], state) | (run(s[3], state) if s[3] else state)
            else:
                while True:
                    after = state | run(s[2], state)
                    if after == state:
                        break
                    state = after
        return state

    run(body, frozenset())
    return hits


def random_program(rng):
    out = ["from flask import request", "def f():"]

    def block(indent, depth):
        stmts = []
        for _ in range(rng.randrange(1, 5)):
            pad, c = "    " * indent, rng.random()
            if c < 0.6 or depth == 0:
                t, v = rng.choice("abc"), rng.choice("abc")
                kind = rng.choice(["src", "copy", "copy", "clean"])
                out.append(f"{pad}{t} = " + {"src": 'request.args.get("q")', "copy": f"{v} + 1", "clean": "0"}[kind])
                stmts.append(("set", len(out), t, kind, v))
            elif c < 0.75:
                v = rng.choice("abc")
                out.append(f"{pad}os.system({v})")
                stmts.append(("sink", len(out), v))
            elif c < 0.9:
                out.append(f"{pad}if z:")
                line, then, other = len(out), block(indent + 1, depth - 1), []
                if rng.random() < 0.5:
                    out.append(f"{pad}else:")
                    other = block(indent + 1, depth - 1)
                stmts.append(("if", line, then, other))
            else:
                out.append(f"{pad}while z:")
                stmts.append(("loop", len(out), block(indent + 1, depth - 1)))
        for v in "abc":
            out.append(f"{'    ' * indent}os.system({v})")
            stmts.append(("sink", len(out), v))
        return stmts

    body = block(1, 3)
    return "\n".join(out) + "\n", body


def test_taint_against_an_abstract_run(spark):
    """Random nested programs: the fixpoint reports exactly the sinks that a run over all paths finds."""
    rng = random.Random(11)
    progs = [random_program(rng) for _ in range(60)]
    files = spark.createDataFrame([(f"p{i}.py", "python", text) for i, (text, _) in enumerate(progs)], "file string, language string, content string")
    got = {(r.file, r.sink_line, r.var) for r in taint.taint_fixpoint(taint.CodeFacts(files, rules_df(spark))).collect()}
    want = {(f"p{i}.py", line, v) for i, (_, body) in enumerate(progs) for line, v in simulate(body)}
    assert got == want


def test_sink_index_equals_scan(spark):
    text = ["db.execute(q)", "os.system(x)", "a.b.eval(x)", "requests.get(u)", "plain(x)", "subprocess.run(['a'])", "x.pickle.loads(b)"]
    calls = spark.createDataFrame([("f", i, 1, "python", t.split("(")[0], t) for i, t in enumerate(text)], "file string, line int, col int, language string, function_name string, full_text string")
    a = {tuple(r) for r in rules_match.sink_candidates(calls, rules_df(spark)).collect()}
    b = {tuple(r) for r in rules_match.sink_match_scan(calls, rules_df(spark)).collect()}
    assert a and a == b


def test_calls_and_arguments(spark):
    df = spark.createDataFrame([('x = a.b(c(1, 2), "p,(q", [3, 4], k=d({"z": 1}))',), ("if (x) { go() }",), ("f(",), ("",)], "t string")
    got = [[(c["name"], c["full_text"], c["args"]) for c in r.c] for r in df.select(calls_udf()("t").alias("c")).collect()]
    assert [(c[0], c[2]) for c in got[0]] == [("a.b", ["c(1, 2)", '"p,(q"', "[3, 4]", 'k=d({"z": 1})']), ("c", ["1", "2"]), ("d", ['{"z": 1}'])]
    assert [c[0] for c in got[1]] == ["go"]
    assert got[2] == [("f", "f(", [])] and got[3] == []


def test_calls_of_a_long_line_are_linear(spark):
    import time

    line = "f(" + ", ".join(f"g{k}(a{k}, h(b))" for k in range(100_000)) + ")"
    df = spark.createDataFrame([(line,)], "t string").select(F.explode(calls_udf()("t")).alias("c"))
    start = time.time()
    assert df.count() == 200_001 and len(line) > 2 * 1024 * 1024 - 200_000
    assert time.time() - start < 60


def test_outline(spark):
    text = "a = 1\n\ndef f(x):\n    if x:\n        y = [\n          1]\n    # note\n    return y\nb = 2\n"
    df = spark.createDataFrame([(text, False), ("int f(int x)\n{\n  if (x) {\n    g();\n  } else {\n    h();\n  }\n}\n", True)], "c string, b boolean")
    got = [[(s["line"], s["parent"], s["end_line"]) for s in r.s] for r in df.select(outline_udf({"python": r"def (\w+)"}, ("=>", "=>"), "<anonymous>", "<module>")("c", "b", F.lit("python")).alias("s")).collect()]
    assert got[0] == [(1, 0, 1), (3, 0, 8), (4, 3, 6), (5, 4, 6), (8, 3, 8), (9, 0, 9)]
    assert got[1] == [(1, 0, 8), (3, 1, 5), (4, 3, 4), (5, 1, 7), (6, 5, 6), (7, 1, 7), (8, 0, 8)]


def test_statements_over_lines_and_functions(spark):
    from wardlight.operators import extract

    files = spark.createDataFrame([
        ("a.py", "python", "a, *b = f(\n  1,\n  2)\nx = 1 + \\\n  2\n"),
        ("b.js", "javascript", "const go = async (req, res) => {\n  run(\n    req.a,\n    b\n  );\n};\napp.get('/', (q) => {\n  q.end();\n});\n"),
        ("c.cpp", "cpp", "int Depot::load(int n)\n{\n  return n;\n}\n"),
        ("d.java", "java", "class D {\n  void run(Request r) throws IOException {\n    return call(r);\n  }\n}\n")], "file string, language string, content string")
    s = extract.statements(files)
    text = {(r.file, r.line): r.text for r in s.collect()}
    assert text["a.py", 1] == "a, *b = f( 1, 2)" and text["a.py", 4] == "x = 1 + 2" and text["b.js", 2] == "run( req.a, b );"
    assert {(r.line, r.target) for r in extract.extract_assignments(s).filter("file = 'a.py'").collect()} == {(1, "a"), (1, "b"), (4, "x")}
    f = {(r.file, r.name): (r.params, r.start_line, r.end_line) for r in extract.extract_functions(s).collect()}
    assert f == {("b.js", "go"): (["req", "res"], 1, 6), ("b.js", "<anonymous>"): (["q"], 7, 9), ("c.cpp", "load"): (["n"], 1, 4), ("d.java", "run"): (["r"], 2, 4)}
    assert {r.func for r in s.filter("file = 'b.js' and line = 2").collect()} == {"go"}


def test_unreadable_bytes_and_limits(spark, tmp_path):
    from wardlight.sources.tree import source_tree_scan

    (tmp_path / "a.py").write_bytes(b"x = '\xe9t\xe9'\n")
    (tmp_path / "b.py").write_bytes(b"y" * 500)
    got = {r.file: r.content for r in source_tree_scan(spark, str(tmp_path)).collect()}
    assert got["a.py"] == "x = '\ufffdt\ufffd'\n" and len(got["b.py"]) == 500
    assert {r.file: r.content is None for r in source_tree_scan(spark, str(tmp_path), max_bytes=100).collect()} == {"a.py": False, "b.py": True}


def test_own_secret_patterns_see_every_line(spark):
    lines = spark.createDataFrame([("f", 1, "AKIA123")], "file string, line long, text string")
    assert secrets.detect_secret_patterns(lines, [("own", "AKIA[0-9]+")]).count() == 1


def test_entropy(spark):
    words = ["", "aaaa", "abcd", "k9AbCdEf0123456789XyZ", "ééà"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(cols.entropy_bits(F.col("w"))).collect()]
    want = [-sum((c / len(w)) * math.log2(c / len(w)) for c in (w.count(x) for x in set(w))) if w else 0.0 for w in words]
    assert got == pytest.approx(want)


def test_similarity_and_evidence(spark):
    far = " ".join(f"w{k}" for k in range(20_000))
    pair = spark.createDataFrame([(1, "u1", 200, "x " * 50, "u2", 200, "x " * 45 + "y " * 5), (2, "u1", 200, "x", "u2", 500, "x"), (3, "u", 200, far + " aaaa" * 3000, "u", 200, far + " bbbb" * 3000), (4, "u", 200, "", "u", 200, None)],
                                 "pair_id int, a_url string, a_status int, a_body string, b_url string, b_status int, b_body string")
    got = {r.pair_id: (r.similarity, r.significant) for r in web_audit.response_diff(pair).collect()}
    assert got[1] == (pytest.approx(0.9), True) and got[2] == (None, True)
    assert got[3] == (pytest.approx(20_000 / 23_000), True)  # the difference lies behind the first 100,000 characters
    assert "delta 0" in web_audit.diff_evidence(pair, "q").filter("pair_id = 2").first()["evidence"]
    # 99.845 in decimal is 99.8449… as a double, and printf goes by the double
    near = spark.createDataFrame([(1, "u", 200, "a " * 19969 + "b " * 31, "u", 200, "a " * 19969 + "c " * 31)], pair.schema)
    assert web_audit.diff_evidence(near, "q").first()["evidence"].endswith(f"similarity {0.99845 * 100:.2f}%")


def test_headers_any_case_and_repeats(spark):
    df = spark.createDataFrame([(1, "u", {"strict-TRANSPORT-security": "max-age=10", "X-Powered-By": "P", "Content-Security-Policy": "default-src *; unsafe-eval"}), (2, "u", {})],
                               "resp_id int, url string, headers map<string,string>")
    got = {}
    for r in web_audit.header_audit(df).collect():
        got.setdefault(r.resp_id, set()).add(r.check)
    assert {"hsts_max_age_short", "hsts_no_subdomains", "powered_by", "csp_unsafe_eval", "csp_permissive"} <= got[1]
    assert {"hsts_missing", "csp_missing", "frame_missing"} <= got[2] and "powered_by" not in got[2]


def test_resolve_url(spark):
    cases = [("http://h.x/a/b?q=1", "c", "http://h.x/a/c"), ("http://h.x/a/b", "/r", "http://h.x/r"), ("http://h.x", "c", "http://h.x/c"),
             ("http://h.x/a", "//o.y/z", "http://o.y/z"), ("http://h.x/a?b#c", "?d", "http://h.x/a?d"), ("http://h.x/a", "https://o.y/", "https://o.y/"), ("http://h.x/a/b", "./c", "http://h.x/a/c")]
    df = spark.createDataFrame(cases, "b string, h string, w string")
    for r in df.select("w", cols.resolve_url(F.col("b"), F.col("h")).alias("g")).collect():
        assert r.g == r.w


def test_endpoint_merge_keeps_first_default(spark):
    e = spark.createDataFrame([(2, "get", "http://h/a/?x=2", [("x", "query", "2"), ("y", "query", "1")]), (1, "GET", "http://h/a?x=1", [("x", "query", "1")])],
                              "seq bigint, method string, url string, params array<struct<name:string,location:string,default:string>>")
    r = pages.endpoint_merge(e).collect()
    assert len(r) == 1 and [(p["name"], p["default"]) for p in r[0]["params"]] == [("x", "1"), ("y", "1")]


def test_patch_order(spark):
    files = spark.createDataFrame([("f", "abc abc"), ("g", "x")], "file string, content string")
    p = spark.createDataFrame([("f", 2, "B", "Z"), ("f", 1, "b", "B"), ("f", 3, "", "q"), ("h", 1, "x", "y")], "file string, seq int, old string, new string")
    assert [(r.file, r.content) for r in triage.patch_apply(files, p).collect()] == [("f", "aZc aZc")]


def test_score_of_an_empty_scan(spark):
    scans = spark.createDataFrame([(1,), (2,)], "scan_id bigint")
    f = spark.createDataFrame([(1, "XSS", "Critical", None), (1, "none", "Odd", None)], "scan_id bigint, vuln_class string, severity string, cvss_score double")
    got = {r.scan_id: (r.score, r.grade, r.max_cvss) for r in scoring.scan_score(scans, f).collect()}
    assert got == {1: (85, "B", 6.1), 2: (100, "A", 0.0)}


def test_catalog_is_clean_and_covers_all_classes(spark):
    r = rules_df(spark)
    bad = rules_check.rule_lint(r, "strict").filter("rule_id not in ('js_eval') and detail not in ('sinks')").collect()
    assert bad == []
    assert r.select("vuln_class").distinct().count() == 36
    assert tree.register_rules(r, r.limit(3)).count() == r.count()


def test_history_and_cache_round_trip(spark, tmp_path):
    s = spark.createDataFrame([(i, "sast", f"2024-01-0{1 + i % 3} 00:00:00", i) for i in range(9)], "scan_id bigint, scan_type string, ts string, score int").withColumn("ts", F.to_timestamp("ts"))
    records.history_append(s, str(tmp_path / "h"))
    records.history_append(s, str(tmp_path / "h"))
    back = records.history_load(spark, str(tmp_path / "h"))
    assert back.count() == 18 and records.history_read(back, 1).first()["scan_id"] == 8
    c = spark.createDataFrame([(f"{i:04x}", "cur", i, "2024-01-01T00:00:00") for i in range(20)], "k string, rule_hash string, access_count int, stored_at string")
    p = cache.scan_cache_save(c, str(tmp_path / "c"), 5)
    assert {r.access_count for r in cache.load_version(spark, p).collect()} == set(range(15, 20))


def test_finding_json_round_trip(spark):
    f = spark.createDataFrame([("1", "r", "XSS", "f.py", 3, "High", 6.1, [(1, 3, "f.py", "d")])],
                              "id string, rule_id string, vuln_class string, file string, line bigint, severity string, cvss_score double, taint_trace array<struct<step:int,line:bigint,file:string,description:string>>")
    back = records.findings_json_import(records.findings_json_export(f)).first()
    assert (back["cvss_score"], back["severity"], back["confidence"], back["taint_trace"][0]["description"]) == (6.1, "High", "High", "d")
    empty = records.findings_json_import(spark.createDataFrame([("{}",)], "json string")).first()
    assert (empty["severity"], empty["taint_trace"]) == ("Medium", [])


def test_tree_and_manifest(spark, tmp_path):
    for name, text in {"a.py": "x", "node_modules/b.py": "x", "s/.git/c.py": "x", "s/d.js": "y" * 30, "note.txt": "n", "package.json": '{"dependencies": {"express": "3.1"}, "devDependencies": {"express": "4.0"}}'}.items():
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    got = tree.source_tree_scan(spark, str(tmp_path), max_bytes=200)
    assert {r.file for r in got.collect()} == {"a.py", "s/d.js", "package.json"}
    assert [tuple(r) for r in records.manifest_read(got.filter("file = 'package.json'")).collect()] == [("package.json", "express", "4.0")]
    assert tree.source_tree_scan(spark, str(tmp_path), max_bytes=10).filter("content is not null").count() == 1


def test_tree_is_listed_in_tasks(spark, tmp_path):
    """The driver holds no file of the tree; names with a dot or an underscore, links, odd names and folders without files are gone through."""
    names = ["a b.py", "_in/__init__.py", ".env", "1/2/3/f.go", "p%20q/\u00e9.py", "s/.git/c.py", "s/build/c.py", "note.txt", "odd:1.py"]
    for name in names:
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    (tmp_path / "void").mkdir()
    (tmp_path / "1" / "up").symlink_to(tmp_path)
    (tmp_path / "to").symlink_to(tmp_path / "1" / "2")
    (tmp_path / "dead.py").symlink_to(tmp_path / "none")
    for at in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        got = tree.source_tree_scan(spark, at)
        assert not [f for f in got.inputFiles() if not f.endswith(".parquet")]
        assert sorted(r.file for r in got.collect()) == sorted(names[:5] + names[-1:] + ["to/3/f.go"])
    assert {(r.size, r.content) for r in got.collect()} == {(1, "x")}
    assert tree.source_tree_scan(spark, str(tmp_path / "void")).isEmpty()
    assert [r.content for r in tree.source_tree_scan(spark, str(tmp_path / "a b.py")).collect()] == ["x"]


def test_masked_evidence_and_redos(spark):
    from wardlight.operators import secrets

    df = spark.createDataFrame([("f", 1, '"(a+)+"'), ("f", 2, "'(x|x)*'"), ("f", 3, '"[a-z]+$"'), ("f", 4, "/(b*)*/g"), ("f", 5, '"' + "(a+)+" * 120 + '"')], "file string, line bigint, literal string")
    assert {r.line for r in secrets.detect_redos(df).collect()} == {1, 2, 4, 5}
    got = spark.range(1).select(findings.secret_evidence(F.lit("k"), F.lit("abcdefgh"))).first()[0]
    assert got == 'k = "abcd****"'


def test_snippet(spark):
    files = spark.createDataFrame([("f", "a\r\nb\nc\nd")], "file string, content string")
    hit = spark.createDataFrame([("f", 1), ("f", 3)], "file string, line bigint")
    got = {r.line: r.evidence for r in lines.evidence_snippet(hit, files).collect()}
    assert got == {1: "→ 1: a\n  2: b", 3: "  2: b\n→ 3: c\n  4: d"}


def test_location(spark):
    df = spark.createDataFrame([('d["k"]',), ("a.b.c",), ("x",)], "t string")
    got = [tuple(r) for r in df.select(*extract.taint_location(F.col("t")).values()).collect()]
    assert got == [("index", "d", "k"), ("field", "a", "b.c"), ("var", "x", "")]


STRUCTURES = {
    "javascript": ('''const a = (req) => { // it's
  db.query({
    sql: "x {" + code, /* ( */
    values: [1, {b: 2}]
  }, (err, rows) => {
    send(`<b>${rows.map(r => `(${r["a}"]})`).join("")}</b>
      more ( text`);
  });
  if (/["'({]/.test(code)) { go(); }
  return {
    a: f(code)
  };
};
''', [(1, 0, 13), (2, 1, 8), (6, 2, 7), (8, 1, 8), (9, 1, 9), (10, 1, 12), (13, 0, 13)]),
    "python": ('''def f(x):
    """doc ( with
    # brackets and 'quotes
    """
    q = \'\'\'a (
      b = \'\'\' + x
    y = {"a": [1,
      2], "b#": f(x)}  # c (
    return y
z = 1
''', [(1, 0, 9), (2, 1, 4), (5, 1, 6), (7, 1, 8), (9, 1, 9), (10, 0, 10)]),
    "go": ("func main() {\n\tx := Point{\n\t\tA: 1,\n\t}\n\tgo func() {\n\t\trun(Point{A: x})\n\t}()\n}\n", [(1, 0, 8), (2, 1, 4), (5, 1, 7), (6, 2, 6), (7, 1, 7), (8, 0, 8)]),
}


@pytest.mark.parametrize("language", list(STRUCTURES))
def test_statements_follow_the_structure(spark, language):
    from wardlight.operators import extract

    text, want = STRUCTURES[language]
    rows = extract.statements(spark.createDataFrame([("f", language, text)], "file string, language string, content string")).orderBy("line").collect()
    assert [(r.line, r.depth, r.end_line) for r in rows] == want


def test_calls_keep_objects_and_templates(spark):
    from wardlight.operators import extract

    text, _ = STRUCTURES["javascript"]
    stmts = extract.statements(spark.createDataFrame([("f", "javascript", text)], "file string, language string, content string"))
    got = {(r.line, r.function_name): r.args for r in extract.extract_calls(stmts).collect()}
    assert got[2, "db.query"] == ["{ sql: \"x {\" + code, values: [1, {b: 2}] }", "(err, rows) => {"]
    assert got[6, "rows.map"] == ["r => `(${r[\"a}\"]})`"] and got[10, "f"] == ["code"] and got[9, "go"] == []


def test_a_line_of_two_megabytes(spark):
    import time

    from wardlight.operators import extract

    text = "x = f(" + ",".join(f'g("a{k}", h({k}))' for k in range(95_000)) + ")"
    assert len(text) > 2_000_000
    files = spark.createDataFrame([("f", "python", text)], "file string, language string, content string")
    start = time.time()
    assert extract.extract_calls(extract.statements(files)).count() == 190_001
    assert time.time() - start < 60  # some five seconds on an idle core, start of workers included


def test_incremental_scan_reads_changed_files_only(spark, tmp_path):
    folder = str(tmp_path / "results")
    schema = "file string, content string"
    scanned = []

    def scan(files):
        scanned.append(sorted(r.file for r in files.collect()))
        return files.select("file", F.explode(F.split("content", "\n")).alias("text")).filter("text like '%bad%'")

    def run(rows, digest="r1", as_of="2024-01-31 00:00:00"):
        found, read = cache.incremental_scan(spark.createDataFrame(rows, schema), scan, digest, folder, as_of, 30)
        assert sorted(r.file for r in read.collect()) == scanned[-1]
        return sorted((r.file, r.text, r.cached) for r in found.collect())

    one = [("a", "bad 1\nok\nbad 2"), ("b", "fine"), ("c", "bad 3")]
    assert run(one) == [("a", "bad 1", False), ("a", "bad 2", False), ("c", "bad 3", False)] and scanned[-1] == ["a", "b", "c"]
    two = [("a", "bad 1\nok\nbad 2"), ("b", "bad now"), ("c", "bad 3"), ("d", "bad 3")]
    assert run(two) == [("a", "bad 1", True), ("a", "bad 2", True), ("b", "bad now", False), ("c", "bad 3", True), ("d", "bad 3", False)] and scanned[-1] == ["b", "d"]
    assert all(x[2] for x in run(two)) and scanned[-1] == []
    assert not any(x[2] for x in run(two, digest="r2")) and len(scanned[-1]) == 4  # other rules
    assert not any(x[2] for x in run(two, as_of="2024-03-15 00:00:00")) and len(scanned[-1]) == 4  # too old
    assert all(x[2] for x in run(two, as_of="2024-03-16 00:00:00"))  # the newest entry counts
    assert run([]) == []


def test_static_scan_from_stored_results(spark, tmp_path):
    from wardlight.operators.rules_check import rule_set_hash
    from wardlight.plans.static_scan import static_scan

    rules = rules_df(spark)
    digest = rule_set_hash(rules).first().digest
    files = [("a.py", "import os\nfrom flask import request\n\ndef a():\n    x = request.args.get('q')\n    os.system(x)\n"), ("b.py", "def b():\n    return 1\n")]
    frame = lambda rows: spark.createDataFrame(rows, "file string, content string")
    scan = lambda f: static_scan(f, rules)
    first, _ = cache.incremental_scan(frame(files), scan, digest, str(tmp_path / "r"), "2024-01-31 00:00:00")
    again, read = cache.incremental_scan(frame(files[:1] + [("b.py", "API = 1\n")]), scan, digest, str(tmp_path / "r"), "2024-02-01 00:00:00")
    assert [r.file for r in read.collect()] == ["b.py"]
    plain = lambda df: sorted(str(r) for r in df.filter("file = 'a.py'").drop("cached").collect())
    assert plain(first) == plain(again) and again.filter("cached").count() == first.count() > 0


def test_links_take_their_dots(spark):
    from urllib.parse import urljoin

    bases = ["http://h.example/a/b/c.html", "https://h.example/a/b/", "http://h.example/x?y=../z"]
    hrefs = ["../d", "./d", "../../../d", "d/../e/./f", "..", ".", "../", "d/..", "/p/../q?r=../s", "/../q", "../d?e=/../f#g", "d..e/f.", "...", "../a.b/..c", "/", "d#../x"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    got = rows.select("base", "href", cols.resolve_url(F.col("base"), F.col("href")).alias("u")).collect()
    assert {(r.base, r.href): r.u for r in got} == {(b, h): urljoin(b, h) for b in bases for h in hrefs}


def test_tainted_members_in_texts(spark):
    texts = spark.createDataFrame([(k, "f", t) for k, t in enumerate(['run(d["a"])', "run(d['b'])", "run(d)", "run(d.a)", "run(d[k])", "run(d.get('b'))", "run(e.a, c)", "run(dd['a'])"])], "n int, file string, text string")
    tainted = spark.createDataFrame([("f", "d", "a"), ("f", "c", "")], "file string, base string, member string")
    got = sorted((r.n, r.base, r.member) for r in taint.tainted_in_text(texts, tainted).collect())
    assert got == [(0, "d", "a"), (2, "d", "a"), (3, "d", "a"), (4, "d", "a"), (5, "d", "a"), (6, "c", "")]


def test_names_outside_of_strings(spark):
    from wardlight.operators.flows import names_used, outside_strings

    rows = [
        ("python", """d["a"] + x + d["b"] + "y" """, {"d", "d[a]", "d[b]", "d[?]", "x", "x[*]"}),
        ("python", """f"{u}" + v + 'w' + rf'{z}'""", {"f", "f[*]", "rf", "rf[*]", "u", "u[*]", "v", "v[*]", "z", "z[*]"}),
        ("python", """["p", q] + [r]""", {"q", "q[*]", "r", "r[*]"}),
        ("javascript", """`${a}` + "b" + c.d""", {"$", "$[*]", "a", "a[*]", "c", "c[d]", "c[?]"}),
        ("php", """"x $y" . 'z' . $r['k']""", {"x", "x[*]", "$y", "$y[*]", "$r", "$r[k]", "$r[?]"}),
    ]
    df = spark.createDataFrame([(n, lang, t) for n, (lang, t, _) in enumerate(rows)], "n int, language string, text string")
    got = {r.n: set(r.u) for r in df.select("n", names_used(outside_strings(F.col("text")), F.array().cast("array<string>")).alias("u")).collect()}
    assert got == {n: want for n, (_, _, want) in enumerate(rows)}


def test_patterns_by_automaton_and_by_grams(spark, monkeypatch):
    """Random patterns, nested, overlapping, short and empty ones, against brute force on both ways."""
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcé.(") for _ in range(n))
    rules = [(lang, f"r{i}", [word(rnd.randint(1, 9)).upper() for _ in range(3)] + ([None] if i % 7 == 0 else [])) for i in range(60) for lang in ("python", "go")]
    rules += [("php", "empty", [""]), ("ruby", "none", None), (None, "lost", ["a"])]
    texts = [(i, rnd.choice(["python", "go", "php", "ruby", "other", None]), rnd.choice([None, "", word(40), word(400), word(3)])) for i in range(300)]
    want = sorted({(i, r, p.lower()) for i, lang, t in texts for rl, r, ps in rules for p in ps or () if p is not None and t is not None and rl == lang and rl and p.lower() in t.lower()})
    df = spark.createDataFrame(texts, "id int, language string, text string")
    made = spark.createDataFrame(rules, "language string, rule_id string, sinks array<string>")
    for limit in (patterns.AUTOMATON_BYTES, 0):
        monkeypatch.setattr(patterns, "AUTOMATON_BYTES", limit)
        found = patterns.PatternSet(made, "sinks")
        assert found.fits == (limit > 0)
        assert sorted((r.id, r.rule_id, r.pattern) for r in found.matches(df, F.col("text")).collect()) == want
    none = patterns.PatternSet(made.limit(0), "sinks")
    assert none.matches(df, F.col("text")).count() == 0


def test_rules_are_no_part_of_the_plan(spark):
    """10,000 rules: the plan of the search names none of them and has no join with the texts before the hits."""
    rules = spark.range(10_000).selectExpr("'python' as language", "concat('r', id) as rule_id", "array(concat('lib', id, '.run(')) as sinks")
    calls = spark.range(1_000).selectExpr("'f' as file", "cast(id as int) as line", "1 as col", "'python' as language", "concat('lib', id * 20, '.run') as function_name", "concat('lib', id * 20, '.run(x)') as full_text")
    found = rules_match.sink_candidates(calls, rules)
    assert "lib" + "77.run" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.rule_id for r in found.collect()) == sorted(f"r{i * 20}" for i in range(500))


def test_values_of_one_run_live_at_a_time():
    import weakref

    import pyarrow as pa

    live, most = weakref.WeakSet(), 0

    class Row(list):
        __hash__ = object.__hash__

    def each(n):
        nonlocal most
        row = Row([n] * 3)
        live.add(row)
        most = max(most, len(live))
        return [row, [str(n)] * 3]

    got = in_runs(4)(each, [("n", pa.int64()), ("t", pa.string())], pa.array(list(range(50))))
    assert got.to_pylist() == [[{"n": n, "t": str(n)}] * 3 for n in range(50)] and most <= 4
    assert in_runs(4)(each, [("n", pa.int64()), ("t", pa.string())], pa.array([], pa.int64())).to_pylist() == []


def python_steps(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_arguments_are_taken_apart_once(spark):
    df = spark.createDataFrame([("f(a, g(b))",), ("no call",), (None,)], "text string")
    got = extract.split_args(df)
    assert [r.args for r in got.collect()] == [["a", "g(b)"], None, None]
    assert python_steps(got.filter(F.size("args") > 0)) == 1


def test_calls_are_read_once(spark):
    files = spark.createDataFrame([("a", "python", "def f():\n    g(h(1))\n    g(2)\ndef g(x):\n    g(x)\nf()\n")], "file string, language string, content string")
    s = extract.statements(files)
    f = extract.extract_functions(s)
    flat = f.localCheckpoint()
    edges = taint.call_edges(extract.extract_calls(s, keep=("func",)), flat)
    got = taint.callers_callees(edges, flat)
    assert python_steps(got) == python_steps(edges)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "f", 1, "<module>", "g", False), ("a", "g", 3, "f,g", "g", False)]


def test_rules_are_looked_up_without_a_shuffle(spark):
    calls = spark.createDataFrame([("python", "x = request.args.get(1)")], "language string, t string")
    plan = PatternSet(rules_df(spark), "sources").matches(calls, F.col("t"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rules_in_files_of_many_documents(spark, tmp_path):
    one = "rule_id: {}\nlanguage: python\nseverity: {}\nsinks:\n- run(\n"
    (tmp_path / "a.yaml").write_text("---\n".join([one.format("r1", "Low"), one.format("r2", "Low"), "rule_id: [broken\n", one.format("r1", "High"), "- no rule\n"]))
    (tmp_path / "b.yml").write_text(one.format("r2", "Medium"))
    got = {r.rule_id: (r.severity, r.sinks) for r in tree.rule_catalog_load(spark, str(tmp_path)).collect()}
    assert got == {"r1": ("High", ["run("]), "r2": ("Medium", ["run("])}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_neighbours_and_tokens_take_one_shuffle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3)], "src int, dst int")
    near = graph.graph_neighbors(dealt(edges, "src", "dst"))
    index = rules_match.rule_index_build(spark.createDataFrame([("go", "a", ["x.run(", "x.go"]), ("go", "a", ["x.run("]), ("go", "b", [])], "language string, rule_id string, sinks array<string>"))
    assert exchanges(near) == 1 and exchanges(index) == 1
    assert sorted(tuple(r) for r in near.collect()) == sorted({(a, w, b) for x, y in {(1, 2), (2, 1), (3, 3)} for a, w, b in ((x, "successor", y), (y, "predecessor", x))})
    assert sorted(r.token for r in index.collect()) == ["go", "run", "run(", "x.go", "x.run("]


def test_export_is_parsed_once(spark):
    from wardlight.registry import QUERIES
    from wardlight.views import Tables

    plan = QUERIES["findings_json_export"](Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1 and "get_json_object" not in plan
