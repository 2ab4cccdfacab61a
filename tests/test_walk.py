"""Taint inside one file: the walk in a task against the rounds by joins, and that its jobs do not grow with the paths."""

import random
import re

import pytest

from tests.test_operators import random_program
from tests.test_programs import PROGRAMS
from wardlight.catalog.fixed import LANGUAGE_BY_EXT
from wardlight.catalog.programs import PROGRAMS as CATALOG
from wardlight.catalog.rules import rules_df
from wardlight.operators import flows, iterate, taint
from wardlight.session import checkpointed

HEAD = "from flask import request\n"
HELPERS = """
def same(x):
    return x

def twice(x, y=1):
    z = same(x)
    return same(z)

def ring(x, n):
    if n:
        return ring(same(x), n)
    return x

def none(x):
    os.system(x)
    return 1

def given():
    return request.args.get("g")

@app.route("/p")
def page(who):
    os.system(who)

"""


def called_program(rng):
    """A function whose statements pass three names through helpers, members and sinks at random."""
    lines = ["def job():"]
    for _ in range(rng.randrange(4, 14)):
        t, v, w = rng.choice("abc"), rng.choice("abc"), rng.choice(["a", "b", "c", "d['k']"])
        lines.append("    " + rng.choice([
            f"{t} = same({v})", f"{t} = twice({v}, {w})", f"{t} = ring(twice({v}), {w})", f"{t} = none({v})", f"{t} = given()", f"d['k'] = {v}", f"d['m'] = same({w})",
            f'{t} = request.args.get("q")', f"{t} = 0", f"os.system({w})", f"none({w})", f"{t} = {w} + {v}", "d = {}", f"os.system(same({v}))", f"{t} = twice(y={v}, x={w})"]))
    return HEAD + HELPERS + "\n".join(lines + ["    os.system(a)", "    os.system(d)"]) + "\n"


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(5)
    texts = [t for t, _ in PROGRAMS.values()] + [random_program(rng)[0] for _ in range(5)] + [called_program(rng) for _ in range(40)]
    files = spark.createDataFrame([(f"p{i}.py", "python", t) for i, t in enumerate(texts)], "file string, language string, content string")
    return taint.CodeFacts(files, rules_df(spark))


@pytest.mark.parametrize("operator", [flows.taint_paths, flows.interprocedural_taint])
def test_walk_equals_rounds(facts, operator, monkeypatch):
    program = flows.Program(facts)
    found = {}
    for chars in (400, 1024 * 1024):
        monkeypatch.setattr(flows, "FILE_CHARS", chars)
        found[chars] = sorted(str(r) for r in operator(facts, program).collect())
    assert len(found[400]) > 4 and found[400] == found[1024 * 1024]


def test_jobs_do_not_grow_with_the_path(spark):
    def jobs(n):
        body = "".join(f"    v{i + 1} = same(v{i})\n" for i in range(n))
        files = spark.createDataFrame([("a.py", "python", f'{HEAD}{HELPERS}def job():\n    v0 = request.args.get("q")\n{body}    os.system(v{n})\n')], "file string, language string, content string")
        spark.sparkContext.setJobGroup(f"path of {n}", "")
        found = [r.depth for r in flows.taint_paths(taint.CodeFacts(files, rules_df(spark))).collect() if r.var == f"v{n}"]
        assert found == [2 * n + 2]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"path of {n}"))

    assert jobs(40) < jobs(2) + 10


ODD = [
    ("unpacked.py", "python", HEAD + 'def job():\n    a, *b, c.d = request.args.get("q"), 1\n    d = e = a\n    x["k"] += a\n    os.system(a, b)\n    os.system(x)\n    os.system(int(a) + d)\n    db.execute("select ?", (a,))\n'),
    ("nested.py", "python", HEAD + '@app.route("/x")\n@login\n\ndef outer(who, self, n=1):\n    def inner(deep):\n        os.system(deep)\n        os.system(who)\n    if n:\n        line = who\n    else:\n        who = "none"\n    os.system(line); os.system(who)\n'),
    ("far.py", "python", '@app.get("/x")\n#\n#\n#\n#\ndef far(who):\n    os.system(who)\n'),
    ("lines.py", "python", HEAD + 'a = request.args.get("q")\r\nos.system(\r\n  "x" +\r\n  a)\r\n'),
    ("arrow.js", "javascript", 'const f = (req, res) => {\n  let a = req.query.id;\n  for (;;) {\n    db.query(b, done);\n    b = a;\n  }\n};\n'),
    ("empty.py", "python", ""), ("null.py", "python", None), (None, "python", HEAD + 'a = request.args.get("q")\nos.system(a)\n'), ("other.zz", "none", "a = b\n"),
]


def test_fixpoint_in_files_equals_rounds(spark, facts, monkeypatch):
    named = [(n, LANGUAGE_BY_EXT.get("." + n.rsplit(".", 1)[-1], "none"), t) for n, t in CATALOG]
    mixed = taint.CodeFacts(facts.files.unionByName(spark.createDataFrame(named + ODD, "file string, language string, content string")), facts.rules)
    want = sorted(str(r) for r in taint.by_rounds(mixed, taint.DefUse(mixed)).collect())
    assert len(want) > 60 and len({r.split("'")[1].rsplit(".", 1)[-1] for r in want}) > 6
    for chars in (400, 64 * 1024):
        monkeypatch.setattr(taint, "FILE_CHARS", chars)
        assert sorted(str(r) for r in taint.taint_fixpoint(mixed).collect()) == want


def test_jobs_of_the_fixpoint_do_not_grow_with_the_blocks(spark):
    def jobs(n):
        body = "".join(f"    if z:\n        v{i + 1} = v{i}\n" for i in range(n))
        files = spark.createDataFrame([("a.py", "python", f'{HEAD}def job():\n    v0 = request.args.get("q")\n{body}    os.system(v{n})\n')], "file string, language string, content string")
        spark.sparkContext.setJobGroup(f"blocks {n}", "")
        found = [(r.var, r.sink_line, r.origin_line) for r in taint.taint_fixpoint(taint.CodeFacts(files, rules_df(spark))).collect()]
        assert found == [(f"v{n}", 2 * n + 4, 2 * n + 3)]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"blocks {n}"))

    assert jobs(12) < jobs(2) + 5


@pytest.mark.parametrize("chars, key, operators", [
    (1024 * 1024, r"file#", [flows.taint_paths, flows.interprocedural_taint, taint.alias_propagation]),
    (400, r"file#\d+, ", [flows.taint_paths, lambda f: taint.by_rounds(f, taint.DefUse(f))])])
def test_facts_are_not_broadcast(facts, monkeypatch, chars, key, operators):
    """Rows of code facts grow with the input, which Spark's figure of their size doesn't tell; all are small here. The names of
    large files, one a MiB at most, may be broadcast."""
    plans = []
    told = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (flows, taint, iterate):
        monkeypatch.setattr(module, "checkpointed", lambda df, **by: told(df) or checkpointed(df, **by))
    monkeypatch.setattr(flows, "FILE_CHARS", chars)
    few = taint.CodeFacts(facts.files.filter("file in ('p0.py', 'p50.py')"), facts.rules, facts.patterns)
    for operator in operators:
        told(operator(few))
    assert len(plans) > 12 and not re.findall(rf"BroadcastHashJoin \[{key}.*", "\n".join(plans))
