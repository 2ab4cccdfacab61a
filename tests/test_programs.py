"""Whole scans of small programs about a parcel depot, one behaviour each: expected classes, none for clean ones."""

import pytest

from wardlight.catalog.rules import rules_df
from wardlight.plans.static_scan import static_scan

FLASK = "from flask import request\n"

PROGRAMS = {
    # a wrapped statement: the call starts on one line, the tainted part stands on the next
    "depot/wrapped_call.py": (FLASK + '''

class Depot:
    def parcels_of(self):
        shelf = request.args.get("shelf")
        rows = self.db.execute(
            "select code from parcel "
            + "where shelf = '" + shelf + "'"
        )
        return rows
''', {"SQLi"}),
    "depot/backslash.py": (FLASK + '''

def weigh():
    scale = request.args.get("scale")
    line = "weigh --scale " + \\
        scale
    os.system(line)
''', {"CMDi"}),
    # the value comes out of a helper, directly and through a second one
    "depot/helper_returns.py": (FLASK + '''

def wanted_code():
    raw = request.args.get("code")
    return raw


def shown_code():
    return wanted_code()


def label():
    code = shown_code()
    db.execute("select * from label where code = '" + code + "'")
''', {"SQLi"}),
    # the helper hands out a constant, the source stays inside it
    "depot/helper_keeps.py": (FLASK + '''

def count_hits():
    raw = request.args.get("code")
    return 1


def report():
    hits = count_hits()
    db.execute("select * from report limit " + hits)
''', set()),
    # a tainted local name goes down through two helpers
    "depot/hand_down.py": (FLASK + '''

def dispatch(order):
    line = "van " + order
    os.system(line)


def plan(stop):
    dispatch("to " + stop)


def tour():
    town = request.args.get("town")
    plan(town)
''', {"CMDi"}),
    # what comes back depends on the argument, also through a helper of the helper and a recursive one
    "depot/hand_back.py": (FLASK + '''

def quoted(part):
    return "'" + part + "'"


def listed(part, depth):
    if depth:
        return listed(part, depth - 1)
    inner = quoted(part)
    return inner


def stock():
    shelf = request.args.get("shelf")
    db.execute("select * from stock where shelf = " + listed(shelf, 3))
''', {"SQLi"}),
    # a helper that ignores its argument, and one that cleans it
    "depot/hand_nothing.py": (FLASK + '''

def lane_of(parcel):
    return "north"


def size_of(parcel):
    return int(parcel)


def both():
    parcel = request.args.get("parcel")
    lane = lane_of(parcel)
    os.system("open " + lane)
    db.execute("select * from size where s = " + size_of(parcel))
''', set()),
    # the same helper gets something tainted in one place and a constant in another
    "depot/two_calls.py": (FLASK + '''

def marked(text):
    return "*" + text


def one():
    note = marked(request.args.get("note"))
    return note


def two():
    os.system(marked("fixed"))
''', set()),
    # the source is written into the sink, plain and cleaned
    "depot/straight.py": (FLASK + "\n\ndef go():\n    os.system(request.args.get(\"gate\"))\n", {"CMDi"}),
    "depot/straight_clean.py": (FLASK + "\n\ndef go():\n    db.execute(\"select \" + str(int(request.args.get(\"gate\"))))\n", set()),
    # members of one container are told apart, whole values and computed members are not
    "depot/other_member.py": (FLASK + '''

def label():
    parcel = {}
    parcel["note"] = request.args.get("note")
    parcel["code"] = "fixed"
    os.system("print " + parcel["code"])
    parcel["note"] = "blank"
    os.system("print " + parcel["note"])
''', set()),
    "depot/same_member.py": (FLASK + '''

def label():
    parcel = {}
    parcel["note"] = request.args.get("note")
    parcel["code"] = "fixed"
    os.system("print " + parcel["note"])
''', {"CMDi"}),
    "depot/whole_value.py": (FLASK + '''

def label():
    parcel = {}
    parcel["note"] = request.args.get("note")
    os.system("print " + str.join(parcel))
''', {"CMDi"}),
    "depot/computed_member.py": (FLASK + '''

def label(k):
    parcel = {}
    parcel[k] = request.args.get("note")
    os.system("print " + parcel["code"])
''', {"CMDi"}),
    "depot/new_value.py": (FLASK + '''

def label(k):
    parcel = {}
    parcel["note"] = request.args.get("note")
    parcel = {"note": "blank"}
    os.system("print " + parcel["note"])
''', set()),
    "depot/pair.py": (FLASK + '''

def route():
    van, driver = request.args.get("route").split("-")
    os.system("dispatch " + driver)
''', {"CMDi"}),
    "depot/loop_carries.py": (FLASK + '''

def stamps():
    mark = ""
    for part in request.args.getlist("part"):
        mark = request.args.get("mark")
        for side in "ab":
            if side:
                last = mark
    os.system("stamp " + last)
''', {"CMDi"}),
    "depot/replaced.py": (FLASK + '''

def gate():
    lane = request.args.get("lane")
    lane = "north"
    os.system("open " + lane)
''', set()),
    "depot/number_only.py": (FLASK + '''

def pallet():
    number = int(request.args.get("pallet", "0"))
    height = int(number)
    db.execute("select * from pallet where id = ?", (height,))
''', set()),
    "depot/bytes_in.py": (FLASK + "import pickle\n\n\ndef restore():\n    crate = request.data\n    return pickle.loads(crate)\n", {"Deserialization"}),
    "depot/door_code.py": ('DOOR_PASSWORD = "kt93-vv81-qq07"\nOPEN_HOURS = "8-18"\n', {"Hardcoded Secret"}),
    "depot/digest.py": ("import hashlib\n\n\ndef seal(manifest):\n    return hashlib.sha1(manifest).hexdigest()\n", {"Weak Crypto"}),
    "depot/digest_good.py": ("import hashlib\n\n\ndef seal(manifest):\n    return hashlib.sha512(manifest).hexdigest()\n", set()),
    "depot/arithmetic.py": ("def volume(w, h, d):\n    return w * h * d\n\n\nUNIT = \"litre\"\n", set()),
    # arrow function with a wrapped call
    "web/track.js": ('''const express = require("express");
const track = (req, res) => {
  const code = req.query.code;
  db.query(
    "select * from parcel where code = '" + code + "'"
  );
};
''', {"SQLi"}),
    # an object literal inside the call, over several lines
    "web/shelf.js": ('''const express = require("express");
const shelf = (req, res) => {
  const code = req.query.code;
  db.query({
    sql: "select * from parcel where code = '" + code + "'",
    timeout: 40
  });
};
''', {"SQLi"}),
    # a text over several lines, with brackets and a comment sign in it
    "depot/long_text.py": (FLASK + '''

def parcels():
    """All parcels (of a shelf. # not a comment"""
    shelf = request.args.get("shelf")
    sql = """
        select code from parcel  -- (open
        where shelf = ''' + "\'" + '''""" + shelf
    db.execute(sql)
''', {"SQLi"}),
    "tools/Lift.java": ('''class Lift {
    ResultSet levels(HttpServletRequest request) {
        String level = request.getParameter("level");
        return statement.executeQuery(
            "select * from lift where level = " + level);
    }
}
''', {"SQLi"}),
    # configuration is routed by name, whether or not it holds a quote or a keyword
    "deploy/docker-compose.yml": ("services:\n  sorter:\n    image: sorter\n    privileged: true\n", {"Misconfiguration"}),
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(n, c) for n, (c, _) in PROGRAMS.items()], "file string, content string")
    out = {}
    for r in static_scan(files, rules_df(spark)).collect():
        out.setdefault(r["file"], []).append(r)
    return out


@pytest.mark.parametrize("name", list(PROGRAMS))
def test_classes(found, name):
    assert {r["vuln_class"] for r in found.get(name, [])} == PROGRAMS[name][1]


def test_records_are_whole(found):
    for rows in found.values():
        for r in rows:
            assert r["id"] and r["severity"] and r["confidence"] and r["issue"] and r["tool"] and r["evidence"]
            assert r["cvss_score"] or r["vuln_class"] == "Misconfiguration"
            assert len(r["taint_trace"]) == r["trace_len"] and r["taint_trace"][-1]["line"] == r["line"]


STEPS = {
    "depot/wrapped_call.py": [(6, "enters as shelf"), (7, "used here")],
    "depot/helper_returns.py": [(5, "enters as raw"), (10, "comes back from wanted_code"), (14, "comes back from shown_code"), (14, "moves on as code"), (15, "used here")],
    "depot/loop_carries.py": [(7, "enters as mark"), (10, "moves on as last"), (11, "used here")],
    "depot/hand_down.py": [(14, "enters as town"), (15, "handed to plan as stop"), (10, "handed to dispatch as order"), (5, "moves on as line"), (6, "used here")],
    "depot/hand_back.py": [(16, "enters as shelf"), (17, "passes through listed"), (17, "used here")],
    "depot/straight.py": [(5, "enters and is used here")],
}


@pytest.mark.parametrize("name", list(STEPS))
def test_every_step_is_told(found, name):
    (r,) = [x for x in found[name] if x["vuln_class"] in ("SQLi", "CMDi")]
    assert [(s["line"], s["description"].split(":")[0]) for s in r["taint_trace"]] == STEPS[name]
    assert [s["step"] for s in r["taint_trace"]] == list(range(1, len(STEPS[name]) + 1)) and r["cwe"] and r["remediation"]


def test_secret_is_masked(found):
    assert all("vv81" not in r["evidence"] for r in found["depot/door_code.py"])
