"""Small programs used to derive a corpus of code files from the ``customer`` table.

``@K@`` is replaced by the customer key, so names, routes and values differ from file to file.
Each entry is ``(file name, text)``; its position is the program number.
"""

PROGRAMS: list[tuple[str, str]] = [
    # 0: direct flow
    ("app.py", '''from flask import Flask, request
app = Flask(__name__)

@app.route("/user@K@")
def get_user_@K@():
    name = request.args.get("name")
    query = "SELECT id FROM users WHERE name='" + name + "'"
    row = db.execute(query)
    return row
'''),
    # 1: sanitized flow
    ("safe.py", '''from flask import request

def get_item():
    uid = request.args.get("id")
    safe = int(uid)
    query = "SELECT id FROM items@K@ WHERE id=" + str(safe)
    return db.execute(query)
'''),
    # 2: parameterised call
    ("param.py", '''from flask import request

def find():
    uid = request.args.get("id")
    row = db.execute("SELECT id FROM t@K@ WHERE id=?", (uid,))
    return row
'''),
    # 3: container field
    ("field.py", '''from flask import request

def search():
    params = {}
    params["name"] = request.args.get("name")
    sql = "SELECT id FROM t@K@ WHERE n='" + params["name"] + "'"
    db.execute(sql)
'''),
    # 4: return value
    ("ret.py", '''from flask import request

def read_name():
    return request.args.get("name")

def lookup():
    who = read_name()
    sql = "SELECT id FROM t@K@ WHERE n='" + who + "'"
    return db.execute(sql)
'''),
    # 5: two-level call from module level
    ("calls.py", '''import os
target = input("host")

def run(cmd):
    os.system(cmd)

def ping(host):
    run("ping -c @K@ " + host)

ping(target)
'''),
    # 6: one branch tainted, merge, sink after
    ("branch.py", '''import os
from flask import request

def pick(flag):
    path = "/srv/@K@"
    if flag:
        path = request.args.get("p")
    else:
        path = "/tmp"
    os.system("ls " + path)
'''),
    # 7: both branches overwrite the tainted value
    ("clean_branch.py", '''import os
from flask import request

def pick(flag):
    path = request.args.get("p")
    if flag:
        path = "/srv/@K@"
    else:
        path = "/tmp"
    os.system("ls " + path)
'''),
    # 8: loop-carried flow
    ("loop.py", '''import os
from flask import request

def poll():
    prev = "none"
    cur = "start"
    while more(@K@):
        os.system(prev)
        prev = cur
        cur = request.args.get("c")
    return cur
'''),
    # 9: route handler parameter
    ("handler.py", '''import os
from fastapi import FastAPI
app = FastAPI()

@app.get("/ping@K@")
def ping(host, count):
    line = "ping " + host
    os.system(line)

def helper(host):
    os.system(host)
'''),
    # 10: module-level source and sink
    ("cli.py", '''import sys
import os
cmd = sys.argv[1]
full = "run @K@ " + cmd
os.system(full)
'''),
    # 11: clean file
    ("clean.py", '''import hashlib

def add(a, b):
    return a + b

def digest(data):
    return hashlib.sha256(data).hexdigest()

NAME = "app@K@"
'''),
    # 12: shell flag and weak digests
    ("shell.py", '''import subprocess
import hashlib

def work(cmd, data):
    subprocess.call("ls -l", shell=True)
    subprocess.run(cmd, shell=True)
    subprocess.run(["ls", cmd])
    first = hashlib.md5(data).hexdigest()
    second = hashlib.new("sha1", data)
    return first
'''),
    # 13: express query
    ("server.js", '''const express = require("express");
const app = express();
app.get("/item@K@", function (req, res) {
  const id = req.query.id;
  let sql = "SELECT name FROM items WHERE id=" + id;
  db.query(sql, done);
});
'''),
    # 14: javascript function, markup sink, sanitized copy
    ("view.js", '''function render(req, res) {
  const who = req.body.name;
  const safe = encodeURIComponent(who);
  res.send("<b>" + safe + "</b>");
  if (who) {
    res.send("<i>@K@" + who + "</i>");
  }
}
'''),
    # 15: go handler
    ("main.go", '''package main
func handle(w http.ResponseWriter, r *http.Request) {
	id := r.URL.Query().Get("id")
	query := "SELECT name FROM t@K@ WHERE id=" + id
	db.Query(query)
	exec.Command(id).Run()
}
'''),
    # 16: c# method
    ("Shop.cs", '''public class Shop@K@
{
    public void Load(HttpRequest request)
    {
        string id = request.QueryString["id"];
        string text = "SELECT name FROM t WHERE id=" + id;
        var cmd = new SqlCommand(text);
    }
}
'''),
    # 17: java method
    ("Repo.java", '''public class Repo@K@ {
    public void find(HttpServletRequest request) {
        String id = request.getParameter("id");
        String sql = "SELECT name FROM t WHERE id=" + id;
        statement.executeQuery(sql);
    }
}
'''),
    # 18: php page
    ("page.php", '''<?php
$id = $_GET["id"];
$sql = "SELECT name FROM t@K@ WHERE id=" . $id;
mysqli_query($db, $sql);
'''),
    # 19: c main
    ("main.c", '''int main(int argc, char **argv) {
    char buf[64];
    char *name = getenv("NAME@K@");
    strcpy(buf, name);
    return 0;
}
'''),
    # 20: secrets and risky patterns
    ("settings.py", '''import re
API_KEY = "k@K@AbCdEf0123456789XyZ"
db_password = "hunter@K@secret"
token = "your_key_here"
pattern = re.compile("(a+)+@K@")
doubled = re.compile("(ab|ab)+x@K@")
plain = re.compile("^[a-z]@K@$")
'''),
    # 21: django names
    ("views.py", '''from django.http import HttpResponse
from django import forms
urlpatterns = []
def show(request):
    page = request.GET.get("page")
    return HttpResponse("@K@" + page)
'''),
    # 22: tainted list in augmented assignment, elif chain
    ("chain.py", '''import os
from flask import request

def build(kind):
    line = "tool @K@"
    if kind == 1:
        line += request.args.get("a")
    elif kind == 2:
        line += "b"
    os.system(line)
'''),
    # 23: try and except
    ("attempt.py", '''import os
from flask import request

def attempt():
    value = "@K@"
    try:
        value = request.args.get("v")
    except KeyError:
        value = "none"
    os.system(value)
'''),
    # 24: environment file
    (".env", '''# settings of app @K@
DEBUG=True
DEBUG_LEVEL=1
PORT=80@K@
'''),
    # 25: compose file
    ("docker-compose.yml", '''services:
  web@K@:
    image: web:@K@
    privileged: true
  db:
    privileged: "true"
'''),
    # 26: package manifest
    ("package.json", '''{"name": "app@K@", "dependencies": {"express": "^3.2.@K@", "left": "1.0.@K@"}, "devDependencies": {"left": "2.0.@K@"}}
'''),
    # 27: private key file
    ("server.key", '''-----BEGIN KEY-----
@K@
-----END KEY-----
'''),
]
