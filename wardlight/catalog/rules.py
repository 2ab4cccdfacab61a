"""Our own rule catalog: one row per rule in the schema of ``RULE_SCHEMA``, at least one rule per class.

Patterns are lower-case-insensitive substrings. Texts are composed from one sentence pair per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RULE_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("rule_id", "language", "vuln_class", "severity", "cwe", "owasp")]
    + [T.StructField("cvss_score", T.DoubleType())]
    + [T.StructField(n, T.StringType()) for n in ("cvss_vector", "confidence", "issue", "message")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("sources", "sinks", "sanitizers")]
    + [T.StructField("remediation", T.StringType())]
)

VECTOR = "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"

# class -> (cwe, owasp, severity, score, what goes wrong, what to do)
CLASSES = {
    "SQLi": ("CWE-89", "A03:2021", "Critical", 9.8, "a database statement is assembled from request text", "bind values as statement parameters and keep the statement text constant"),
    "NoSQLi": ("CWE-943", "A03:2021", "High", 8.8, "a document query takes operators from request text", "cast request values to scalars before they enter a query document"),
    "CMDi": ("CWE-78", "A03:2021", "Critical", 9.8, "an operating system command contains request text", "pass an argument list without a shell and match values against an allow list"),
    "Code Injection": ("CWE-94", "A03:2021", "Critical", 9.8, "text from outside is evaluated as program code", "replace evaluation by a parser for the small language that is really needed"),
    "RCE": ("CWE-94", "A03:2021", "Critical", 10.0, "a remote caller decides which code the process runs", "remove the dynamic call and dispatch through a fixed table of functions"),
    "XSS": ("CWE-79", "A03:2021", "Medium", 6.1, "markup is written with request text that was not escaped", "escape for the output context or use a template with automatic escaping"),
    "SSTI": ("CWE-1336", "A03:2021", "Critical", 9.8, "a template is compiled from request text", "keep template sources fixed and hand request values over as template variables"),
    "SSRF": ("CWE-918", "A10:2021", "High", 8.6, "the server fetches an address chosen by the caller", "resolve the host, compare it with an allow list and refuse private ranges"),
    "XXE": ("CWE-611", "A05:2021", "High", 7.5, "an XML parser resolves external entities", "turn off document type declarations and external entities in the parser"),
    "Path Traversal": ("CWE-22", "A01:2021", "High", 7.5, "a file name from the caller reaches the file system", "resolve the path and check that it stays below the intended folder"),
    "Open Redirect": ("CWE-601", "A01:2021", "Medium", 6.1, "the caller chooses where the browser is sent next", "redirect to named routes or to hosts on an allow list only"),
    "Deserialization": ("CWE-502", "A08:2021", "Critical", 9.8, "an object graph is rebuilt from bytes of unknown origin", "exchange plain data formats and verify a signature before reading them"),
    "LDAP Injection": ("CWE-90", "A03:2021", "High", 8.1, "a directory filter contains request text", "escape filter values with the helper of the directory library"),
    "XPath Injection": ("CWE-643", "A03:2021", "High", 7.5, "an XPath expression contains request text", "bind values as XPath variables and keep the expression constant"),
    "Log Injection": ("CWE-117", "A09:2021", "Low", 4.3, "log lines can be forged through line breaks in request text", "strip control characters or log structured fields instead of joined text"),
    "Hardcoded Secret": ("CWE-798", "A07:2021", "High", 8.1, "a credential is written into the program text", "read credentials from a secret store and rotate the ones that were committed"),
    "Weak Crypto": ("CWE-327", "A02:2021", "Medium", 5.9, "a broken digest or cipher protects data", "use SHA-256 or better for digests and an authenticated cipher for secrecy"),
    "JWT Bypass": ("CWE-347", "A02:2021", "Critical", 9.1, "a token is read without checking its signature", "verify the signature with a pinned algorithm before any claim is used"),
    "Prototype Pollution": ("CWE-1321", "A08:2021", "High", 8.1, "keys from the caller are merged into object prototypes", "reject reserved keys and merge into objects without a prototype"),
    "Buffer Overflow": ("CWE-120", "A06:2021", "Critical", 9.8, "bytes are copied without a bound on the destination", "use bounded copies and check lengths before the copy takes place"),
    "Integer Overflow": ("CWE-190", "A06:2021", "High", 7.5, "a size is computed from outside numbers without a range check", "check operands against limits before multiplying or use checked arithmetic"),
    "Format String": ("CWE-134", "A03:2021", "High", 8.1, "the format argument itself comes from outside", "pass a constant format and hand outside text over as an argument"),
    "Use After Free": ("CWE-416", "A06:2021", "High", 8.1, "memory is touched after it was released", "clear pointers on release and give every buffer a single owner"),
    "Memory Corruption": ("CWE-787", "A06:2021", "Critical", 9.1, "a release or write hits memory that is not owned", "track ownership and release each allocation exactly once"),
    "Race Condition": ("CWE-362", "A04:2021", "Medium", 5.9, "a check and the use of its result can be interleaved", "open first and check the handle, or hold a lock over both steps"),
    "Null Pointer Dereference": ("CWE-476", "A06:2021", "Medium", 5.5, "a result that may be empty is used unchecked", "test the result before use and handle the empty case explicitly"),
    "ReDoS": ("CWE-1333", "A06:2021", "Medium", 5.3, "a pattern with nested repetition runs on outside text", "rewrite the pattern without nested repetition or bound the matching time"),
    "CSRF": ("CWE-352", "A01:2021", "Medium", 6.5, "a state change accepts requests from other sites", "require a token tied to the session and SameSite cookies"),
    "Misconfiguration": ("CWE-16", "A05:2021", "Medium", 5.3, "a setting meant for development is switched on", "keep production settings in a separate profile and review them on release"),
    "Cookie Security": ("CWE-614", "A05:2021", "Low", 4.3, "a cookie is set without its protective attributes", "set Secure, HttpOnly and SameSite on every cookie that carries a session"),
    "File Upload": ("CWE-434", "A04:2021", "High", 8.1, "uploaded content is stored under a name chosen by the caller", "generate names, check the content type and store outside the web root"),
    "Mass Assignment": ("CWE-915", "A08:2021", "Medium", 6.5, "a whole request body is copied into a record", "copy named fields only and ignore the rest of the body"),
    "Out-of-bounds Read": ("CWE-125", "A06:2021", "High", 7.1, "an index from outside reads past the end of a buffer", "compare the index with the length before every access"),
    "Information Exposure": ("CWE-200", "A01:2021", "Low", 4.3, "internal details are sent to the caller", "answer with a generic message and keep details in the server log"),
    "DoS": ("CWE-400", "A04:2021", "Medium", 5.9, "work grows with an unchecked number from the caller", "cap sizes and counts taken from requests before work starts"),
    "Cleartext Transmission": ("CWE-319", "A02:2021", "Medium", 5.9, "data leaves the host without encryption", "use the encrypted variant of the protocol and verify certificates"),
}

PY = ["request.args.get(", "request.form", "request.json", "input(", "sys.argv"]
JS = ["req.query", "req.body", "req.params"]
JAVA = ["request.getparameter(", "request.getheader("]
GO = ["r.url.query(", "r.formvalue("]
CS = ["request.querystring[", "request.form["]
PHP = ["$_get[", "$_post["]
C = ["getenv(", "argv["]

# (rule_id, language, class, sources, sinks, sanitizers)
RULES = [
    ("python_sqli", "python", "SQLi", PY, [".execute(", "cursor.executemany"], ["int(", "float(", "escape_sql("]),
    ("python_cmdi", "python", "CMDi", PY, ["os.system", "os.popen", "subprocess.run"], ["shlex.quote("]),
    ("python_eval", "python", "Code Injection", PY, ["eval(", "exec("], ["ast.literal_eval("]),
    ("python_pickle", "python", "Deserialization", PY, ["pickle.loads", "yaml.load("], []),
    ("python_xss", "python", "XSS", PY, ["render_template_string", "make_response("], ["escape("]),
    ("python_ssti", "python", "SSTI", PY, ["render_template_string", "jinja2.template("], []),
    ("python_ssrf", "python", "SSRF", PY, ["requests.get", "urllib.request.urlopen"], ["check_host("]),
    ("python_path", "python", "Path Traversal", PY, ["open(", "send_file("], ["secure_filename("]),
    ("python_redirect", "python", "Open Redirect", PY, ["redirect("], ["url_for("]),
    ("python_log", "python", "Log Injection", PY, ["logging.info", "logger.warning"], []),
    ("python_weak_hash", "python", "Weak Crypto", [], ["hashlib.md5", "hashlib.sha1"], []),
    ("python_xxe", "python", "XXE", PY, ["etree.fromstring"], ["defusedxml"]),
    ("python_ldap", "python", "LDAP Injection", PY, ["ldap.search_s"], ["escape_filter_chars("]),
    ("python_xpath", "python", "XPath Injection", PY, [".xpath("], []),
    ("python_debug", "python", "Misconfiguration", [], ["debug=true"], []),
    ("python_token_text", "python", "Information Exposure", [], ["token = "], ["redacted"]),
    ("python_csrf", "python", "CSRF", [], ["csrf_exempt"], []),
    ("python_secret_literal", "python", "Hardcoded Secret", [], [], []),
    ("js_nosqli", "javascript", "NoSQLi", JS, ["collection.find(", "findone("], ["string("]),
    ("js_sqli", "javascript", "SQLi", JS, ["db.query"], ["escape("]),
    ("js_xss", "javascript", "XSS", JS, ["res.send", "innerhtml"], ["encodeuricomponent("]),
    ("js_eval", "javascript", "RCE", JS, ["eval(", "vm.runinnewcontext"], []),
    ("js_proto", "javascript", "Prototype Pollution", JS, ["object.assign", "_.merge"], []),
    ("js_mass", "javascript", "Mass Assignment", JS, ["model.create("], ["pick("]),
    ("js_cookie", "javascript", "Cookie Security", [], ["res.cookie("], ["httponly"]),
    ("js_upload", "javascript", "File Upload", JS, ["fs.writefile"], []),
    ("js_redos", "javascript", "ReDoS", JS, ["new regexp("], []),
    ("java_sqli", "java", "SQLi", JAVA, ["statement.executequery", "createquery("], ["integer.parseint("]),
    ("java_jwt", "java", "JWT Bypass", JAVA, ["jwts.parser().parse("], ["setsigningkey("]),
    ("java_deser", "java", "Deserialization", JAVA, ["readobject("], []),
    ("php_include", "php", "Path Traversal", PHP, ["include(", "file_get_contents("], ["basename("]),
    ("php_sqli", "php", "SQLi", PHP, ["mysqli_query"], ["intval("]),
    ("c_strcpy", "c", "Buffer Overflow", C, ["strcpy(", "sprintf("], ["strlcpy("]),
    ("c_format", "c", "Format String", C, ["printf("], []),
    ("c_int", "c", "Integer Overflow", C, ["malloc("], ["check_mul("]),
    ("c_uaf", "c", "Use After Free", [], ["free("], []),
    ("cpp_delete", "cpp", "Memory Corruption", [], ["delete[] "], []),
    ("cpp_null", "cpp", "Null Pointer Dereference", [], ["dynamic_cast<"], []),
    ("cpp_oob", "cpp", "Out-of-bounds Read", C, [".data()["], []),
    ("go_sqli", "go", "SQLi", GO, ["db.query"], ["strconv.atoi("]),
    ("go_cmdi", "go", "CMDi", GO, ["exec.command"], []),
    ("go_path", "go", "Path Traversal", GO, ["os.open"], ["filepath.base("]),
    ("go_race", "go", "Race Condition", [], ["os.stat("], []),
    ("go_dos", "go", "DoS", GO, ["make([]byte"], ["min("]),
    ("csharp_sqli", "csharp", "SQLi", CS, ["new sqlcommand("], ["int.parse("]),
    ("csharp_cmdi", "csharp", "CMDi", CS, ["process.start"], []),
    ("csharp_http", "csharp", "Cleartext Transmission", CS, ["new ftpwebrequest("], []),
    ("any_license_text", "python", "Information Exposure", ["licensed under"], ["license", "licensed"], ["apache"]),
]


def rule_rows() -> list[tuple]:
    """The catalog as tuples in ``RULE_SCHEMA`` order."""
    rows = []
    for rule_id, lang, cls, sources, sinks, sanitizers in RULES:
        cwe, owasp, sev, score, wrong, todo = CLASSES[cls]
        rows.append((
            rule_id, lang, cls, sev, cwe, owasp, score, VECTOR, "Confirmed" if cls not in ("CSRF", "ReDoS") else "Tentative",
            f"{cls} in {lang}",
            f"In this {lang} code {wrong}; an attacker who controls that data changes what the program does.",
            sources, sinks, sanitizers,
            f"To fix it, {todo}. Add a regression test that sends hostile input through this code path.",
        ))
    return rows


def rules_df(spark: SparkSession) -> DataFrame:
    """The shipped catalog as a DataFrame."""
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)
