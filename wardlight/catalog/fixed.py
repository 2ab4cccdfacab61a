"""Word lists, lookup tables, constants and patterns the results depend on."""

# --- Fixed values: severities -------------------------------------------------
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]
SEVERITY_WEIGHT = {"Critical": 15, "High": 10, "Medium": 5, "Low": 2, "Info": 0}
SEVERITY_FALLBACK_CVSS = {"Critical": 9.5, "High": 7.5, "Medium": 5.0, "Low": 2.0, "Info": 0.5}
DEFAULT_CVSS = 5.0
GRADE_CUTS = [(90, "A"), (75, "B"), (60, "C"), (40, "D")]
LOWEST_GRADE = "F"

# --- Fixed values: CVSS base score by vulnerability class (scoring) -----------
CLASS_CVSS = {
    "SQLi": 9.8, "NoSQLi": 8.8, "CMDi": 9.8, "RCE": 10.0, "eval": 9.8, "XSS": 6.1, "SSRF": 8.6,
    "Path Traversal": 7.5, "LFI": 7.5, "SSTI": 9.8, "Deserialization": 9.8, "XXE": 7.5,
    "Hardcoded Secret": 7.5, "Weak Crypto": 5.9, "Open Redirect": 6.1, "CORS": 5.4,
    "Auth Bypass": 8.8, "IDOR": 6.5, "Open Port": 2.0, "Default": 5.0,
}

# --- Fixed values: CVSS score and vector by class (report formatting) ---------
REPORT_CVSS = {
    "SQLi": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "CMDi": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Code Injection": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Deserialization": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Insecure Deserialization": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Path Traversal": (7.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"),
    "SSRF": (8.6, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:N/A:N"),
    "XXE": (7.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:N/A:N"),
    "XSS": (6.1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    "DOM XSS": (6.1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    "Open Redirect": (6.1, "CVSS:3.1/AV:N/AC:L/PR:N/UI:R/S:C/C:L/I:L/A:N"),
    "SSTI": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Mass Assignment": (6.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:L/I:L/A:N"),
    "ReDoS": (7.5, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H"),
    "Hardcoded Secret": (8.1, "CVSS:3.1/AV:N/AC:L/PR:L/UI:N/S:U/C:H/I:H/A:N"),
    "Prototype Pollution": (8.1, "CVSS:3.1/AV:N/AC:H/PR:N/UI:N/S:U/C:H/I:H/A:H"),
    "Buffer Overflow": (9.8, "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H"),
}

# --- Fixed values: files ------------------------------------------------------
LANGUAGE_BY_EXT = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript",
    ".java": "java", ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp",
    ".hpp": "cpp", ".go": "go", ".cs": "csharp",
}
CONFIG_CHECK_BY_NAME = {
    ".env": "env", "docker-compose.yml": "compose", "docker-compose.yaml": "compose", "package.json": "package",
}
SKIP_DIRS = [
    "node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", ".idea", ".vscode", "target", "bin",
    "obj", "coverage", ".nyc_output", "vendor", "bower_components", ".cache", ".next", ".nuxt", "out", "public",
    "static",
]
STRING_MARKS = ['"', "'", "`", "="]
MIN_KEYWORD_LEN = 3

# --- Fixed values: recorded responses -----------------------------------------
BINARY_TYPE_PREFIXES = [
    "image/", "video/", "audio/", "application/octet-stream", "application/pdf", "application/zip", "font/",
]
SCAN_ASSET_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".css", ".js", ".mjs", ".woff", ".woff2",
    ".ttf", ".eot", ".mp4", ".mp3", ".avi", ".mov", ".pdf", ".zip", ".tar", ".gz", ".json",
]
CRAWL_ASSET_SUFFIXES = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".svg", ".bmp", ".css", ".woff", ".woff2", ".ttf", ".eot",
    ".otf", ".mp4", ".mp3", ".avi", ".mov", ".webm", ".pdf", ".zip", ".tar", ".gz", ".exe", ".dmg",
]
LATENCY_MIN_MS = 4500
LATENCY_OVER_BASELINE_MS = 3000
DIFF_MIN_LENGTH_DELTA = 20
DIFF_MAX_SIMILARITY = 0.95
HSTS_MIN_AGE = 15768000
SERVER_PRODUCTS = ["apache", "nginx", "iis", "tomcat", "lighttpd"]
RISKY_METHODS = ["TRACE", "PUT", "DELETE", "CONNECT"]

# --- Fixed values: database error patterns, in match order --------------------
DB_ERROR_PATTERNS = [
    r"you have an error in your sql syntax", r"mysql_fetch_array\(\)", r"warning: mysql",
    r"unclosed quotation mark", r"sql syntax.*mysql", r"mysql_num_rows\(\)", r"pg::syntaxerror", r"pg_query\(\)",
    r"org\.postgresql\.util\.psqlexception", r"error:.*syntax error at",
    r"unclosed quotation mark after the character string", r"incorrect syntax near", r"microsoft.*sql.*server",
    r"mssql_query\(\)", r"\[microsoft\]\[sql server\]", r"ora-\d{4,5}", r"oracle.*driver", r"oracle.*odbc",
    r"sqlite3\.", r"sqlite_error", r"sqlite.*exception", r"sql command not properly ended",
    r"quoted string not properly terminated", r"syntax error.*unexpected",
]

# --- Fixed values: body indicators (kind, case-insensitive, texts in order) ---
UNIX_FILE_INDICATORS = [
    "root:x:0:0:", "root:!:0:0:", "/bin/bash", "/bin/sh", "nobody:x:", "daemon:x:", "HOSTNAME=", "PATH=/usr",
    "Linux version",
]
WINDOWS_FILE_INDICATORS = [
    "[extensions]", "[boot loader]", "[operating systems]", "MSDOS.SYS", "[386Enh]", "[drivers]",
    "for 16-bit app support",
]
ENTITY_INDICATORS = ["root:x:0:0:", "[extensions]", "[boot loader]"]
INTERNAL_INDICATORS = [
    "ami-id", "instance-id", "security-credentials", "local-hostname", "instance-type", "mac", "placement",
    "computeMetadata", "serviceAccounts", "projectId", "numericProjectId", "subscriptionId", "vmId",
    "resourceGroupName", "Redis version", "elasticsearch", "mongodb", "Memcached", "+PONG", "Welcome to nginx",
    "Apache/2", "It works!", "root:x:0:0:", "/bin/bash", "Internal Server Error", "localhost refused",
]

# --- Fixed values: page crawling ----------------------------------------------
SKIP_LINK_PREFIXES = ["javascript:", "mailto:", "tel:", "#"]
SKIP_INPUT_TYPES = ["submit", "button", "image", "reset"]
JS_ENDPOINT_PATTERNS = [
    r"""fetch\s*\(["']([^"'?#\s]+)["']""",
    r"""fetch\s*\(`([^`?#\s]+)`""",
    r"""axios\s*\.\s*(?:get|post|put|delete|patch)\s*\(["']([^"'?#\s]+)["']""",
    r"""axios\s*\.\s*(?:request)\s*\(\s*\{[^}]*url\s*:\s*["']([^"'?#\s]+)["']""",
    r"""XMLHttpRequest[^"]*open\s*\(["'](?:GET|POST|PUT|DELETE)["'],\s*["']([^"'?#\s]+)["']""",
    r"""\$\s*\.\s*(?:ajax|get|post)\s*\(\s*["']([^"'?#\s]+)["']""",
    r"""\$\s*\.\s*ajax\s*\(\s*\{[^}]*url\s*:\s*["']([^"'?#\s]+)["']""",
    r"""(?:apiUrl|API_URL|baseUrl|BASE_URL|endpoint|ENDPOINT)\s*[=:]\s*["']([^"']+)["']""",
    r"""fetch\s*\(`([^`]+)`\)""",
    r"""["'](/api/[^"'?#\s]+)["']""",
    r"""["'](/v\d+/[^"'?#\s]+)["']""",
    r"""["'](/rest/[^"'?#\s]+)["']""",
    r"""["'](/graphql)["']""",
]
SITEMAP_PATTERN = r"<loc>\s*(https?://[^\s<]+)\s*</loc>"
ROBOTS_PATTERN = r"(?:Disallow|Allow):\s*(/[^\s*]+)"

# --- Fixed values: secrets ----------------------------------------------------
SECRET_PATTERNS = [
    ("secret_api_key", r"""(?i)(api[_-]?key|apikey)\s*=\s*["'][A-Za-z0-9+/=_\-]{16,}["']"""),
    ("secret_assignment", r"""(?i)(secret|passwd|password|token|auth)\s*=\s*["'][^\s"']{8,}["']"""),
    ("secret_cloud_key_id", r"""(?i)(aws_access_key_id)\s*=\s*["']AKIA[A-Z0-9]{16}["']"""),
    ("secret_sk_token", r"""sk-[A-Za-z0-9]{32,}"""),
    ("secret_ghp_token", r"""ghp_[A-Za-z0-9]{36}"""),
    ("secret_xoxb_token", r"""xoxb-[0-9]{11}-[0-9]{11}-[A-Za-z0-9]{24}"""),
]
ENTROPY_MIN_LENGTH = 20
ENTROPY_MIN_BITS = 4.5
CREDENTIAL_NAMES = [
    "api_key", "apikey", "api_secret", "secret_key", "secret", "password", "passwd", "pwd", "token", "auth_token",
    "access_token", "private_key", "client_secret",
]
CREDENTIAL_MIN_LENGTH = 8
CREDENTIAL_EXCLUDED = ["your_key_here", "change_me", "example", "placeholder", "xxx", "todo", "test"]
SENSITIVE_FILE_PATTERN = r"^(\.env|.*\.pem|.*\.key|id_rsa|credentials\.json)$"
SKIPPED_PATH_PARTS = ["/test", "/spec", "/mock"]
PLACEHOLDER_VALUES = ["your_key_here", "<api_key>", "example", "placeholder"]

# --- Fixed values: structural checks on calls ---------------------------------
SHELL_FUNCTIONS = [
    "subprocess.call", "subprocess.run", "subprocess.check_output", "subprocess.popen", "subprocess.check_call",
]
WEAK_CRYPTO_TEXTS = [
    "hashlib.md5", "hashlib.sha1", 'hashlib.new("md5"', "hashlib.new('md5'", 'hashlib.new("sha1"',
    "hashlib.new('sha1'", "md5.new(", "sha.new(", "des.new(", "rc4.new(", "arc4.new(", "Crypto.Hash.MD5",
    "Crypto.Hash.SHA",
]
REDOS_MIN_LENGTH = 5
REDOS_PATTERNS = [
    r"\([^)]*([+*]|\{\d+,?\d*\}).*?\)[+*]",
    r"\(([^|]+)\|\1\)[+*]",
    r"(?:\w\+|\.\*){2,}",
]
PARAMETER_MARKS = ["?", "%s"]
PARAMETER_MARKS_LOWER = [":param", "filter_by(", "filter("]
ROUTE_WORDS = ["route", "get", "post", "put", "delete"]
RECEIVER_NAMES = ["self", "cls"]

# --- Fixed values: framework signals (language, framework, pattern, weight) ---
FRAMEWORK_SIGNALS = [
    ("python", "flask", r"from flask import", 0.8),
    ("python", "flask", r"import flask", 0.6),
    ("python", "flask", r"flask\.flask\(", 0.9),
    ("python", "flask", r"@app\.route\(", 0.9),
    ("python", "flask", r"request\.args", 0.7),
    ("python", "django", r"from django", 0.9),
    ("python", "django", r"import django", 0.7),
    ("python", "django", r"django\.http", 0.8),
    ("python", "django", r"request\.get\b", 0.5),
    ("python", "django", r"urlpatterns", 0.8),
    ("python", "fastapi", r"from fastapi import", 0.9),
    ("python", "fastapi", r"import fastapi", 0.7),
    ("python", "fastapi", r"fastapi\.fastapi\(", 0.9),
    ("python", "fastapi", r"@app\.(get|post|put|delete)\(", 0.8),
    ("python", "tornado", r"import tornado", 0.9),
    ("python", "tornado", r"tornado\.web", 0.8),
    ("python", "tornado", r"self\.get_argument\(", 0.9),
    ("python", "aiohttp", r"import aiohttp", 0.9),
    ("python", "aiohttp", r"from aiohttp", 0.8),
    ("python", "aiohttp", r"aiohttp\.web", 0.9),
    ("javascript", "express_js", r"require\(['\"]express", 0.9),
    ("javascript", "express_js", r"from ['\"]express", 0.8),
    ("javascript", "express_js", r"express\(\)", 0.8),
    ("javascript", "express_js", r"req\.query\.", 0.7),
    ("javascript", "express_js", r"req\.body\.", 0.7),
    ("javascript", "express_js", r"app\.(get|post|put|delete)\(", 0.7),
    ("java", "spring_java", r"import org\.springframework", 0.9),
    ("java", "spring_java", r"@restcontroller", 0.9),
    ("java", "spring_java", r"@requestmapping", 0.8),
    ("java", "spring_java", r"@requestparam", 0.8),
    ("java", "spring_java", r"httpservletrequest", 0.7),
]
FRAMEWORK_ORDER = ["flask", "django", "fastapi", "tornado", "aiohttp", "express_js", "spring_java"]
GENERIC_CONFIDENCE = 0.5

# --- Fixed values: sources each framework adds --------------------------------
FRAMEWORK_SOURCES = {
    "flask": [
        "request.args.get", "request.args[", "request.form.get", "request.form[", "request.json",
        "request.get_json", "request.values.get", "request.values[", "request.data", "request.files",
        "request.cookies.get", "request.cookies[", "request.headers.get", "request.headers[", "request.environ.get",
    ],
    "django": [
        "request.GET.get", "request.GET[", "request.POST.get", "request.POST[", "request.data",
        "request.query_params", "request.body", "request.FILES", "request.META.get", "request.META[",
        "request.COOKIES.get", "request.COOKIES[", "request.resolver_match", "self.kwargs.get",
    ],
    "fastapi": [
        "Request.query_params", "Request.headers", "Request.cookies", "Request.body", "request.query_params",
        "request.headers.get",
    ],
    "aiohttp": [
        "request.rel_url.query", "request.query", "request.match_info", "request.json", "request.post",
        "request.headers", "request.cookies",
    ],
    "tornado": [
        "self.get_argument", "self.get_query_argument", "self.get_body_argument", "self.request.arguments",
        "self.request.body", "self.request.headers",
    ],
    "express_js": [
        "req.query", "req.params", "req.body", "req.headers", "req.cookies", "request.query", "request.params",
        "request.body",
    ],
    "spring_java": [
        "@RequestParam", "request.getParameter", "request.getHeader", "request.getAttribute",
        "httpRequest.getParameter", "servletRequest.getParameter",
    ],
    "generic": [
        "input(", "sys.argv", "os.environ.get", "os.getenv", "os.environ[", "argv[", "getenv(", "argparse",
        "click.argument", "click.option", "urllib.parse.parse_qs", "cgi.FieldStorage",
    ],
}

# --- Fixed values: rule checks ------------------------------------------------
RULE_FIELDS = [
    "rule_id", "language", "vuln_class", "severity", "cwe", "owasp", "cvss_score", "cvss_vector", "confidence",
    "issue", "message", "sources", "sinks", "sanitizers", "remediation",
]
ALLOWED_CLASSES = [
    "SQLi", "NoSQLi", "CMDi", "XSS", "SSTI", "SSRF", "XXE", "Path Traversal", "Open Redirect", "Deserialization",
    "Code Injection", "LDAP Injection", "XPath Injection", "Log Injection", "Hardcoded Secret", "Weak Crypto",
    "JWT Bypass", "Prototype Pollution", "Buffer Overflow", "Integer Overflow", "Format String", "Use After Free",
    "Memory Corruption", "Race Condition", "Null Pointer Dereference", "ReDoS", "CSRF", "Misconfiguration",
    "Cookie Security", "Mass Assignment", "File Upload", "Out-of-bounds Read", "Information Exposure",
    "Type Confusion", "DoS", "Cleartext Transmission", "Log Forging",
]
ALLOWED_CONFIDENCE = ["Confirmed", "Probable", "Tentative"]
FORBIDDEN_SINKS = [
    "deprecated_function_", "DeprecatedMethod", "vulnerableSink", "fake_", "dummy_", "placeholder_", "_vuln",
    "vuln_func", "unsafe_func_", "test_sink_", "example_sink",
]
SANITIZER_LIKE = ["escape(", "encode(", "sanitize(", "quote(", "prepare(", "bind"]
BOILERPLATE_REMEDIATION = "validate and sanitize all user input"
MESSAGE_MIN = {"basic": 50, "strict": 80}
REMEDIATION_MIN = {"basic": 80, "strict": 100}
TENTATIVE_RULES = [
    "c_use_after_free", "c_integer_overflow", "cpp_integer_overflow", "cpp_out_of_bounds_read", "go_csrf",
    "python_csrf", "javascript_csrf", "python_cookie_security", "javascript_cookie_security", "python_redos",
    "javascript_redos",
]

# --- Fixed values: replies ----------------------------------------------------
REFUSAL_PHRASES = ["i can't", "i cannot", "i'm sorry", "as an ai", "this code"]
REPLY_MIN_CHARS = 50

# --- Fixed values: scan cache and history -------------------------------------
CACHE_TTL_DAYS = 30
CACHE_MAX_ENTRIES = 10_000
CACHE_MAX_BYTES = 25 * 1024 * 1024
SCAN_TYPE_LABELS = {"sast": "Code Scan", "dast": "External Scan", "port": "Port Scan", "secret": "Secret Scan"}
RISK_CUTS = [(75, "Low"), (50, "Medium"), (25, "High")]
RISK_WORST = "Critical"
TREND_DAYS = 7
RECENT_SCANS = 5
ADVISORIES = [("express", ["3.", "^3.", "2.", "1."], "High")]

# --- Fixed values: response checks ---
# check -> (severity, cvss score, cwe, owasp, confidence)
HEADER_CHECKS = {
    "hsts_missing": ("Medium", 5.9, "CWE-319", "A02:2021", "Confirmed"),
    "hsts_max_age_short": ("Low", 3.1, "CWE-319", "A02:2021", "Confirmed"),
    "hsts_no_subdomains": ("Low", 3.1, "CWE-319", "A02:2021", "Confirmed"),
    "csp_missing": ("Medium", 6.1, "CWE-1021", "A03:2021", "Confirmed"),
    "csp_unsafe_inline": ("Medium", 6.1, "CWE-1021", "A03:2021", "Confirmed"),
    "csp_unsafe_eval": ("Medium", 5.4, "CWE-1021", "A03:2021", "Confirmed"),
    "csp_permissive": ("Low", 4.3, "CWE-1021", "A03:2021", "Probable"),
    "frame_missing": ("Medium", 4.3, "CWE-1021", "A04:2021", "Confirmed"),
    "frame_misconfigured": ("Low", 3.1, "CWE-1021", "A04:2021", "Confirmed"),
    "nosniff_missing": ("Low", 3.7, "CWE-693", "A04:2021", "Confirmed"),
    "referrer_missing": ("Low", 3.1, "CWE-200", "A01:2021", "Confirmed"),
    "referrer_permissive": ("Low", 3.1, "CWE-200", "A01:2021", "Confirmed"),
    "permissions_missing": ("Low", 3.1, "CWE-693", "A04:2021", "Confirmed"),
    "server_banner": ("Low", 3.1, "CWE-200", "A05:2021", "Confirmed"),
    "powered_by": ("Low", 3.1, "CWE-200", "A05:2021", "Confirmed"),
    "cache_control": ("Low", 3.1, "CWE-524", "A04:2021", "Probable"),
}
COOKIE_CHECKS = {
    "cookie_http_only": ("Medium", 5.4, "CWE-1004", "A05:2021", "Confirmed"),
    "cookie_secure": ("Medium", 5.4, "CWE-614", "A02:2021", "Confirmed"),
    "cookie_same_site": ("Medium", 4.3, "CWE-352", "A01:2021", "Confirmed"),
}
METHOD_CHECKS = {
    "OPTIONS": ("Medium", 5.3, "CWE-749", "A05:2021", "Confirmed"),
    "TRACE": ("Medium", 5.3, "CWE-16", "A05:2021", "Confirmed"),
    "PUT": ("High", 8.6, "CWE-434", "A01:2021", "Confirmed"),
    "DELETE": ("High", 7.5, "CWE-285", "A01:2021", "Probable"),
    "CONNECT": ("High", 7.5, "CWE-441", "A01:2021", "Probable"),
}

# --- Fixed values: severity words of other tools ---
# dialect -> (tests in order: (texts, severity), exact match?, default, value for a missing severity)
DIALECTS = {
    "agent": ([(["low"], "Low"), (["medium"], "Medium"), (["high"], "High"), (["info"], "Low")], True, "Low", "Low"),
    "dashboard": ([(["crit"], "Critical"), (["high", "error"], "High"), (["med", "warn"], "Medium"), (["low", "info"], "Low")], False, "Low", "Low"),
    "bandit": ([(["high"], "High"), (["med"], "Medium")], False, "Low", "Low"),
    "semgrep": ([(["error", "high"], "High"), (["warn", "medium"], "Medium"), (["info", "low"], "Low")], False, "Medium", "Medium"),
    "zap": ([(["high"], "High"), (["medium"], "Medium")], False, "Low", "Medium"),
}
