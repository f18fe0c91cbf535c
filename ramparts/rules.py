"""Word lists, thresholds and patterns the rules compare against, and nothing else."""

from __future__ import annotations

from ramparts.functions.text import EDGE, NOT_WS, WORD, WS

# ---- fixed values: results depend on these exact entries -------------------------------------

SEVERITIES = ["Critical", "High", "Medium", "Low", "Informational"]
UNKNOWN_SEVERITY_RANK = 9

CODE_EXTENSIONS = ["js", "jsx", "ts", "tsx", "mjs", "cjs"]
SKIPPED_DIRECTORIES = ["node_modules", ".git", "dist", "build", "coverage", ".next", "out", "vendor", ".cache",
                       "tmp", "__snapshots__"]
FILE_CHARS = 2_000_000
BUNDLES_PER_PAGE = 8

UNITS = [
    ("auth", "auth|login|session|jwt|passport|oauth|token|password"),
    ("routing", "route|router|controller|endpoint|api|handler|middleware"),
    ("database", "model|schema|repository|dao|query|migration|entity|prisma|sequelize|mongoose"),
    ("crypto", "crypt|cipher|hash|hmac|sign|secret|key"),
    ("integration", "client|integration|external|webhook|gateway|provider|sdk"),
    ("jobs", "job|queue|worker|cron|task|consumer|scheduler"),
]
DEFAULT_UNIT = "business"

# header, shown name, severity when missing
EXPECTED_HEADERS = [
    ("content-security-policy", "Content-Security-Policy", "Medium"),
    ("x-content-type-options", "X-Content-Type-Options", "Low"),
    ("referrer-policy", "Referrer-Policy", "Low"),
    ("permissions-policy", "Permissions-Policy", "Informational"),
]
VERSION_HEADERS = ["server", "x-powered-by", "x-aspnet-version", "x-aspnetmvc-version"]
SESSION_COOKIE_NAME = "(?i)sess|sid|token|auth|jwt"
COOKIE_FLAGS = ["HttpOnly", "Secure", "SameSite"]

# path, severity, body signature, label
SENSITIVE_PATHS = [
    ("/.env", "Critical", "(?i)=|SECRET|KEY|PASSWORD|TOKEN", "Environment file"),
    ("/.git/config", "High", r"(?i)\[core\]|remote|url =", "Git configuration"),
    ("/.git/HEAD", "High", rf"(?i)ref:{WS}*refs/", "Git metadata"),
    ("/config.json", "Medium", r"\{", "Application configuration"),
    ("/swagger.json", "Low", "(?i)swagger|openapi", "API schema"),
    ("/api/docs", "Low", "(?i)swagger|redoc|openapi", "API documentation"),
    ("/actuator/env", "High", "(?i)profiles|propertySources", "Actuator environment"),
    ("/debug", "Medium", "(?i)debug|trace|stack", "Debug endpoint"),
    ("/metrics", "Low", "(?i)# HELP|process_", "Metrics endpoint"),
    ("/server-status", "Medium", "(?i)Apache Server Status", "Server status page"),
]
SECURITY_CONTACT_PATH = "/.well-known/security.txt"

SENSITIVE_QUERY = r"(?i)[?&](token|jwt|session|sessionid|access_token|api_key|apikey|password|pwd)="
MIXED_REFERENCE = rf"(?i)(?:src|href){WS}*={WS}*[\"'](http://[^\"']+)[\"']"
PASSWORD_INPUT = rf"(?i)<input[^>]+type{WS}*={WS}*[\"']?password"
SCRIPT_SOURCE = rf"(?i)<script[^>]+src{WS}*={WS}*[\"']([^\"']+)[\"']"
INLINE_SCRIPT = r"(?is)<script(?![^>]*\ssrc\s*=)[^>]*>(.*?)</script"
LISTING = rf"(?i)<title>{WS}*Index of /|Directory listing for"
SOURCE_MAP = rf"//[#@]{WS}*sourceMappingURL=({NOT_WS}+)"
ERROR_WORDS = r"Traceback \(most recent call last\)|SQLSTATE|ORA-\d+|System\.[0-9A-Za-z_]+Exception|stack trace"

# shown name, pattern; tried in this order. Each starts with its literal, which Java finds by skipping ahead,
# and only then looks back for a word edge.
PROVIDERS = [
    ("AWS access key ID", rf"AKIA(?<![{WORD}]AKIA)[0-9A-Z]{{16}}{EDGE}"),
    ("Google API key", rf"AIza(?<![{WORD}]AIza)[0-9A-Za-z\-_]{{35}}{EDGE}"),
    ("Slack token", rf"xox(?<![{WORD}]xox)[baprs]-[0-9A-Za-z-]{{10,}}{EDGE}"),
    ("Stripe secret key", rf"sk_(?<![{WORD}]sk_)(?:live|test)_[0-9A-Za-z]{{16,}}{EDGE}"),
    ("GitHub token", rf"gh(?<![{WORD}]gh)[pousr]_[0-9A-Za-z]{{36,}}{EDGE}"),
    ("Private key block", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("JWT", rf"eyJ(?<![{WORD}]eyJ)[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{EDGE}"),
]

REQUEST_ROOTS = ["req", "request", "ctx", "context", "event"]
REQUEST_PROPERTIES = ["query", "body", "params", "headers", "cookies", "url", "searchParams", "nextUrl"]
REQUEST_BODY_CALLS = ["json", "text", "formData", "arrayBuffer", "blob"]
REQUEST_GETTERS = ["get", "getAll"]
INPUT_DECORATORS = ["Body", "Param", "Query", "Headers", "Req", "Request", "Ip", "Session", "UploadedFile",
                    "UploadedFiles", "RawBody", "HostParam", "Cookies", "Cookie", "Arg", "Args"]
GRAPHQL_MAPS = ["Query", "Mutation", "Subscription"]
PROCEDURE_CALLS = ["query", "mutation", "subscription"]
PROCEDURE_INPUTS = ["input", "rawInput"]

SQL_SINKS = ["query", "execute", "raw", "unsafe", "$queryRawUnsafe", "$executeRawUnsafe"]
SHELL_SINKS = ["exec", "execSync"]
FILE_SINKS = ["readFile", "readFileSync", "writeFile", "writeFileSync", "appendFile", "appendFileSync",
              "createReadStream", "createWriteStream", "unlink", "unlinkSync", "readdir", "readdirSync", "open",
              "openSync", "stat", "statSync", "rm", "rmSync"]
SEND_FILE_SINKS = ["sendFile", "download"]
RESPONSE_NAMES = ["res", "response", "reply"]
PATH_BUILDERS = ["join", "resolve"]
OBJECT_SINKS = ["findById", "findByPk", "findOne", "findUnique", "findByIdAndUpdate", "findByIdAndDelete",
                "findOneAndUpdate", "findOneAndDelete", "updateOne", "deleteOne", "destroy"]
HANDLER_PARAMETERS = ["req", "request", "ctx", "context"]
OWNER_PROPERTIES = ["user", "session", "auth", "account", "principal", "currentuser", "identity", "jwt"]
OWNER_NAMES = "user_?id|owner_?id|current_?user_?id|auth_?user_?id|account_?id"
TOKEN_LIBRARIES = "(?i)jwt|jsonwebtoken|jose"
READ_CALLS = ["findOne", "findById", "findByPk", "findUnique", "findFirst", "exists", "count", "countDocuments"]
WRITE_CALLS = ["save", "create", "insert", "insertOne", "insertMany", "update", "updateOne", "updateMany",
               "increment", "decrement", "destroy"]
CONCURRENCY_GUARD = (r"(?i)transaction|\$transaction|startSession|withTransaction|\.lock\(|for update|acquirelock|"
                     rf"withlock|mutex|serializable|findoneandupdate|{EDGE}upsert{EDGE}")
WEAK_HASHES = ["md5", "sha1"]
RANDOM_TARGET = "(?i)token|secret|otp|nonce|session|key|password|reset"
COMPARED_SECRET = "(?i)token|secret|signature|sig|hmac|digest|hash|apikey|api[_-]?key|password|otp|csrf|mac"

# label, pattern of a practice worth keeping
GOOD_PRACTICES = [
    ("Queries with bound values", rf"\.(query|execute){WS}*\([^)]*\?[^)]*,{WS}*\["),
    ("Slow password hash", f"{EDGE}(bcrypt|argon2|scrypt){EDGE}"),
    ("Timing-safe equality", "timingSafeEqual"),
    ("Tokens from system randomness", r"crypto\.randomBytes"),
    ("Header middleware", rf"{EDGE}helmet{WS}*\("),
    ("Schema validation", f"{EDGE}(zod|joi|yup|express-validator|class-validator){EDGE}"),
    ("Query builder", f"{EDGE}(prisma|knex){EDGE}"),
]

# module suffixes in the order they are tried
MODULE_SUFFIXES = ["", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts"]

# ---- our own choices ---------------------------------------------------------------------------

# every provider match contains one of these; plain substring tests are far cheaper than a regex
PROVIDER_HINTS = ["AKIA", "AIza", "xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "sk_test_", "ghp_", "gho_",
                  "ghu_", "ghs_", "ghr_", "PRIVATE KEY-----", "eyJ"]
SECRET_NAMES = "secret|token|passwd|password|pwd|api_?key|access_?key|private_?key|credential"
SECRET_ASSIGNMENT = (rf"(?i)(?<![0-9A-Za-z_])[0-9a-z_]*(?:{SECRET_NAMES})[0-9a-z_]*[ \t]*[:=][ \t]*"
                     r"(?:\"([^\"\n]{8,})\"|'([^'\n]{8,})')")
ASSIGNMENT_HINT = "[:=][ \\t]*[\"']"
PROBE_ORIGIN = "https://probe.example"

# class -> what a remembered pattern of that class looks like
SIGNATURES = {
    "Hardcoded Secret": "a literal shaped like a credential, or assigned to a secret-named variable",
    "SQL Injection": "request data joined into the text given to a query call",
    "Command Injection": "request data joined into a shell command",
    "Path Traversal": "request data used as a file path",
    "Broken Object-Level Authorization": "an object looked up by a client id in a handler that never names its owner",
    "JWT Implementation Error": "a token call that skips algorithm, expiry or signature checks",
    "Race Condition (TOCTOU)": "a read followed by a write with neither lock nor transaction",
    "Weak Hash Algorithm": "md5 or sha1 used as a hash",
    "Insecure Cipher Mode": "an ECB cipher or the deprecated cipher constructor",
    "Insecure Randomness": "Math.random() assigned to a security-named variable",
    "Non-constant-time Comparison": "a secret-named value compared with an equality operator",
}
