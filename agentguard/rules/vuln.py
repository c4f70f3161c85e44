"""Exploit payload rules for tool arguments."""

from agentguard.rules.model import Rule

# Patterns (RE2) with the literals each needs. SQL and XSS rules read lower-cased text.
_SQLI = [
    (r"(?i)\bunion\s+(all\s+)?select\b", ("union",)),
    (r"""(?i)\b(or|and)\s+['"]?\d+['"]?\s*=\s*['"]?\d+['"]?""", ("=",)),
    (r"""(?i)\b(or|and)\s+['"]?[a-z]+['"]?\s*=\s*['"]?[a-z]+['"]?""", ("=",)),
    (r"""(?i)['";]\s*--""", ("--",)),
    (r"""(?i)['";]\s*/\*""", ("/*",)),
    (r"""(?i)['";]\s*;\s*(drop|alter|create|insert|update|delete|exec|execute|xp_)\b""", (";",)),
    (r"""(?i)'\s*(or|and)\s+'""", ("'",)),
    (r"(?i)\b(sleep|benchmark|pg_sleep)\s*\(", ("sleep", "benchmark")),
    (r"(?i)\bwaitfor\s+delay\b", ("waitfor",)),
    (r"(?i)\binformation_schema\b", ("information_schema",)),
    (r"(?i)\b(into\s+outfile|load_file)\b", ("outfile", "load_file")),
    (r"(?i)/\*!\d*.*\*/", ("/*!",)),
    (r"(?i)/\*.*\*/.*(?:select|union|insert|update|delete|drop)", ("*/",)),
]
# Path traversal: patterns (RE2) with their needed literals.
_PATH = [
    (r"\.\.(/|\\)", ("..",)),
    (r"(?i)(%2e%2e|%2e%2e%2f|%2e%2e/|\.\.%2f|%2e%2e%5c|\.\.%5c)", ("%2e", "..%")),
    (r"(?i)(%252e%252e|%252e%252e%252f)", ("%252e",)),
    (r"(?i)(%252e%2e|%2e%252e)", ("%252e",)),
    (r"(?i)(%%32%65)", ("%%32%65",)),
    (r"%00", ("%00",)),
    (r"\.%00", ("%00",)),
    (r"(?i)^\\\\[a-z0-9]", ("\\\\",)),
]
# Command injection: patterns (RE2) with their needed literals.
_COMMAND = [
    (r"[;&|`]\s*(cat|ls|id|whoami|uname|curl|wget|nc|ncat|bash|sh|python|perl|ruby|php)\b", (";", "&", "|", "`")),
    (r"\$\([^)]+\)", ("$(",)),
    (r"`[^`]+`", ("`",)),
    (r"\|\s*(bash|sh|zsh|csh|ksh|fish)\b", ("|",)),
    (r"\n\s*(cat|ls|id|whoami|uname|curl|wget|nc|bash|sh)\b", ("\n",)),
    (r";\s*(rm|dd|mkfs|chmod|chown|kill|reboot|shutdown|halt)\b", (";",)),
    (r"(&&|\|\|)\s*(rm|dd|mkfs|chmod|chown|curl|wget|nc|bash|sh)\b", ("&&", "||")),
]
# Cross-site scripting: patterns (RE2) with their needed literals.
_XSS = [
    (r"(?i)<\s*script[\s>]", ("script",)),
    (r"(?i)<\s*/\s*script\s*>", ("script",)),
    (r"(?i)\bon(error|load|click|mouseover|focus|blur|submit|change|input|keyup|keydown)\s*=", ("=",)),
    (r"(?i)javascript\s*:", ("javascript",)),
    (r"(?i)data\s*:\s*text/html", ("text/html",)),
    (r"(?i)<\s*svg[\s/].*?on\w+\s*=", ("svg",)),
    (r"(?i)<\s*img[^>]+on(error|load)\s*=", ("img",)),
    (r"(?i)&#(x6a|106);?\s*&#(x61|97);?\s*&#(x76|118);?\s*&#(x61|97);?", ("&#",)),
    (r"(?i)expression\s*\(", ("expression",)),
    (r"""(?i)style\s*=\s*["'][^"']*expression\s*\(""", ("expression",)),
]
# Blocked URL schemes, metadata hosts, loopback spellings and networks.
BAD_SCHEMES = ("file", "gopher", "dict", "ftp")
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal")
LOOPBACK_V6 = ("::1", "::ffff:127.0.0.1", "0:0:0:0:0:0:0:1", "::ffff:0:0", "::ffff:7f00:1")
PRIVATE_CIDRS_V4 = (
    "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8",
)
DECIMAL_IP_MIN_DIGITS = 6


def _rules(rule_id, pairs, view):
    return tuple(Rule("vuln", rule_id, p, needs=needs, view=view) for p, needs in pairs)


SQLI = _rules("sqli", _SQLI, "lower")
PATH_TRAVERSAL = _rules("path_traversal", _PATH, "raw")
COMMAND_INJECTION = _rules("command_injection", _COMMAND, "raw")
XSS = _rules("xss", _XSS, "lower")
PACK = SQLI + PATH_TRAVERSAL + COMMAND_INJECTION + XSS
ORDER = ("sqli", "ssrf", "path_traversal", "command_injection", "xss")
REASONS = {
    "sqli": "SQL injection detected",
    "path_traversal": "path traversal detected",
    "command_injection": "command injection detected",
    "xss": "XSS detected",
}
