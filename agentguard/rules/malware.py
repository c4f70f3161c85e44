"""Malware rules for tool responses."""

from agentguard.rules.model import Rule

# Script families (lower-cased text): name, pattern (RE2), needed literals.
_SCRIPTS = [
    ("PowerShell download cradle", r"(?i)(invoke-webrequest|invoke-expression|iex|downloadstring|downloadfile|start-bitstransfer|new-object\s+net\.webclient)", ("invoke-", "iex", "download", "start-bits", "new-object")),
    ("PowerShell encoded command", r"(?i)powershell[^;]*-e(nc(odedcommand)?)?[\s]+[A-Za-z0-9+/=]{4,}", ("powershell",)),
    ("Bash reverse shell", r"(?i)(bash\s+-i\s+>&|/dev/tcp/|nc\s+-e|ncat\s+-e|mkfifo\s+/tmp/)", ("bash", "/dev/tcp/", "nc", "ncat", "mkfifo")),
    ("Python reverse shell", r"(?i)(socket\.socket.*connect|subprocess\.call.*shell\s*=\s*true|os\.system.*nc\s)", ("socket.socket", "subprocess.call", "os.system")),
    ("Perl reverse shell", r"(?i)(perl\s+-e\s+'.*socket|IO::Socket::INET)", ("perl", "io::socket::inet")),
    ("Crypto miner indicators", r"(?i)(stratum\+tcp://|xmrig|coinhive|cryptonight|monero.*pool|mining.*pool)", ("stratum+tcp://", "xmrig", "coinhive", "cryptonight", "monero", "mining")),
    ("Credential harvesting", r"(?i)(mimikatz|sekurlsa|lsadump|hashdump|sam\s+database|ntds\.dit)", ("mimikatz", "sekurlsa", "lsadump", "hashdump", "database", "ntds.dit")),
    ("C2 beacon patterns", r"(?i)(beacon_interval|callback_url|c2_server|exfil_endpoint|reverse_tcp|meterpreter)", ("beacon_interval", "callback_url", "c2_server", "exfil_endpoint", "reverse_tcp", "meterpreter")),
    ("Data exfiltration", r"(?i)(curl\s+.*(-d|--data)\s+@|curl\s+.*--post-file|wget\s+.*--post-file|tar\s+.*\|\s*(nc|curl|wget))", ("curl", "wget", "tar")),
]
# Signatures: name, pattern (RE2), needed literals.
_SIGNATURES = [
    ("obfuscated_eval_comment", r"(?i)e\s*/\*[^*]*\*/\s*v\s*/\*[^*]*\*/\s*a\s*/\*[^*]*\*/\s*l", ("*/",)),
    ("obfuscated_exec_comment", r"(?i)e\s*/\*[^*]*\*/\s*x\s*/\*[^*]*\*/\s*e\s*/\*[^*]*\*/\s*c", ("*/",)),
    ("obfuscated_system_comment", r"(?i)s\s*/\*[^*]*\*/\s*y\s*/\*[^*]*\*/\s*s\s*/\*[^*]*\*/\s*t\s*/\*[^*]*\*/\s*e\s*/\*[^*]*\*/\s*m", ("*/",)),
    ("hex_escaped_eval", r"\\x65\\x76\\x61\\x6[cC]", ("\\x65",)),
    ("hex_escaped_exec", r"\\x65\\x78\\x65\\x63", ("\\x65",)),
    ("hex_escaped_system", r"\\x73\\x79\\x73\\x74\\x65\\x6d", ("\\x73",)),
    ("string_concat_eval", r"""["']e["']\s*\+\s*["']v["']\s*\+\s*["']a["']\s*\+\s*["']l["']""", ("+",)),
    ("string_concat_exec", r"""["']e["']\s*\+\s*["']x["']\s*\+\s*["']e["']\s*\+\s*["']c["']""", ("+",)),
    ("reverse_shell_bash", r"(?i)bash\s+-i\s+>&\s*/dev/tcp/", ("/dev/tcp/",)),
    ("reverse_shell_python", r"""(?i)python[23]?\s+-c\s+['"](import\s+socket|import\s+subprocess)""", ("python",)),
    ("reverse_shell_perl", r"(?i)perl\s+-e\s+'use\s+Socket", ("perl",)),
    ("reverse_shell_ruby", r"(?i)ruby\s+-rsocket\s+-e", ("-rsocket",)),
    ("reverse_shell_nc", r"(?i)(nc|ncat|netcat)\s+(-e\s+/bin/(ba)?sh|-c\s+/bin/(ba)?sh)", ("/bin/",)),
    ("reverse_shell_php", r"(?i)(php\s+-r\s+'.*fsockopen|<\?php.*fsockopen.*exec)", ("fsockopen",)),
    ("cred_harvest_shadow", r"(?i)cat\s+/etc/shadow", ("/etc/shadow",)),
    ("cred_harvest_passwd", r"(?i)cat\s+/etc/passwd", ("/etc/passwd",)),
    ("cred_harvest_ssh_keys", r"(?i)(cat|cp|scp)\s+.*\.ssh/(id_rsa|id_ed25519|authorized_keys)", (".ssh/",)),
    ("cred_harvest_aws", r"(?i)(cat|cp)\s+.*\.aws/(credentials|config)", (".aws/",)),
    ("cred_harvest_env", r"(?i)env\s*\|\s*grep\s+.*(key|secret|token|password)", ("grep",)),
    ("cryptominer_xmrig", r"(?i)xmrig", ("xmrig",)),
    ("cryptominer_stratum", r"(?i)stratum\+tcp://", ("stratum+tcp://",)),
    ("cryptominer_pool", r"(?i)(pool\.(minergate|supportxmr|hashvault)|nanopool\.org)", ("pool.",)),
    ("exfil_base64_file", r"(?i)base64\s+(/etc/(passwd|shadow|hosts)|~/.ssh/)", ("base64",)),
    ("exfil_curl_post", r"(?i)curl\s+.*(-X\s+POST|--data)\s+.*@", ("curl",)),
    ("exfil_dns_tunnel", r"(?i)nslookup\s+.*\$\(|dig\s+.*\$\(", ("$(",)),
    ("c2_cobalt_strike", r"(?i)(cobaltstrike|beacon\.dll|artifact\.exe)", ("cobaltstrike", "beacon.dll", "artifact.exe")),
    ("c2_metasploit", r"(?i)(msfconsole|msfvenom|meterpreter)", ("msfconsole", "msfvenom", "meterpreter")),
    ("c2_empire", r"(?i)(powershell-empire|invoke-empire)", ("-empire",)),
]
# Magic bytes (hex), archive headers (hex), decoded keywords and limits.
MAGICS = (
    ("PE executable", "4D5A"),
    ("ELF executable", "7F454C46"),
    ("Mach-O executable (32-bit)", "FEEDFACE"),
    ("Mach-O executable (64-bit)", "FEEDFACF"),
    ("Mach-O universal / Java class", "CAFEBABE"),
    ("shell script", "23212F"),
    ("Python script", "23212F7573722F62696E2F656E7620707974686F6E"),
    ("COM executable", "E9"),
)
ZIP_MAGIC = "504B0304"
GZIP_MAGIC = "1F8B"
DANGEROUS_KEYWORDS = (
    "eval", "exec", "system", "import os", "subprocess", "/bin/sh", "/bin/bash",
    "__import__", "os.system", "exec(", "eval(",
)
ENTROPY_THRESHOLD = 7.0
ENTROPY_MIN_BYTES = 256
MAX_DECODED_SIZE = 10 * 1024 * 1024
BOMB_RATIO = 100

SCRIPTS = tuple(
    Rule("malware", "script_detection", p, name=name, needs=needs, view="lower") for name, p, needs in _SCRIPTS
)
SIGNATURES = tuple(
    Rule("malware", "signature_match", p, name=name, needs=needs) for name, p, needs in _SIGNATURES
)
PACK = SCRIPTS + SIGNATURES
CHECKS = ("script_detection", "signatures", "magic_bytes", "entropy", "archive_safety")
