"""Prompt-injection rules. All run on lower-cased, NFKC-normalised text."""

from agentguard.rules.model import NON_ASCII, Rule

# Patterns (RE2) with the literals each needs.
_ROLE_OVERRIDE = [
    (r"(?i)ignore\s+(all\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|directions?)", ("ignore",)),
    (r"(?i)you\s+are\s+now\s+(a|an|the)\b", ("now",)),
    (r"(?i)system\s*:\s*you\s+are", ("system",)),
    (r"(?i)<\|im_start\|>\s*system", ("<|im_start|>",)),
    (r"(?i)\[system\]\s*#", ("[system]",)),
    (r"(?i)new\s+role\s*:\s", ("role",)),
    (r"(?i)forget\s+(everything|all|your)\s+(you|instructions?|rules?)", ("forget",)),
    (r"(?i)override\s+(your|system|all)\s+\w*\s*(instructions?|rules?|prompts?)", ("override",)),
    (r"(?i)act\s+as\s+(a|an|the)\s+", ("act",)),
    (r"(?i)behave\s+(like|as)\s+(a|an|the)?\s*", ("behave",)),
    (r"(?i)pretend\s+(to\s+be|you'?re?)\s+", ("pretend",)),
    (r"(?i)roleplay\s+as\s+", ("roleplay",)),
    (r"(?i)take\s+on\s+the\s+role\s+of", ("take",)),
    (r"(?i)from\s+now\s+on,?\s+you\s+(are|will|shall|must)", ("from",)),
]
# Instruction injection: pattern (RE2), needed literals.
_INSTRUCTION = [
    (r"(?i)do\s+not\s+follow\s+(the|your|any)\s+(previous|original|above)", ("follow",)),
    (r"(?i)disregard\s+(all|any|the|previous|your)\s+\w*\s*(instructions?|rules?|prompts?)", ("disregard",)),
    (r"(?i)instead\s*,?\s*(you\s+)?(should|must|will|shall)\s", ("instead",)),
    (r"(?i)new\s+instructions?\s*:\s", ("instruction",)),
    (r"(?i)actual\s+instructions?\s*:\s", ("instruction",)),
    (r"(?i)real\s+instructions?\s*:\s", ("instruction",)),
    (r"(?i)secret\s+instructions?\s*:\s", ("instruction",)),
    (r"(?i)hidden\s+instructions?\s*:\s", ("instruction",)),
]
# Encoding attacks: pattern (RE2), needed literals. The exotic-space class can never hit: NFKC
# folds those characters to a plain space.
_ENCODING = [
    (r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ()),
    (r"[\x{E0001}-\x{E007F}]", ()),
    (r"[\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", ()),
]
# Delimiter injection: pattern (RE2), needed literals. The second pattern asks for a literal
# backslash in the version number, so it misses real frames; a rule of one's own can look for them.
_DELIMITER = [
    (r"(?i)`{3,}\s*(tool_output|tool_result|function_result|assistant|system)", ("```",)),
    (r"""(?i)\{\"jsonrpc\"\s*:\s*\"2\\.0\"\s*,\s*\"result\"""", ('{"jsonrpc"',)),
    (r"(?i)(END_TOOL_OUTPUT|END_FUNCTION_CALL|<\/tool_response>|<\/function_output>)", ("end_", "</")),
    (r"(?i)use\s+the\s+[\w-]+\s+action", ("action",)),
    (r"(?i)(create|delete|send|post)\s+(a\s+)?(jira|confluence|slack|github)\s+(issue|page|message)", ("jira", "confluence", "slack", "github")),
]

# Keywords of decoded base64 payloads, and imperative sentence starts.
BASE64_KEYWORDS = (
    "ignore previous", "you are now", "system:", "new instructions",
    "disregard", "override", "forget everything",
)
IMPERATIVE_STARTS = (
    "ignore", "forget", "disregard", "override", "execute", "run",
    "output", "print", "return", "respond", "reply", "say",
    "pretend", "act", "behave", "assume", "do not", "never",
    "always", "must", "shall", "reveal", "expose", "leak",
    "extract", "exfiltrate", "send", "post", "transmit",
)
BASE64_PATTERN = r"[A-Za-z0-9+/]{40,}={0,2}"
BASE64_GUARD = r"[A-Za-z0-9+/]{40}"
#: A run can only start where the previous character is outside the class: linear on the JVM.
BASE64_JAVA = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40,}+={0,2}"
IMPERATIVE_MIN_BYTES = 100
IMPERATIVE_MIN_SEGMENTS = 3
IMPERATIVE_RATIO = 0.4
ENTROPY_WINDOW = 100
ENTROPY_STEP = 50
ENTROPY_MIN_NONSPACE = 60
ENTROPY_LIMIT = 5.5


def _rules(rule_id, pairs):
    return [
        Rule("injection", rule_id, pattern, needs=needs, view="nfkc_lower", guard=None if needs else NON_ASCII)
        for pattern, needs in pairs
    ]


PACK = (
    *_rules("role_override", _ROLE_OVERRIDE),
    *_rules("instruction_injection", _INSTRUCTION),
    *_rules("encoding_attack", _ENCODING),
    *_rules("delimiter_injection", _DELIMITER),
)
#: What a text needs for a base64 run, or for a segment that begins with an imperative.
BASE64_RUN = Rule("injection", "base64_run", BASE64_GUARD)
IMPERATIVE_START = Rule(
    "injection", "imperative_start", r"(?:^|[.!\n])[\t-\r \x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]*(?:" + "|".join(IMPERATIVE_STARTS) + ")",
    view="nfkc_lower")
#: Reason prefix of each rule group.
REASONS = {
    "role_override": "role override attempt detected",
    "instruction_injection": "instruction injection detected",
    "encoding_attack": "encoding attack detected",
    "delimiter_injection": "delimiter injection detected",
}
