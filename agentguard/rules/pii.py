"""Personal-data rules, in order of evaluation."""

from agentguard.functions.regex import WORD
from agentguard.rules.model import THREE_DIGITS, Rule, snake_case

CONFIDENCE_RANK = {"low": 1, "medium": 2, "high": 3}

# An address can only start at the start of a local-part run (or where the last hit ended).
_EMAIL_JAVA = r"(?:(?<![a-zA-Z0-9._%+\-])|\G)[a-zA-Z0-9._%+\-]++@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
# The first test at every position is for a digit; an address surely ends in one.
_IPV4_JAVA = rf"(?=\d)(?<![{WORD}])(?:{_OCTET}\.){{3}}{_OCTET}(?![{WORD}])"
_JAVA = {"email": _EMAIL_JAVA, "ip_address": _IPV4_JAVA}
_GUARDS = {
    "ssn": THREE_DIGITS,
    "credit_card": THREE_DIGITS,
    "phone": "[0-9]",
    "passport": THREE_DIGITS,
    "ip_address": r"[0-9]\.[0-9]",
    "date_of_birth": "[0-9]",
    "postal_address": "[0-9]",
    "iban": "[A-Z]{2}[0-9]{2}",
}

# Name, category, pattern (RE2), description, confidence, validator, needed literals.
_TABLE = [
    ("Email Address", "email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "email address", "high", None, ("@",)),
    ("US Phone Number", "phone", r"(?:^|[^0-9])(?:\+?1[-.\s]?)?\(?[2-9]\d{2}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?:[^0-9]|$)", "US phone number", "medium", None, ()),
    ("International Phone Number (E.164)", "phone", r"\+[1-9]\d{6,14}", "international phone number (E.164 format)", "medium", None, ("+",)),
    ("International Phone with Context", "phone", r"(?i)(?:phone|tel|mobile|cell|fax)\s*[:=]?\s*\+?\d[\d\s\-\.\(\)]{7,18}\d", "international phone number with keyword context", "medium", None, ("phone", "tel", "mobile", "cell", "fax")),
    ("US Social Security Number", "ssn", r"(?:^|[^0-9])(?:0[1-9]|[1-5]\d|6[0-5]\d|66[0-5]|66[7-9]|6[7-8]\d|690|7[0-2]\d|73[0-3]|750|76[4-9]|77[0-2])[-\s]?(?:0[1-9]|[1-9]\d)[-\s]?(?:000[1-9]|00[1-9]\d|0[1-9]\d{2}|[1-9]\d{3})(?:[^0-9]|$)", "US Social Security Number (XXX-XX-XXXX)", "high", "ssn", ()),
    ("US SSN (formatted)", "ssn", r"\b\d{3}-\d{2}-\d{4}\b", "US SSN in XXX-XX-XXXX format", "high", "ssn", ("-",)),
    ("Visa Card Number", "credit_card", r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "Visa card number", "high", "luhn", ()),
    ("Mastercard Number", "credit_card", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "Mastercard number", "high", "luhn", ()),
    ("Amex Card Number", "credit_card", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b", "American Express card number", "high", "luhn", ()),
    ("Discover Card Number", "credit_card", r"\b6(?:011|5\d{2})[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "Discover card number", "high", "luhn", ()),
    ("IPv4 Address", "ip_address", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", "IPv4 address", "low", "public_ipv4", (".",)),
    ("US Passport Number", "passport", r"(?i)(?:passport|travel\s*doc(?:ument)?)\s*(?:no|number|#|num)?\s*[:=]?\s*[A-Z]?\d{8,9}\b", "US passport number", "medium", None, ("passport", "travel")),
    ("International Passport Number", "passport", r"(?i)(?:passport|travel\s*doc(?:ument)?)\s*(?:no|number|#|num)?\s*[:=]?\s*[A-Z]{1,2}\d{6,9}", "international passport number", "medium", None, ("passport", "travel")),
    ("Date of Birth", "date_of_birth", r"(?i)(?:dob|date\s*of\s*birth|birth\s*date|born)\s*[:=]?\s*(?:\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{2,4}|\d{4}[/\-\.]\d{1,2}[/\-\.]\d{1,2})", "date of birth", "high", None, ("dob", "birth", "born")),
    ("US ZIP Code with Context", "postal_address", r"(?i)(?:zip|postal|address)\s*[:=]?\s*\d{5}(?:-\d{4})?", "US ZIP code with address context", "medium", None, ("zip", "postal", "address")),
    ("US Street Address", "postal_address", r"\b\d{1,5}\s+(?:[A-Z][a-z]+\s+){1,3}(?:St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Rd|Road|Ct|Court|Pl(?:ace)?|Way|Cir(?:cle)?)\b", "US street address", "medium", None, ()),
    ("IBAN Number", "iban", r"\b[A-Z]{2}\d{2}\s?(?:[A-Z0-9]{4}\s?){3,7}[A-Z0-9]{1,4}\b", "International Bank Account Number (IBAN)", "high", "iban", ()),
    ("Driver's License Reference", "drivers_license", r"(?i)(?:driver'?s?\s*lic(?:ense|ence)?|DL)\s*(?:no|number|#|num)?\s*[:=]\s*[A-Z0-9]{5,15}", "driver's license number reference", "medium", None, ("driver", "dl")),
]

PACK = tuple(
    Rule(
        "pii", snake_case(name), pattern, name=name, category=category, confidence=confidence,
        validator=validator, needs=needs, note=description,
        java=_JAVA.get(category),
        guard=THREE_DIGITS if name in ("US Phone Number", "International Phone Number (E.164)") else _GUARDS.get(category),
    )
    for name, category, pattern, description, confidence, validator, needs in _TABLE
)
CATEGORIES = tuple(dict.fromkeys(r.category for r in PACK))


def placeholder(rule: Rule) -> str:
    """Text that takes the place of a hit."""
    return f"[{rule.category.upper()}_REDACTED]"


def select(categories=(), min_confidence: str = "low") -> tuple[Rule, ...]:
    """The pack restricted to some categories (none named means all) and a confidence floor."""
    floor = CONFIDENCE_RANK[min_confidence]
    return tuple(
        r for r in PACK
        if (not categories or r.category in categories) and CONFIDENCE_RANK[r.confidence] >= floor
    )
