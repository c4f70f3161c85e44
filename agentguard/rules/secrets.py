"""Credential rules: our own patterns for the published token formats of each provider."""

from agentguard.rules.model import Rule

_TABLE = [
    ("aws", "aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ("akia", "asia")),
    ("aws", "aws_secret_access_key", r"""(?i)aws_?secret_?(?:access_?)?key\s*[:=]\s*['"]?[A-Za-z0-9/+=]{40}""", ("aws",)),
    ("aws", "aws_session_token", r"""(?i)aws_?session_?token\s*[:=]\s*['"]?[A-Za-z0-9/+=]{40,}""", ("aws",)),
    ("gcp", "gcp_api_key", r"AIza[0-9A-Za-z_\-]{35}", ("aiza",)),
    ("gcp", "gcp_service_account", r'"type"\s*:\s*"service_account"', ("service_account",)),
    ("gcp", "gcp_oauth_client_id", r"[0-9]{6,20}-[0-9a-z]{32}\.apps\.googleusercontent\.com", (".apps.googleusercontent.com",)),
    ("azure", "azure_storage_key", r"AccountKey=[A-Za-z0-9+/]{86}==", ("accountkey=",)),
    ("azure", "azure_client_secret", r"""(?i)azure[a-z_\-]{0,20}secret\s*[:=]\s*['"]?[A-Za-z0-9~._\-]{34,40}""", ("azure",)),
    ("github", "github_personal_access_token", r"ghp_[A-Za-z0-9]{36,}", ("ghp_",)),
    ("github", "github_oauth_token", r"gho_[A-Za-z0-9]{36,}", ("gho_",)),
    ("github", "github_app_token", r"gh[usr]_[A-Za-z0-9]{36,}", ("ghu_", "ghs_", "ghr_")),
    ("github", "github_fine_grained_token", r"github_pat_[A-Za-z0-9_]{22,}", ("github_pat_",)),
    ("gitlab", "gitlab_personal_access_token", r"glpat-[A-Za-z0-9_\-]{20,}", ("glpat-",)),
    ("gitlab", "gitlab_pipeline_token", r"glptt-[A-Za-z0-9_\-]{20,}", ("glptt-",)),
    ("slack", "slack_bot_token", r"xoxb-[0-9]{10,}-[A-Za-z0-9\-]{20,}", ("xoxb-",)),
    ("slack", "slack_user_token", r"xoxp-[0-9]{10,}-[A-Za-z0-9\-]{20,}", ("xoxp-",)),
    ("slack", "slack_webhook_url", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+", ("hooks.slack.com",)),
    ("stripe", "stripe_api_key", r"sk_(?:live|test)_[0-9A-Za-z]{16,}", ("sk_",)),
    ("stripe", "stripe_restricted_key", r"rk_(?:live|test)_[0-9A-Za-z]{16,}", ("rk_",)),
    ("atlassian", "atlassian_api_token", r"ATATT3x[A-Za-z0-9_\-]{20,}", ("atatt3x",)),
    ("jwt", "jwt_token", r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", ("eyj",)),
    ("private_key", "private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----", ("-----begin",)),
    ("database", "database_url", r"""(?i)(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis)://[^\s:@/]*:[^\s@/]+@[^\s/"']+""", ("://",)),
    ("generic_api", "sendgrid_api_key", r"SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}", ("sg.",)),
    ("generic_api", "twilio_api_key", r"\bSK[0-9a-f]{32}\b", ("sk",)),
    ("generic_api", "mailgun_api_key", r"\bkey-[0-9a-f]{32}\b", ("key-",)),
    ("generic_api", "npm_token", r"npm_[A-Za-z0-9]{36}", ("npm_",)),
    ("generic_api", "pypi_token", r"pypi-[A-Za-z0-9_\-]{50,}", ("pypi-",)),
    ("generic_api", "heroku_api_key", r"(?i)heroku[a-z_ ]{0,16}[:=]\s*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", ("heroku",)),
    ("generic_api", "datadog_api_key", r"(?i)(?:datadog|dd)_(?:api|app)_key\s*[:=]\s*[0-9a-f]{32,40}", ("_key",)),
    ("generic_api", "bearer_token", r"(?i)bearer\s+[A-Za-z0-9._~+/\-]{20,}=*", ("bearer",)),
    ("generic_api", "generic_credential", r"""(?i)(?:api_?key|access_?token|auth_?token|client_?secret|secret|token)\s*[:=]\s*['"]?[A-Za-z0-9/+._\-]{20,}""", ("key", "token", "secret")),
]

PACK = tuple(
    Rule("secrets", rule_id, pattern, name=rule_id, category=category, needs=needs, note=rule_id.replace("_", " "))
    for category, rule_id, pattern, needs in _TABLE
)
CATEGORIES = tuple(dict.fromkeys(r.category for r in PACK))
PLACEHOLDER = "[REDACTED]"


def select(categories=(), extra=()) -> tuple[Rule, ...]:
    """The pack restricted to some categories, with user rules appended."""
    return tuple(r for r in PACK if not categories or r.category in categories) + tuple(extra)
