"""Policies as plain data: what to allow, what to scan, what to do with a finding."""

from __future__ import annotations

from dataclasses import dataclass, field

from agentguard.functions.regex import check_user_pattern
from agentguard.rules import malware
from agentguard.rules.model import Rule

ALLOW, DENY = "allow", "deny"
MAX_MESSAGE_BYTES = 1024 * 1024
SIEM_MIN_SEVERITY = 4


@dataclass(frozen=True)
class VulnScan:
    rules: tuple[str, ...] = ()
    exclude_tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class InjectionScan:
    scan_requests: bool = True
    scan_responses: bool = True
    sensitivity: str = "medium"
    trusted_response_tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class MalwareScan:
    checks: tuple[str, ...] = malware.CHECKS
    entropy_threshold: float = malware.ENTROPY_THRESHOLD
    max_decoded_size: int = malware.MAX_DECODED_SIZE


@dataclass(frozen=True)
class SecretsScan:
    scan_requests: bool = True
    scan_responses: bool = True
    action: str = "block"
    rules: tuple[str, ...] = ()
    exclude_tools: tuple[str, ...] = ()
    custom: tuple[Rule, ...] = ()


@dataclass(frozen=True)
class PiiScan:
    scan_requests: bool = True
    scan_responses: bool = True
    action: str = "redact"
    rules: tuple[str, ...] = ()
    exclude_tools: tuple[str, ...] = ()
    min_confidence: str = "medium"


@dataclass(frozen=True)
class ChannelPolicy:
    allowed_tools: tuple[str, ...] = ()
    blocked_tools: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    """One policy. A scanner left at None is off."""

    default_action: str = DENY
    allowlist: tuple[str, ...] = ()
    denylist: tuple[str, ...] = ()
    arg_filters: tuple[tuple[str, str], ...] = ()
    domain_allowlist: tuple[str, ...] = ()
    evaluation_timeout_ms: int = 0
    max_message_bytes: int = MAX_MESSAGE_BYTES
    vuln_scan: VulnScan | None = None
    prompt_injection: InjectionScan | None = None
    malware_scan: MalwareScan | None = None
    secrets_scan: SecretsScan | None = None
    pii_scan: PiiScan | None = None
    agent_allowlist: tuple[str, ...] = ()
    channels: dict[str, ChannelPolicy] = field(default_factory=dict)
    siem_enabled: bool = False
    siem_min_severity: int = SIEM_MIN_SEVERITY

    def __post_init__(self):
        if self.default_action not in (ALLOW, DENY):
            raise ValueError(f"invalid default_action {self.default_action!r}: must be 'allow' or 'deny'")
        self.effective_arg_filters()

    def effective_arg_filters(self) -> dict[str, str]:
        """One regex per tool: a later filter replaces an earlier one. An invalid one is an error: skipping it would allow what it denies."""
        return {tool: check_user_pattern(regex) for tool, regex in self.arg_filters}
