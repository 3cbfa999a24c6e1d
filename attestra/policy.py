"""The whole risk policy in one place, passed as a parameter to every operator."""

from __future__ import annotations

from dataclasses import dataclass, field

ALLOW, STEP_UP, BLOCK = "ALLOW", "STEP_UP", "BLOCK"
DECISIONS = (ALLOW, STEP_UP, BLOCK)

# Points per rule.
RULE_POINTS = {
    "CREDENTIAL_STUFFING_BURST": 25,
    "VELOCITY_IP_MEDIUM": 12,
    "VELOCITY_ACCOUNT_SPREAD": 20,
    "VELOCITY_FAILED_LOGINS": 15,
    "IP_FLAGGED": 20,
    "DEVICE_FLAGGED": 15,
    "DEVICE_SHARED_HIGH": 8,
    "IMPLAUSIBLE_AGE": 15,
    "PHONE_RESIDENCE_MISMATCH": 10,
    "DISPOSABLE_EMAIL": 10,
    "NAME_MISMATCH_DOCUMENT": 15,
    "CROSS_RECORD_CLUSTER_LARGE": 40,
    "CROSS_RECORD_CLUSTER_MEDIUM": 30,
    "CROSS_RECORD_CLUSTER_SMALL": 5,
    "LINKED_TO_BLOCKED_STRONG": 25,
    "LINKED_TO_BLOCKED_WEAK": 10,
    "DOCUMENT_ELA_ANOMALY": 20,
    "DOCUMENT_METADATA_EDITOR": 12,
    "DOCUMENT_METADATA_MISSING": 8,
    "DOCUMENT_REUSE": 25,
    "LIVENESS_FAILED": 12,
    "CREDENTIAL_FAILED": 10,
    "MODEL_RISK": 0,
}

# Rules that force a minimum score.
SCORE_FLOORS = {
    "CREDENTIAL_STUFFING_BURST": 70,
    "DOCUMENT_REUSE": 70,
    "LINKED_TO_BLOCKED_STRONG": 70,
}

# Which rules speak for which kind of attack, in tie-break order.
ATTACK_RULES = {
    "CREDENTIAL_STUFFING": (
        "CREDENTIAL_STUFFING_BURST", "VELOCITY_IP_MEDIUM", "VELOCITY_ACCOUNT_SPREAD",
        "VELOCITY_FAILED_LOGINS", "CREDENTIAL_FAILED"),
    "SYNTHETIC_IDENTITY": (
        "CROSS_RECORD_CLUSTER_LARGE", "CROSS_RECORD_CLUSTER_MEDIUM",
        "CROSS_RECORD_CLUSTER_SMALL", "IMPLAUSIBLE_AGE", "PHONE_RESIDENCE_MISMATCH",
        "DISPOSABLE_EMAIL", "NAME_MISMATCH_DOCUMENT", "LINKED_TO_BLOCKED_STRONG",
        "LINKED_TO_BLOCKED_WEAK"),
    "DOCUMENT_FRAUD": (
        "DOCUMENT_ELA_ANOMALY", "DOCUMENT_METADATA_EDITOR", "DOCUMENT_METADATA_MISSING",
        "DOCUMENT_REUSE"),
}

# Throw-away mail domains.
DISPOSABLE_DOMAINS = (
    "mailinator.com", "tempmail.com", "guerrillamail.com", "10minutemail.com",
    "throwaway.email", "yopmail.com", "trashmail.com", "sharklasers.com",
)

# Residence country to dialling prefix; the first match in this order wins.
COUNTRY_PREFIX = {
    "UAE": "+971", "India": "+91", "UK": "+44",
    "Egypt": "+20", "Philippines": "+63", "Pakistan": "+92",
}

# Software names that mark an edited document.
EDITOR_SIGNATURES = (
    "photoshop", "gimp", "paint.net", "affinity", "pixelmator",
    "illustrator", "inkscape", "canva", "acrobat", "imagemagick",
)


@dataclass(frozen=True)
class Policy:
    step_up_score: int = 30
    block_score: int = 70
    rule_weight: float = 0.70
    model_weight: float = 0.30

    velocity_seconds: int = 60
    velocity_high: int = 10
    velocity_medium: int = 5
    spread_seconds: int = 300
    spread_accounts: int = 5
    failed_seconds: int = 300
    failed_logins: int = 3

    device_identities: int = 3
    cluster_identities: int = 2
    min_age: int = 16
    max_age: int = 100
    name_similarity: float = 0.80
    anomaly_threshold: float = 6.0

    points: dict = field(default_factory=lambda: dict(RULE_POINTS))
    floors: dict = field(default_factory=lambda: dict(SCORE_FLOORS))
    attack_rules: dict = field(default_factory=lambda: dict(ATTACK_RULES))
    disposable_domains: tuple = DISPOSABLE_DOMAINS
    country_prefix: dict = field(default_factory=lambda: dict(COUNTRY_PREFIX))


FALLBACK_ANOMALY_THRESHOLD = 10.8


@dataclass(frozen=True)
class Skew:
    """When a key counts as hot, and how large one task's share of it may be.

    A key with more than ``hot_rows`` rows is cut into blocks of ``block_rows`` consecutive
    rows of the total order. ``cluster_rows`` bounds one replay group of the as-of clusters.
    """

    hot_rows: int = 4_000_000
    block_rows: int = 4_000_000
    cluster_rows: int = 250_000
    broadcast_values: int = 100_000     # a longer list of hot keys is joined without a broadcast hint
