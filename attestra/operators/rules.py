"""The rule chain (R1-R23), each rule a condition, a point value and a text, all of them Columns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from attestra.functions.text import email_domain
from attestra.policy import Policy
from attestra.schema import KIND_BITS, STRONG_MASK

# Reason texts, as analysts see them.
TEXTS = {
    "CREDENTIAL_STUFFING_BURST": "%d attempts from this IP within %ds",
    "VELOCITY_IP_MEDIUM": "%d attempts from this IP within %ds",
    "VELOCITY_ACCOUNT_SPREAD": "One IP targeted %d different accounts in %d minutes",
    "VELOCITY_FAILED_LOGINS": "%d failed logins against this account in %d minutes",
    "IP_FLAGGED": "IP previously involved in blocked attempts (produced a blocked attempt)",
    "DEVICE_FLAGGED": "Device previously involved in blocked attempts",
    "DEVICE_SHARED_HIGH": "Device has been used by %d different identities",
    "IMPLAUSIBLE_AGE": "Date of birth implies an age of %d",
    "PHONE_RESIDENCE_MISMATCH": "Phone country differs from declared residence (%s)",
    "DISPOSABLE_EMAIL": "Email uses a disposable domain (%s)",
    "NAME_MISMATCH_DOCUMENT":
        "Name on document does not match the submitted name (similarity %.0f%%)",
    "CLUSTER": "%d identities linked by %s: %s",
    "LINKED_TO_BLOCKED_STRONG": "Shares %s with an identity that was previously blocked",
    "LINKED_TO_BLOCKED_WEAK": "Shares a %s with a previously blocked identity - weak on its own, as"
                              " devices and addresses are shared legitimately",
    "DOCUMENT_ELA_ANOMALY": "Compression analysis shows a region inconsistent with the rest of the"
                            " document (score %.1f, threshold %.1f)",
    "DOCUMENT_REUSE":
        "This exact document was already presented by %d other identity/identities (%s)",
    "LIVENESS_FAILED": "Liveness check did not pass",
    "CREDENTIAL_FAILED": "Credential check failed",
    "MODEL_RISK": "Model estimates %.0f%% probability of fraud (driven by: %s)",
}
# Verdicts inside the cluster texts, and the words that mark an editor in a metadata flag.
LARGE_VERDICT = "identifiers that should be unique to one person"
STRONG_VERDICT = "an identifier that should be unique to one person"
PAIR_VERDICT = "two independent identifiers"
SMALL_VERDICT = ("a single shared device or address, which households and public kiosks do"
                 " legitimately")
EDITOR_MARK = "editing software"


@dataclass(frozen=True)
class Earlier:
    """A dependency on earlier decisions: column ``name`` tells whether at least ``at_least`` earlier attempts with the same
    value of column ``key`` ended in BLOCK. Attempts without a value have no such history."""

    name: str
    key: str
    at_least: int = 1


IP, DEVICE = Earlier("ip_flagged", "ip_address"), Earlier("device_flagged", "device_id")
CLUSTER = Earlier("cluster_has_blocked", "vid")      # of *another* identity in the cluster as of the attempt


@dataclass(frozen=True)
class Rule:
    """``feedback`` marks rules that read decisions of earlier attempts. Add your own to extend.

    A feedback rule lists in ``needs`` which earlier decisions it reads; its condition uses the columns these name.
    """

    name: str
    when: Column
    text: Column
    feedback: bool = False
    layer: str = "RULE"
    needs: tuple[Earlier, ...] = ()

    def fired(self) -> Column:
        return F.coalesce(self.when, F.lit(False))

    def content(self, policy: Policy) -> Column:
        return F.struct(F.lit(self.name).alias("rule"), self.text.cast("string").alias("description"),
                        F.lit(policy.points.get(self.name, 0)).cast("int").alias("points"),
                        F.lit(self.layer).alias("layer"))


def kind_names(mask: Column, joiner: str = ", ") -> Column:
    return F.array_join(F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(bit) != 0, F.lit(kind.replace("_", " ")))
        for kind, bit in KIND_BITS.items()])), joiner)


def _text(name: str, *args) -> Column:
    return _filled(TEXTS[name], *args)


def _filled(template: str, *args) -> Column:
    """The template with its places filled in. Whole numbers and texts are put together; only decimals need the slower formatting."""
    if not args:
        return F.lit(template)
    args = [a if isinstance(a, Column) else F.lit(a) for a in args]
    between = re.split("%[ds]", template)
    if len(between) != len(args) + 1 or "%" in "".join(between):
        return F.format_string(template, *args)
    parts = [F.lit(between[0])]
    for a, after in zip(args, between[1:]):
        parts += [F.coalesce(a.cast("string"), F.lit("null")), F.lit(after)]
    return F.concat(*parts)


def attribute_rules(p: Policy) -> list[Rule]:
    """Plausibility of one attempt on its own."""
    age, country = F.col("age"), F.col("residence_country")
    prefix = F.lit(None).cast("string")
    for c, code in p.country_prefix.items():
        prefix = F.when(country == c, F.lit(code)).otherwise(prefix)
    phone, domain = F.col("phone_clean"), email_domain(F.col("email"))
    sim = F.col("name_similarity")
    return [
        Rule("IMPLAUSIBLE_AGE", (age < p.min_age) | (age > p.max_age), _text("IMPLAUSIBLE_AGE", age)),
        Rule("PHONE_RESIDENCE_MISMATCH", (phone != "") & ~phone.startswith(prefix),
             _text("PHONE_RESIDENCE_MISMATCH", country)),
        Rule("DISPOSABLE_EMAIL", domain.isin(*p.disposable_domains), _text("DISPOSABLE_EMAIL", domain)),
        Rule("NAME_MISMATCH_DOCUMENT", sim < p.name_similarity,
             _text("NAME_MISMATCH_DOCUMENT", F.bround(sim * 100, 0))),     # half-even, as scores are
    ]


def reputation_rules(p: Policy) -> list[Rule]:
    """R5, R6."""
    return [Rule("IP_FLAGGED", F.col("ip_flagged"), _text("IP_FLAGGED"), feedback=True, needs=(IP,)),
            Rule("DEVICE_FLAGGED", F.col("device_flagged"), _text("DEVICE_FLAGGED"), feedback=True, needs=(DEVICE,))]


def association_rules(p: Policy) -> list[Rule]:
    """R15, R16."""
    mask = F.col("kind_mask")
    firm = (mask.bitwiseAND(STRONG_MASK) != 0) | (F.bit_count(mask) >= 2)
    return [
        Rule("LINKED_TO_BLOCKED_STRONG", F.col("cluster_has_blocked") & firm,
             _text("LINKED_TO_BLOCKED_STRONG", kind_names(mask, " and ")),
             feedback=True, needs=(CLUSTER,)),
        Rule("LINKED_TO_BLOCKED_WEAK", F.col("cluster_has_blocked") & ~firm,
             _text("LINKED_TO_BLOCKED_WEAK", F.when(mask != 0, kind_names(mask)).otherwise(F.lit("connection"))),
             feedback=True, needs=(CLUSTER,))]


def feedback_rules(p: Policy) -> list[Rule]:
    """The rules that read decisions of earlier attempts."""
    return [*reputation_rules(p), *association_rules(p)]


def rule_chain(p: Policy, extra: Iterable[Rule] = ()) -> list[Rule]:
    """All rules in the order in which reasons are listed."""
    v, spread, failed = (F.col(c) for c in ("velocity_ip_count", "velocity_account_spread",
                                            "failed_login_count"))
    device = F.col("device_identity_count")
    size, mask = F.col("cluster_identity_count"), F.col("kind_mask")
    kinds, strong = F.bit_count(mask), mask.bitwiseAND(STRONG_MASK) != 0
    linked = (size >= p.cluster_identities) & (kinds > 0)
    large, medium = strong & (kinds >= 2), strong | (kinds >= 2)
    names = kind_names(mask)

    def cluster(name: str, when: Column, verdict: Column) -> Rule:
        return Rule(name, linked & when, _text("CLUSTER", size, verdict, names))

    ela, flags = F.col("ela_score"), F.col("metadata_flags")
    has = F.col("has_forensics")
    editor = F.filter(flags, lambda f: f.contains(EDITOR_MARK))
    others = F.col("document_other_count")
    return [
        Rule("CREDENTIAL_STUFFING_BURST", v >= p.velocity_high,
             _text("CREDENTIAL_STUFFING_BURST", v, p.velocity_seconds)),
        Rule("VELOCITY_IP_MEDIUM", (v >= p.velocity_medium) & (v < p.velocity_high),
             _text("VELOCITY_IP_MEDIUM", v, p.velocity_seconds)),
        Rule("VELOCITY_ACCOUNT_SPREAD", spread >= p.spread_accounts,
             _text("VELOCITY_ACCOUNT_SPREAD", spread, p.spread_seconds // 60)),
        Rule("VELOCITY_FAILED_LOGINS", failed >= p.failed_logins,
             _text("VELOCITY_FAILED_LOGINS", failed, p.failed_seconds // 60)),
        *reputation_rules(p),
        Rule("DEVICE_SHARED_HIGH", device >= p.device_identities, _text("DEVICE_SHARED_HIGH", device)),
        *attribute_rules(p),
        cluster("CROSS_RECORD_CLUSTER_LARGE", large, F.lit(LARGE_VERDICT)),
        cluster("CROSS_RECORD_CLUSTER_MEDIUM", ~large & medium,
                F.when(strong, F.lit(STRONG_VERDICT)).otherwise(F.lit(PAIR_VERDICT))),
        cluster("CROSS_RECORD_CLUSTER_SMALL", ~medium, F.lit(SMALL_VERDICT)),
        *association_rules(p),
        Rule("DOCUMENT_ELA_ANOMALY", has & (ela >= p.anomaly_threshold),
             _text("DOCUMENT_ELA_ANOMALY", ela, float(p.anomaly_threshold))),
        Rule("DOCUMENT_METADATA_EDITOR", has & (F.size(editor) > 0), F.try_element_at(editor, F.lit(1))),
        Rule("DOCUMENT_METADATA_MISSING", has & (F.size(flags) > 0) & (F.size(editor) == 0),
             F.try_element_at(flags, F.lit(1))),
        Rule("DOCUMENT_REUSE", has & (F.col("document_reuse_count") >= 1) & (others > 0),
             _text("DOCUMENT_REUSE", others,
                   F.coalesce(F.array_join("document_other_names", ", "), F.lit("")))),
        Rule("LIVENESS_FAILED", F.col("liveness_status") == "FAIL", _text("LIVENESS_FAILED")),
        Rule("CREDENTIAL_FAILED", F.col("login_status") == "FAIL", _text("CREDENTIAL_FAILED")),
        *extra,
    ]


def model_rule() -> Rule:
    """Context only, no points; present when a probability is."""
    return Rule("MODEL_RISK", F.col("ml_probability").isNotNull(),
                _text("MODEL_RISK", F.bround(F.col("ml_probability") * 100, 0),
                      F.when(F.length("ml_drivers") > 0, F.col("ml_drivers")).otherwise(F.lit("n/a"))),
                layer="MODEL")


def reasons(rules: Iterable[Rule], policy: Policy) -> Column:
    """The fired rules in order, as arrays of one or none put together: a lambda over all rules would evaluate every text outside of
    generated code."""
    none = F.array().cast("array<struct<rule:string,description:string,points:int,layer:string>>")
    return F.concat(*[F.when(r.fired(), F.array(r.content(policy))).otherwise(none) for r in rules])


def points(rules: Iterable[Rule], policy: Policy) -> Column:
    total = F.lit(0)
    for r in rules:
        if policy.points.get(r.name, 0):
            total = total + F.when(r.fired(), policy.points[r.name]).otherwise(0)
    return total.cast("int")


def floor(rules: Iterable[Rule], policy: Policy) -> Column:
    """Highest floor among the fired rules, 0 if none."""
    low = [F.when(r.fired(), policy.floors[r.name]).otherwise(0)
           for r in rules if r.name in policy.floors]
    return F.greatest(F.lit(0), *low, F.lit(0)).cast("int") if low else F.lit(0)
