"""Names and types shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

FEATURES = [
    "velocity_ip_count", "velocity_account_spread", "failed_login_count", "ip_flagged",
    "device_identity_count", "device_flagged", "attribute_flags", "cluster_identity_count",
    "cluster_binding_kinds", "cluster_has_blocked", "document_reuse_count", "ela_score",
    "metadata_flag", "liveness_failed", "credential_failed",
]

REASON = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("points", T.IntegerType()),
    T.StructField("layer", T.StringType()),
])

ATTEMPT = T.StructType([
    T.StructField("record_id", T.LongType()),
    T.StructField("attempt_ref", T.StringType()),
    T.StructField("claimed_user_ref", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("sec", T.LongType()),
    T.StructField("stage", T.StringType()),
    T.StructField("ip_address", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("phone", T.StringType()),
    T.StructField("address", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("full_name", T.StringType()),
    T.StructField("date_of_birth", T.StringType()),
    T.StructField("nationality", T.StringType()),
    T.StructField("document_name", T.StringType()),
    T.StructField("document_hash", T.StringType()),
    T.StructField("ela_score", T.DoubleType()),
    T.StructField("metadata_flags", T.ArrayType(T.StringType())),
    T.StructField("has_forensics", T.BooleanType()),
    T.StructField("document_status", T.StringType()),
    T.StructField("liveness_status", T.StringType()),
    T.StructField("login_status", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("label_category", T.StringType()),
    T.StructField("label_is_fraud", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

RESULT_COLUMNS = [
    "record_id", "user_ref", "normalized_timestamp", "risk_score", "decision",
    "predicted_attack", "fraud_probability", "rule_score", "top_reasons", "status",
    "error_reason",
]

LINK_KINDS = ("device_id", "ip_address", "phone", "address", "document_hash")
STRONG_KINDS = ("document_hash", "phone")
WEAK_KINDS = ("ip_address", "device_id", "address")
UNCLUSTERED_KINDS = ("ip_address",)
# One bit per clustering kind, in the alphabetical order used in reason texts.
KIND_BITS = {"address": 1, "device_id": 2, "document_hash": 4, "phone": 8}
STRONG_MASK = KIND_BITS["document_hash"] | KIND_BITS["phone"]

DEFAULTS = {
    "stage": "ONBOARDING", "document_status": "NOT_SUBMITTED",
    "liveness_status": "NOT_SUBMITTED", "login_status": "NOT_SUBMITTED",
    "scenario": "UNKNOWN",
}


def attempt_ref(record_id: Column) -> Column:
    """EVAL- and the record's number in at least six digits. Formatting by pattern is slow, so it is left to
    numbers that are negative or missing."""
    digits = record_id.cast("long").cast("string")
    return F.when(record_id >= 1_000_000, F.concat(F.lit("EVAL-"), digits)) \
        .when(record_id >= 0, F.concat(F.lit("EVAL-"), F.lpad(digits, 6, "0"))) \
        .otherwise(F.format_string("EVAL-%06d", record_id))


def conform(df: DataFrame) -> DataFrame:
    """Bring any frame to the canonical attempt columns; missing ones become NULL or default.

    Extra columns are kept behind the canonical ones.
    """
    have = set(df.columns)
    cols = []
    for f in ATTEMPT.fields:
        if f.name in have:
            c = F.col(f.name).cast(f.dataType)
        elif f.name == "sec" and "ts" in have:
            c = F.unix_timestamp(F.col("ts").cast("timestamp"))
        elif f.name == "has_forensics" and have & {"ela_score", "document_hash"}:
            parts = [F.col(n).isNotNull() for n in ("ela_score", "document_hash") if n in have]
            c = parts[0] if len(parts) == 1 else parts[0] | parts[1]
        elif f.name == "attempt_ref" and "record_id" in have:
            c = attempt_ref(F.col("record_id"))
        else:
            c = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        cols.append(c.alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in ATTEMPT.names]
    return df.select(*cols, *extra)
