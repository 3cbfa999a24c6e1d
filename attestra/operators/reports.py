"""Console reports and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions.text import mask_pii
from attestra.operators.score import ranked_reasons
from attestra.policy import ALLOW, BLOCK, STEP_UP, Policy


def filter_attempts(df: DataFrame, decision: str | None = None, scenario: str | None = None) -> DataFrame:
    """F1."""
    if decision:
        df = df.filter(F.col("decision") == decision)
    return df.filter(F.col("scenario") == scenario) if scenario else df


def attempt_by_ref(df: DataFrame, ref: str) -> DataFrame:
    """F2."""
    return df.filter(F.col("attempt_ref") == ref)


def user_by_ref(users: DataFrame, ref: str) -> DataFrame:
    return users.filter(F.col("user_ref") == ref)


def user_by_email(users: DataFrame, email: str | None) -> DataFrame:
    return users.filter(F.lower("email") == F.lower(F.lit(email or None)))


def staff_by_identifier(staff: DataFrame, identifier: str | None) -> DataFrame:
    """by e-mail in any case, or by exact staff reference."""
    who = F.lit(identifier or None)
    return staff.filter((F.lower("email") == F.lower(who)) | (F.col("employee_ref") == who))


def decision_totals(df: DataFrame) -> DataFrame:
    """A1."""
    return df.agg(F.count("*").alias("total"), *[
        F.count_if(F.col("decision") == d).alias(n)
        for d, n in ((ALLOW, "allowed"), (STEP_UP, "stepped_up"), (BLOCK, "blocked"))])


def decision_shares(df: DataFrame) -> DataFrame:
    """A2: percent of the total, one decimal; 0 when there is nothing."""
    def share(n: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(n) * 100.0, F.col("total").cast("double")), 1),
                          F.lit(0.0)).alias(f"{n}_pct")
    return decision_totals(df).select("total", share("allowed"), share("stepped_up"), share("blocked"))


def scenario_breakdown(df: DataFrame) -> DataFrame:
    """A3."""
    return df.groupBy("scenario", "decision").agg(F.count("*").alias("count"))


def labelled_breakdown(df: DataFrame) -> DataFrame:
    """A4: by the decision first made, labelled attempts only."""
    return (df.filter(F.col("scenario") != "UNKNOWN")
            .groupBy("scenario", F.col("initial_decision").alias("decision"))
            .agg(F.count("*").alias("count")).orderBy("scenario", "decision"))


def score_histogram(df: DataFrame, bucket: int = 10, decision: str | None = None,
                    scenario: str | None = None, policy: Policy = Policy()) -> DataFrame:
    """A5: every bucket is present; 100 belongs to the last one."""
    n = 100 // bucket
    counts = filter_attempts(df, decision, scenario).groupBy(
        F.least(F.floor(F.col("risk_score") / bucket), F.lit(n - 1)).cast("int").alias("bucket")) \
        .agg(F.count("*").alias("_c"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    low = F.col("bucket") * bucket
    high = F.when(F.col("bucket") == n - 1, 100).otherwise(low + bucket - 1)
    return grid.join(counts, "bucket", "left").select(
        "bucket", F.format_string("%d-%d", low, high).alias("label"),
        F.coalesce("_c", F.lit(0)).cast("long").alias("count"),
        F.when(low >= policy.block_score, BLOCK).when(low >= policy.step_up_score, STEP_UP)
        .otherwise(ALLOW).alias("band"))


def document_presentations(df: DataFrame) -> DataFrame:
    """A6."""
    return df.filter("document_hash IS NOT NULL").groupBy("document_hash") \
             .agg(F.count("*").alias("presentations"))


def max_sequence(df: DataFrame, id_col: str = "id") -> DataFrame:
    """The reference the next attempt gets."""
    return df.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("max_id")).select(
        "max_id", F.format_string("ATT-%05d", F.col("max_id") + 1001).alias("next_ref"))


def next_identity_index(df: DataFrame, identity: str = "claimed_user_ref", prefix: str = "SIM-") -> DataFrame:
    """Highest numeric suffix of the prefix plus one."""
    number = F.regexp_extract(identity, f"^{prefix}([0-9]+)$", 1)
    return df.agg((F.coalesce(F.max(F.when(number != "", number).try_cast("long")), F.lit(0)) + 1)
                  .alias("next_index"))


def recent_attempts(df: DataFrame, limit: int = 100, offset: int = 0, decision: str | None = None,
                    scenario: str | None = None, order: str = "seq") -> DataFrame:
    """K1: newest first. Spark keeps only limit + offset rows per task."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("Limit must be 1-500 and offset must be non-negative.")
    return filter_attempts(df, decision, scenario).orderBy(F.col(order).desc()).offset(offset).limit(limit)


def audit_trail(events: DataFrame, attempt: str | None = None, limit: int = 200,
                order: tuple[str, ...] = ("seq", "step")) -> DataFrame:
    """K4: one attempt's events in order, or the newest ones of all."""
    if attempt is not None:
        return events.filter(F.col("attempt_ref") == attempt).orderBy(*order)
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(limit)


def attempt_list_view(df: DataFrame) -> DataFrame:
    """N16."""
    step = F.col("step_up_result") if "step_up_result" in df.columns else F.lit(None).cast("string")
    return df.select(
        "attempt_ref", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("claimed_user_ref").alias("identity"), "ip_address", "device_id", "risk_score", "decision",
        "initial_decision", step.alias("step_up_result"), "scenario", "stage")


def analyst_view(df: DataFrame, key: str = "") -> DataFrame:
    """One attempt's details with contact data masked."""
    step = F.col("step_up_result") if "step_up_result" in df.columns else F.lit(None).cast("string")
    return df.select(
        "attempt_ref", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("claimed_user_ref").alias("identity"), "full_name", "ip_address", "device_id",
        mask_pii(F.col("phone"), 2, key).alias("phone"), mask_pii(F.col("email"), 4, key).alias("email"),
        "address", "risk_score", "rule_points", "ml_probability", "decision", "initial_decision", "stage",
        step.alias("step_up_result"), "scenario", "document_status", "liveness_status", "login_status")


def with_reasons(attempts: DataFrame, reasons: DataFrame) -> DataFrame:
    """J1."""
    return attempts.join(reasons, "attempt_ref")


def with_audit(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """J2."""
    return attempts.join(events.select("attempt_ref", "step", "event", "details"), "attempt_ref")


def with_document(attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """J3."""
    side = registry.select(F.col("doc_hash").alias("document_hash"), F.struct(
        "doc_hash", "ela_score", "metadata_flags").alias("document"))
    return attempts.join(side, "document_hash", "left")


def attempt_detail(scored: DataFrame, events: DataFrame, registry: DataFrame, ref: str | None = None,
                   key: str = "") -> DataFrame:
    """Analyst view with ranked reasons, audit trail, document and its presentations."""
    d = scored if ref is None else attempt_by_ref(scored, ref)
    audit = events if ref is None else events.filter(F.col("attempt_ref") == ref)
    trail = audit.groupBy("attempt_ref").agg(F.array_sort(F.collect_list(
        F.struct("step", "event", "details"))).alias("audit"))
    seen = document_presentations(scored if ref is None else scored.join(
        d.select("document_hash").distinct(), "document_hash", "left_semi"))
    full = with_document(d, registry).join(seen, "document_hash", "left").join(trail, "attempt_ref", "left")
    view = analyst_view(full, key).columns
    return full.withColumns({
        "_phone": mask_pii(F.col("phone"), 2, key), "_email": mask_pii(F.col("email"), 4, key)}) \
        .withColumns({"phone": F.col("_phone"), "email": F.col("_email"), "identity": F.col("claimed_user_ref"),
                      "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
                      "step_up_result": F.col("step_up_result") if "step_up_result" in full.columns
                      else F.lit(None).cast("string"),
                      "reasons": ranked_reasons(F.col("reasons")),
                      "seen_count": F.when(F.col("document").isNotNull(), F.coalesce("presentations", F.lit(0)))
                      .otherwise(F.lit(0))}) \
        .select(*view, "reasons", "audit", "document", "seen_count")


def unregistered(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts whose identity and e-mail are both not registered yet."""
    refs = users.select(F.col("user_ref").alias("claimed_user_ref"))
    mails = users.filter("email IS NOT NULL").select(F.lower("email").alias("_m")).distinct()
    return attempts.join(refs, "claimed_user_ref", "left_anti") \
                   .join(mails, F.lower(attempts["email"]) == F.col("_m"), "left_anti")


