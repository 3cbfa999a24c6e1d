"""ST3, batch form: resolving step-up challenges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.policy import ALLOW, BLOCK, STEP_UP

OPEN_SECONDS = 300
DEMO_CODE = "123456"


def open_challenges(scored: DataFrame, owner: str = "owner", created: str = "ts",
                    seconds: int = OPEN_SECONDS) -> DataFrame:
    """One challenge per STEP_UP attempt, owned by the session that made it."""
    return scored.filter(F.col("decision") == STEP_UP).select(
        "attempt_ref", F.col(owner).alias("owner"),
        (F.unix_timestamp(created) + seconds).alias("expires_sec"))


def well_formed(code: Column) -> Column:
    return code.rlike(r"\A[0-9]{6}\z")


def judge_responses(challenges: DataFrame, responses: DataFrame, code: str = DEMO_CODE) -> DataFrame:
    """What each response led to: MALFORMED, NOT_FOUND, RESOLVED, EXPIRED, PASSED or FAILED.

    The first response that is well formed, from the owner and in time consumes the challenge.
    Finding it is one pre-aggregated minimum per attempt, not a sort of the responses.
    """
    r = responses.withColumn("_sec", F.unix_timestamp("answered_at")).join(
        challenges.withColumnRenamed("owner", "_owner"), "attempt_ref", "left")
    formed = F.coalesce(well_formed(F.col("code")), F.lit(False))
    mine = F.coalesce(F.col("_owner") == F.col("owner"), F.lit(False))
    timely = F.coalesce(F.col("_sec") < F.col("expires_sec"), F.lit(False))
    r = r.withColumn("_ok", formed & mine & timely).withColumn(
        "_at", F.struct("_sec", "response_id"))
    first = r.filter("_ok").groupBy("attempt_ref").agg(F.min("_at").alias("_first"))
    r = r.join(first, "attempt_ref", "left")
    done = F.coalesce(F.col("_at") > F.col("_first"), F.lit(False))
    verdict = (F.when(~formed, "MALFORMED").when(~mine, "NOT_FOUND").when(done, "RESOLVED")
               .when(~timely, "EXPIRED").when(F.col("code") == code, "PASSED").otherwise("FAILED"))
    return r.withColumn("outcome", verdict).select(*responses.columns, "outcome")


def resolve_step_up(scored: DataFrame, responses: DataFrame, owner: str = "owner", created: str = "ts",
                    seconds: int = OPEN_SECONDS, code: str = DEMO_CODE) -> DataFrame:
    """Attempts with ``step_up_result`` and the decision that follows from it. Score and initial
    decision stay as they were. A failed challenge is a BLOCK, so it feeds reputation like any other."""
    judged = judge_responses(open_challenges(scored, owner, created, seconds), responses, code)
    hit = judged.filter(F.col("outcome").isin("PASSED", "FAILED")).select(
        "attempt_ref", F.when(F.col("outcome") == "PASSED", "PASS").otherwise("FAIL").alias("step_up_result"))
    d = scored.drop("step_up_result").join(hit, "attempt_ref", "left")
    return d.withColumn("decision", F.when(F.col("step_up_result") == "PASS", ALLOW)
                        .when(F.col("step_up_result") == "FAIL", BLOCK).otherwise(F.col("decision")))


def analyst_challenges(scored: DataFrame, challenges: DataFrame) -> DataFrame:
    """Challenges an analyst may resolve: LOGIN attempts of a registered user, whoever owns them."""
    who = scored.filter((F.col("stage") == "LOGIN") & F.col("claimed_user_ref").isNotNull()).select("attempt_ref")
    return challenges.join(who, "attempt_ref", "left_semi")
