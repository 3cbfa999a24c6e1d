"""Boundary checks of a submission, as one map of field errors per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attestra.functions.clean import strip

# Longest accepted text per field, and the fields that must be there.
LIMITS = {"full_name": 150, "date_of_birth": 10, "nationality": 80, "phone": 16, "email": 254,
          "address": 300, "user_ref": 64, "device_id": 100, "password": 256}
REQUIRED = ("full_name", "date_of_birth", "nationality", "phone", "email", "address", "device_id")
# Message texts.
BAD = "Invalid or overlong value."
MISSING = "This field is required."
BAD_DATE = "Use a valid date in YYYY-MM-DD format, not in the future."
BAD_PHONE = "Use an international phone number, for example +971501234567."
BAD_EMAIL = "Enter a valid email address."
BAD_CODE = "Use letters, numbers, underscores or hyphens."
BAD_LIVENESS = "Choose pass or fail for the simulated liveness check."
NO_DOCUMENT = "An identity document is required."


def field_errors(columns: set[str], today: Column) -> Column:
    """Map field -> message with the failing fields only; later checks override earlier ones."""

    def raw(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")

    def text(name: str) -> Column:
        return strip(raw(name))

    checks: dict[str, Column] = {}

    def add(name: str, failed: Column, message: str) -> None:
        # The newest check wins where it fails; otherwise the earlier verdict stands.
        earlier = checks.get(name, F.lit(None).cast("string"))
        checks[name] = F.when(failed, F.lit(message)).otherwise(earlier)

    for name, limit in LIMITS.items():
        add(name, (F.char_length(text(name)) > limit) | text(name).rlike(r"[\x00-\x1f]"), BAD)
    for name in REQUIRED:
        add(name, text(name) == "", MISSING)
    born = F.try_to_timestamp(F.when(raw("date_of_birth").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"),
                                     raw("date_of_birth")), F.lit("yyyy-MM-dd")).cast("date")
    add("date_of_birth", born.isNull() | (born > today), BAD_DATE)
    add("phone", ~text("phone").rlike(r"\A\+[1-9][0-9]{6,14}\z"), BAD_PHONE)
    add("email", ~text("email").rlike(r"\A[^\s@]+@[^\s@]+\.[^\s@]+\z"), BAD_EMAIL)
    for name in ("user_ref", "device_id"):
        add(name, (text(name) != "") & ~text(name).rlike(r"\A[A-Za-z0-9_-]+\z"), BAD_CODE)
    add("liveness", ~raw("liveness").isin("pass", "fail"), BAD_LIVENESS)
    add("document", raw("document") == "", NO_DOCUMENT)
    pairs = F.array_compact(F.array(*[
        F.when(message.isNotNull(), F.struct(F.lit(name).alias("key"), message.alias("value")))
        for name, message in checks.items()]))
    return F.map_from_entries(pairs)


def validate_submissions(df: DataFrame, today: Column | None = None, out: str = "errors") -> DataFrame:
    """``out`` is empty for a good row. Reject rows where its size is above zero."""
    day = F.current_date() if today is None else today
    return df.withColumn(out, field_errors(set(df.columns), day))


def accepted(df: DataFrame, errors: str = "errors") -> DataFrame:
    return df.filter(F.size(errors) == 0)
