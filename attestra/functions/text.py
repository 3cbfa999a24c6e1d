"""Column functions on text: residence, masking, labels, ages, perceptual hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from attestra.policy import COUNTRY_PREFIX


def address_country(address: Column, countries=tuple(COUNTRY_PREFIX)) -> Column:
    """First listed country that the address names as a whole word."""
    out = F.lit(None).cast("string")
    for country in reversed(list(countries)):
        out = F.when(address.rlike(rf"(?i)\b{re.escape(country)}\b"), F.lit(country)).otherwise(out)
    return out


def _date(c: Column, shape: str, pattern: str) -> Column:
    return F.try_to_timestamp(F.when(c.rlike(shape), c), F.lit(pattern)).cast("date")


def birth_date(c: Column) -> Column:
    """Y-m-d, d/m/Y or Y/m/d, padded or not."""
    return F.coalesce(_date(c, r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
                      _date(c, r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
                      _date(c, r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"))


def age_at(dob: Column, ts: Column) -> Column:
    """Whole years on the day of the attempt; NULL when the birth date is unreadable."""
    born, day = birth_date(dob), F.to_date(ts)
    before = (F.month(day) * 100 + F.dayofmonth(day)) < (F.month(born) * 100 + F.dayofmonth(born))
    return F.year(day) - F.year(born) - before.cast("int")


def email_domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.substring_index(F.lower(email), "@", -1))


def mask_pii(value: Column, keep: int = 2, key: str = "") -> Column:
    """``***`` + last characters + ``#`` + short keyed tag; NULL for missing or empty."""
    tail = F.when(F.length(value) > keep, F.right(value, F.lit(keep))).otherwise(F.lit(""))
    tag = F.substring(F.sha2(F.concat(F.lit(key), value), 256), 1, 8)
    return F.when(value.isNotNull() & (value != ""),
                  F.concat(F.lit("***"), tail, F.lit("#"), tag))


def short_label(kind: Column, value: Column) -> Column:
    """N15."""
    return (F.when(kind == "document_hash", F.concat(F.lit("doc:"), F.substring(value, 1, 8)))
            .when(kind == "address", F.substring(value, 1, 24)).otherwise(value))


def opaque_id(kind: Column, value: Column, key: str = "") -> Column:
    """A node id that does not reveal the value."""
    return F.substring(F.sha2(F.concat_ws("\u001f", F.lit(key), kind, value), 256), 1, 24)


def phash_distance(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hex hashes; NULL if either is missing or malformed."""
    shape = r"^[0-9a-fA-F]{16}$"

    def half(c: Column, start: int) -> Column:
        return F.conv(F.substring(c, start, 8), 16, 10).cast("long")

    bits = (F.bit_count(half(a, 1).bitwiseXOR(half(b, 1)))
            + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9))))
    return F.when(a.rlike(shape) & b.rlike(shape), bits)
