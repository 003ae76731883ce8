"""PII detection by column name (P5) and value masks (G1-G3) as Column
expressions.  Which mask applies is decided from the column *name*, which is
schema (driver-side, bounded); the masking itself runs JVM-side per row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# PII name words, matched whole between '_' or the name ends.
PII_NAME_WORDS = [
    "email", "phone", "mobile", "fax",
    "first_name", "last_name", "full_name", "display_name",
    "address", "street", "postcode", "zip", "city",
    "ssn", "passport", "national_id", "dob", "date_of_birth",
    "ip_address", "user_agent",
    "credit_card", "card_number", "iban", "account_number",
]
PII_NAME_REGEX = "(?i)(^|_)(" + "|".join(PII_NAME_WORDS) + ")(_|$)"

# Which mask a PII column gets, tested in this order.
EMAIL_NAME_REGEX = r"(?i)email"
PHONE_NAME_REGEX = r"(?i)phone|mobile|fax"
NAME_NAME_REGEX = r"(?i)(first|last|full|display)_?name|^name$"
REDACTED = "[REDACTED]"


def is_pii_name(name: str) -> bool:
    return re.search(PII_NAME_REGEX, name) is not None


def is_pii_col(name_col) -> Column:
    """P5 as a column over a frame of field names."""
    c = F.col(name_col) if isinstance(name_col, str) else name_col
    return c.rlike(PII_NAME_REGEX)


def mask_email(c) -> Column:
    """G1 ``j.doe@x.com`` -> ``j***@x.com``; no '@' -> ``***``.
    Empty local part gives ``***@domain`` (the reference raises there)."""
    s = c.cast("string")
    at = F.locate("@", s)
    first = F.when(at > 1, F.substring(s, 1, 1)).otherwise(F.lit(""))
    return F.when(s.isNull(), None).when(at == 0, F.lit("***")).otherwise(
        F.concat(first, F.lit("***@"), s.substr(at + 1, F.length(s))))


def mask_phone(c) -> Column:
    """G2 keep the last four digits: ``***-***-0123``; fewer -> ``***``."""
    digits = F.regexp_replace(c.cast("string"), r"(?U)\D", "")
    return F.when(c.isNull(), None).when(F.length(digits) >= 4,
                                          F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))
                                          ).otherwise(F.lit("***"))


def mask_name(c) -> Column:
    """G3 every word -> initial + ``***``."""
    words = F.filter(F.split(c.cast("string"), r"(?U)\s+"), lambda w: F.length(w) > 0)
    masked = F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.lit("***")))
    return F.when(c.isNull(), None).otherwise(F.array_join(masked, " "))


def mask_for(name: str, c: Column | None = None) -> Column:
    """The mask a PII column gets, by its name (email, phone, name, other)."""
    c = F.col(name) if c is None else c
    if re.search(EMAIL_NAME_REGEX, name):
        return mask_email(c)
    if re.search(PHONE_NAME_REGEX, name):
        return mask_phone(c)
    if re.search(NAME_NAME_REGEX, name):
        return mask_name(c)
    return F.when(c.isNull(), None).otherwise(F.lit(REDACTED))
