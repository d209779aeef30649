"""Input rules (Q1-Q5) as column expressions.

Each rule gives a normalised value column and an error column; the error is
the message of the first failing check, or NULL when the value is valid.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierbook.functions.text import JS_SPACE_CLASS, col_, has_js_space, js_trim, trim_to_null
from carrierbook.sources import schema as S

# The accepted character sets of the reference's patterns.
PLATE_PATTERN = r"^[A-Z0-9ÄÖÜ]+\z"
EMPLOYEE_CODE_PATTERN = r"^[A-Z0-9]{2}\z"
EMAIL_PATTERN = r"^[^@{s}]+@[^@{s}]+\.[^@{s}]+\z".replace("{s}", JS_SPACE_CLASS[1:-1])
PLATE_MIN_LENGTH = 3


def plate_value(c) -> Column:
    """Q1 value: trimmed, upper-cased plate ('' for NULL)."""
    return F.upper(js_trim(F.coalesce(col_(c), F.lit(""))))


def plate_error(c) -> Column:
    """Q1: required, no '-', no white space, only A-Z 0-9 ÄÖÜ, at least 3 characters."""
    p = plate_value(c)
    return (F.when(p == "", F.lit(S.ERR_PLATE_REQUIRED))
            .when(p.contains("-"), F.lit(S.ERR_PLATE_DASH))
            .when(has_js_space(p), F.lit(S.ERR_PLATE_SPACE))
            .when(~p.rlike(PLATE_PATTERN), F.lit(S.ERR_PLATE_CHARS))
            .when(F.length(p) < PLATE_MIN_LENGTH, F.lit(S.ERR_PLATE_SHORT)))


def product_value(c) -> Column:
    """Q2 value: NULL or '' means euro; then trimmed and lower-cased."""
    return F.lower(js_trim(F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(S.DEFAULT_PRODUCT))))


def product_error(c) -> Column:
    return F.when(~product_value(c).isin(*S.PRODUCT_TYPES), F.lit(S.ERR_PRODUCT))


def employee_code_value(c) -> Column:
    """Q3 value: blank is NULL, else upper-cased."""
    return F.upper(trim_to_null(c))


def employee_code_error(c) -> Column:
    v = employee_code_value(c)
    return F.when(v.isNotNull() & ~v.rlike(EMPLOYEE_CODE_PATTERN), F.lit(S.ERR_EMPLOYEE_CODE))


def email_value(c) -> Column:
    """Q4 value: blank is NULL, else lower-cased."""
    return F.lower(trim_to_null(c))


def email_error(c) -> Column:
    v = email_value(c)
    return F.when(v.isNotNull() & ~v.rlike(EMAIL_PATTERN), F.lit(S.ERR_EMAIL))


def product_matches(c, product: str) -> Column:
    """``COALESCE(c, 'euro') = product`` written so the Parquet scan can use it."""
    c = col_(c)
    if product == S.DEFAULT_PRODUCT:
        return c.isNull() | (c == F.lit(product))
    return c == F.lit(product)


def product_or_default(c) -> Column:
    return F.coalesce(col_(c), F.lit(S.DEFAULT_PRODUCT))


def first_reason(*reasons: Column) -> Column:
    """The first non-NULL reason of an ordered rule list (``None`` entries are skipped)."""
    given = [r for r in reasons if r is not None]
    return F.coalesce(*given) if len(given) > 1 else (given[0] if given else F.lit(None).cast("string"))
