"""String helpers with the reference's (JavaScript) semantics, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters JavaScript's String.prototype.trim removes
# (WhiteSpace and LineTerminator of the ECMAScript spec), as a Java regex class.
JS_SPACE_CLASS = r"[\t\n\x{000B}\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """Trim like JavaScript: every Unicode white space and line terminator, not only ' '."""
    return F.regexp_replace(col_(c), rf"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$", "")


def trim_to_null(c) -> Column:
    """Q5: trim; an empty result becomes NULL (NULL stays NULL)."""
    return F.nullif(js_trim(col_(c)), F.lit(""))


def has_js_space(c) -> Column:
    return col_(c).rlike(JS_SPACE_CLASS)


def like_escape(text: str) -> str:
    """Escape LIKE wildcards so that ``%`` and ``_`` match themselves."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains_ci(c, text: str, escape: bool = False) -> Column:
    """Case-insensitive substring test, ``c ILIKE '%text%'``.

    The reference does not escape wildcards in search text (so ``%`` and
    ``_`` act as wildcards); ``escape=True`` makes them literal.
    """
    t = like_escape(text) if escape else text
    return col_(c).ilike(f"%{t}%")


def not_blank(c) -> Column:
    """``c IS NOT NULL AND c <> ''`` (NULL also fails)."""
    return col_(c).isNotNull() & (col_(c) != "")
