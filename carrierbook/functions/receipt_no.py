"""D3: receipt numbers ``ICS<letter><number>-<yyyymmdd>-<nnnnnn>`` as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carrierbook.sources import schema as S

# The first letter (ASCII letters and upper-case umlauts only)
# and the first digit run of the location name; the number is zero-padded to
# six places and never cut.
LOCATION_LETTER = r"([A-Za-zÄÖÜ])"
LOCATION_DIGITS = r"([0-9]+)"


def location_indicator(location_name: Column, location_id: Column) -> Column:
    """Letter (upper-cased, default 'L') + first digit run (default the location id)."""
    name = F.coalesce(location_name, F.lit(""))
    letter = F.coalesce(F.nullif(F.regexp_extract(name, LOCATION_LETTER, 1), F.lit("")), F.lit(S.RECEIPT_DEFAULT_LETTER))
    digits = F.coalesce(F.nullif(F.regexp_extract(name, LOCATION_DIGITS, 1), F.lit("")), location_id.cast("string"))
    return F.concat(F.upper(letter), digits)


def pad_number(n: Column, width: int = S.RECEIPT_PAD) -> Column:
    """Zero-pad like JavaScript padStart: longer numbers are kept whole (lpad would cut)."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), "0")


def receipt_number(location_name: Column, location_id: Column, day: Column, number: Column) -> Column:
    return F.concat(F.lit(S.RECEIPT_PREFIX), location_indicator(location_name, location_id), F.lit("-"),
                    F.date_format(day, "yyyyMMdd"), F.lit("-"), pad_number(number))
