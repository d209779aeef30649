"""Row filters (F1-F10) as column predicates.

Each helper returns a Column (or ``None`` when the parameter is not given);
``all_of`` ANDs the given ones, so the predicate list is built like the
reference builds its WHERE list, and Catalyst pushes the plain comparisons
into the Parquet scan.
"""

from __future__ import annotations

import datetime as _dt
import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.functions.rules import product_matches
from carrierbook.functions.text import col_, contains_ci, not_blank

ALL_LOCATIONS = -1


def all_of(*preds: Column | None) -> Column:
    given = [p for p in preds if p is not None]
    if not given:
        return F.lit(True)
    return functools.reduce(lambda a, b: a & b, given)


def where(df: DataFrame, *preds: Column | None) -> DataFrame:
    given = [p for p in preds if p is not None]
    return df.where(all_of(*given)) if given else df


def location_scope(location_id: int | None, column: str = "location_id") -> Column | None:
    """one location, or all of them for -1 / NULL."""
    if location_id is None or location_id == ALL_LOCATIONS:
        return None
    return F.col(column) == F.lit(location_id)


def equals_if_given(column: str, value) -> Column | None:
    """``column = value`` only when a value is given (0 counts as given)."""
    if value is None:
        return None
    return F.col(column) == F.lit(value)


def search_cases(text: str | None, escape: bool = False) -> Column | None:
    """case-insensitive substring on plate, partner, note; an all-digit text also matches the id."""
    if text is None:
        return None
    text = text.strip()
    if not text:
        return None
    pred = (contains_ci("license_plate", text, escape)
            | contains_ci(F.coalesce(F.col("entrepreneur"), F.lit("")), text, escape)
            | contains_ci(F.coalesce(F.col("note"), F.lit("")), text, escape))
    if re.fullmatch(r"[0-9]+", text) and int(text) <= 2**31 - 1:   # ids are int: longer digit runs cannot match
        pred = (F.col("id") == F.lit(int(text))) | pred
    return pred


def ntz_literal(value: _dt.datetime) -> Column:
    """A wall-clock timestamp literal that no session or process time zone shifts."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _as_date(d) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(str(d))


def date_from(value, column: str = "created_at") -> Column | None:
    """F5 lower bound: ``column >= from::date``; the bare column keeps Parquet min/max skipping."""
    if not value:
        return None
    return F.col(column) >= ntz_literal(_dt.datetime.combine(_as_date(value), _dt.time()))


def date_to(value, column: str = "created_at") -> Column | None:
    """F5 upper bound, half open: ``column < to::date + 1 day``."""
    if not value:
        return None
    end = _dt.datetime.combine(_as_date(value) + _dt.timedelta(days=1), _dt.time())
    return F.col(column) < ntz_literal(end)


def contains_if_given(column: str, text: str | None, coalesce_blank: bool = True, escape: bool = False) -> Column | None:
    """``COALESCE(column,'') ILIKE '%text%'`` when text is given."""
    if text is None or not text.strip():
        return None
    c = F.coalesce(F.col(column), F.lit("")) if coalesce_blank else F.col(column)
    return contains_ci(c, text.strip(), escape)


def non_blank(column: str) -> Column:
    """``column IS NOT NULL AND column <> ''``."""
    return not_blank(column)


def not_cancelled(column: str = "status") -> Column:
    """F8."""
    return F.col(column) != F.lit(0)


def key_lookup(df: DataFrame, keys, column: str = "id") -> DataFrame:
    """one key, or a batch of keys given as a DataFrame (semi join)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    return df.where(F.col(column) == F.lit(keys))


def product_filter(product: str, column: str = "product_type") -> Column:
    """product with the euro default, in a pushable form."""
    return product_matches(col_(column), product)
