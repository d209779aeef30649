"""A1: stock balances from the signed ledger.

The ledger is aggregated first (partial aggregate per task, one shuffle of
at most one row per group and task), and only the tiny aggregate is joined to
the dimension.  The dimension is the left side so that groups without ledger
lines still show with zeros (J2); ledger predicates are applied before the
aggregate, which is what "predicate in the ON clause" means for a left join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.operators.filters import all_of, product_filter

MODES = ("location", "overall", "location_total", "entrepreneur")


def signed_sums(type_col: str = "type", qty_col: str = "quantity") -> list[Column]:
    """ins, outs as NULL-safe conditional sums (bigint)."""
    q = F.col(qty_col).cast("bigint")
    return [F.sum(F.when(F.col(type_col) == "IN", q)).alias("_ins"),
            F.sum(F.when(F.col(type_col) == "OUT", q)).alias("_outs")]


def _finish(df: DataFrame) -> DataFrame:
    ins = F.coalesce(F.col("_ins"), F.lit(0).cast("bigint"))
    outs = F.coalesce(F.col("_outs"), F.lit(0).cast("bigint"))
    return df.withColumns({"ins": ins, "outs": outs}).withColumn("saldo", F.col("ins") - F.col("outs")).drop("_ins", "_outs")


def ledger_totals(bookings: DataFrame, keys: list[str], *preds: Column | None) -> DataFrame:
    """Aggregate the ledger per key after the given predicates: key..., _ins, _outs."""
    b = bookings.where(all_of(*preds)) if any(p is not None for p in preds) else bookings
    return b.groupBy(*keys).agg(*signed_sums())


def stock_by_department(bookings: DataFrame, departments: DataFrame, product: str = "euro",
                        location_id: int | None = None) -> DataFrame:
    """A1a (one location) / A1b (all locations, or the locked one): one row per department."""
    preds = [F.col("department_id").isNotNull(), product_filter(product)]
    if location_id is not None:
        preds.append(F.col("location_id") == F.lit(location_id))
    agg = ledger_totals(bookings, ["department_id"], *preds)
    d = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department"))
    return _finish(d.join(agg, "department_id", "left")).orderBy("department", "department_id")


def stock_by_location(bookings: DataFrame, locations: DataFrame, product: str = "euro",
                      lock_location: int | None = None) -> DataFrame:
    """One row per location; internal transfers (no department) count here."""
    preds = [product_filter(product)]
    loc = locations
    if lock_location is not None:
        preds.append(F.col("location_id") == F.lit(lock_location))
        loc = loc.where(F.col("id") == F.lit(lock_location))
    agg = ledger_totals(bookings, ["location_id"], *preds)
    l_ = loc.select(F.col("id").alias("location_id"), F.col("name").alias("location"))
    return _finish(l_.join(agg, "location_id", "left")).orderBy("location", "location_id")


def stock_by_entrepreneur(bookings: DataFrame, entrepreneurs: DataFrame, product: str = "euro") -> DataFrame:
    """A1d: per partner known to the master data; no zero rows, no location lock.

    Names are unique in the master data, so the reference's inner join equals
    a semi join; it runs on the per-partner aggregate, not on ledger lines.
    """
    preds = [F.col("entrepreneur").isNotNull(), F.col("entrepreneur") != "", product_filter(product)]
    agg = ledger_totals(bookings, ["entrepreneur"], *preds)
    known = entrepreneurs.select(F.col("name").alias("entrepreneur"))
    return _finish(agg.join(known, "entrepreneur", "left_semi")).orderBy("entrepreneur")


def stock(bookings: DataFrame, *, mode: str = "location", product: str = "euro", location_id: int | None = None,
          lock_location: int | None = None, departments: DataFrame | None = None,
          locations: DataFrame | None = None, entrepreneurs: DataFrame | None = None) -> DataFrame:
    """A1 dispatcher with the reference's four modes.

    ``location`` needs ``location_id`` (and must equal ``lock_location`` if a
    lock is given); ``overall`` uses the lock when there is one.
    """
    mode = (mode or "location").lower()
    if mode == "entrepreneur":
        return stock_by_entrepreneur(bookings, entrepreneurs, product)
    if mode == "overall":
        return stock_by_department(bookings, departments, product, lock_location)
    if mode == "location_total":
        return stock_by_location(bookings, locations, product, lock_location)
    if mode != "location":
        raise ValueError(f"unknown stock mode {mode!r}")
    if not location_id:
        raise ValueError("location_id required for mode=location")
    if lock_location is not None and location_id != lock_location:
        raise PermissionError("Forbidden")
    return stock_by_department(bookings, departments, product, location_id)
