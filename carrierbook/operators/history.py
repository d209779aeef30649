"""Partner history (A3, L5) and plate lists (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.functions.rules import product_or_default
from carrierbook.functions.text import trim_to_null
from carrierbook.operators.filters import all_of, equals_if_given, location_scope, not_cancelled
from carrierbook.sources import schema as S


def partner_history(booking_cases: DataFrame, departments: DataFrame, *, location_id: int | None = None,
                    department_id: int | None = None, entrepreneur: str | None = None,
                    license_plate: str | None = None) -> DataFrame:
    """A3: per partner × plate × product × department name over non-cancelled cases.

    soll = Σ qty_in − Σ qty_out − Σ non_exchangeable_qty of the cases whose
    qty_in exceeds qty_out.  The cases are aggregated per department id first
    (partial aggregate before the shuffle); the small result is joined to the
    departments and re-grouped by name, because every missing department
    shares the placeholder name.
    """
    preds = [not_cancelled(), location_scope(location_id),
             equals_if_given("department_id", department_id or None),
             F.col("entrepreneur").ilike(f"%{entrepreneur.strip()}%") if entrepreneur and entrepreneur.strip() else None,
             F.col("license_plate").ilike(f"%{license_plate.strip()}%") if license_plate and license_plate.strip() else None,
             F.coalesce(F.col("entrepreneur"), F.lit("")) != ""]
    c = booking_cases.where(all_of(*preds))
    nonx = F.when((F.col("qty_in") - F.col("qty_out")) > 0, F.col("non_exchangeable_qty")).otherwise(F.lit(0))
    part = c.groupBy("entrepreneur", "license_plate", product_or_default("product_type").alias("product_type"),
                     "department_id").agg(
        F.max("created_at").alias("last_seen"), F.sum("qty_in").alias("_in"), F.sum("qty_out").alias("_out"),
        F.sum(nonx).alias("_nx"))
    d = departments.select(F.col("id").alias("department_id"), F.col("name").alias("_dname"))
    named = part.join(d, "department_id", "left").withColumn(
        "department", F.coalesce(F.col("_dname"), F.lit(S.DELETED_DEPARTMENT)))
    g = named.groupBy("entrepreneur", "license_plate", "product_type", "department").agg(
        F.max("last_seen").alias("last_seen"), F.sum("_in").alias("_in"), F.sum("_out").alias("_out"),
        F.sum("_nx").alias("_nx"))
    qin = F.coalesce(F.col("_in"), F.lit(0)).cast("bigint")
    qout = F.coalesce(F.col("_out"), F.lit(0)).cast("bigint")
    return g.select("last_seen", "entrepreneur", "license_plate", "product_type", "department",
                    qin.alias("qty_in"), qout.alias("qty_out"),
                    (qin - qout - F.coalesce(F.col("_nx"), F.lit(0)).cast("bigint")).alias("soll"))


def newest_groups(history: DataFrame, n: int = 500) -> DataFrame:
    """The n groups seen last; ties broken by the group keys so the cut is repeatable."""
    return history.orderBy(F.col("last_seen").desc(), F.col("entrepreneur").asc_nulls_last(),
                           F.col("license_plate").asc_nulls_last(), "product_type", "department").limit(n)


def entrepreneur_history(booking_cases: DataFrame) -> DataFrame:
    """The append log written at case intake: one row per case that names a partner."""
    return booking_cases.where(trim_to_null("entrepreneur").isNotNull()).select(
        "location_id", "department_id", "created_by", trim_to_null("entrepreneur").alias("entrepreneur"),
        "license_plate", "qty_in", "qty_out", product_or_default("product_type").alias("product_type"), "created_at")


def plates(history_log: DataFrame, *, location_id: int | None = None, department_id: int | None = None) -> DataFrame:
    """A4: distinct non-blank plates of the partner log, sorted."""
    h = history_log.where(all_of(location_scope(location_id), equals_if_given("department_id", department_id or None),
                                 F.col("license_plate").isNotNull(), F.col("license_plate") != ""))
    return h.select("license_plate").distinct().orderBy("license_plate")
