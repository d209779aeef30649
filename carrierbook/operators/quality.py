"""Data-quality audits (Q7, Q8) and the generic rule runner (Q1-Q10).

Each audit is a set-based job: referential rules are anti joins, enum rules
are ``isin`` filters, uniqueness is a partial ``count`` per key.  Results are
one long violations table (rule, key, value) that unions every rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.functions.rules import first_reason
from carrierbook.sources import schema as S


def validate(df: DataFrame, rules: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Run ordered rules (each a reason column, NULL = pass): → (accepted, rejected with ``reason``)."""
    r = df.withColumn("reason", first_reason(*rules))
    return r.where(F.col("reason").isNull()).drop("reason"), r.where(F.col("reason").isNotNull())


def _violations(df: DataFrame, rule: str, key: str, value: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"),
                     value.cast("string").alias("value"))


def missing_reference(fact: DataFrame, fk: str, dim: DataFrame, rule: str, key: str = "id",
                      dim_key: str = "id") -> DataFrame:
    """Q7 (FK): fact rows whose non-NULL ``fk`` has no row in ``dim``."""
    d = dim.select(F.col(dim_key).alias(fk)).distinct()
    bad = fact.where(F.col(fk).isNotNull()).join(d, fk, "left_anti")
    return _violations(bad, rule, key, F.col(fk))


def outside_enum(df: DataFrame, col: str, allowed: list, rule: str, key: str = "id",
                 nullable: bool = False) -> DataFrame:
    cond = ~F.col(col).isin(*allowed)
    if not nullable:
        cond = cond | F.col(col).isNull()
    return _violations(df.where(cond), rule, key, F.col(col))


def reference_audit(t) -> DataFrame:
    """Q7: every foreign-key and CHECK rule of the schema, as one violations table."""
    parts = [
        missing_reference(t.users, "location_id", t.locations, "users.location_id→locations"),
        missing_reference(t.users, "role_id", t.roles, "users.role_id→roles"),
        missing_reference(t.users, "fixed_department_id", t.departments, "users.fixed_department_id→departments"),
        outside_enum(t.users, "role", S.USER_ROLES, "users.role in (admin, disponent, lager)"),
        missing_reference(t.bookings, "location_id", t.locations, "bookings.location_id→locations"),
        missing_reference(t.bookings, "department_id", t.departments, "bookings.department_id→departments"),
        missing_reference(t.bookings, "user_id", t.users, "bookings.user_id→users"),
        outside_enum(t.bookings, "type", ["IN", "OUT"], "bookings.type in (IN, OUT)"),
        _violations(t.bookings.where(F.col("quantity").isNull() | (F.col("quantity") <= 0)),
                    "bookings.quantity > 0", "id", F.col("quantity")),
        outside_enum(t.bookings, "product_type", S.PRODUCT_TYPES, "bookings.product_type in list", nullable=True),
        missing_reference(t.booking_cases, "location_id", t.locations, "booking_cases.location_id→locations"),
        missing_reference(t.booking_cases, "department_id", t.departments, "booking_cases.department_id→departments"),
        missing_reference(t.booking_cases, "created_by", t.users, "booking_cases.created_by→users"),
        missing_reference(t.booking_cases, "claimed_by", t.users, "booking_cases.claimed_by→users"),
        missing_reference(t.booking_cases, "submitted_by", t.users, "booking_cases.submitted_by→users"),
        missing_reference(t.booking_cases, "approved_by", t.users, "booking_cases.approved_by→users"),
        outside_enum(t.booking_cases, "status", [0, 1, 2, 3, 4], "booking_cases.status in 0..4"),
        outside_enum(t.booking_cases, "product_type", S.PRODUCT_TYPES, "booking_cases.product_type in list", nullable=True),
        missing_reference(t.user_notifications, "user_id", t.users, "user_notifications.user_id→users"),
        missing_reference(t.user_notifications, "case_id", t.booking_cases, "user_notifications.case_id→booking_cases"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicates(df: DataFrame, key: str, rule: str) -> DataFrame:
    """Q8: non-NULL key values held by more than one row, with their count."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    return g.where(F.col("rows") > 1).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"),
                                              F.col("rows"))


def uniqueness_audit(t) -> DataFrame:
    """Q8: unique names / usernames and one case per receipt number."""
    parts = [duplicates(t.locations, "name", "locations.name"),
             duplicates(t.departments, "name", "departments.name"),
             duplicates(t.entrepreneurs, "name", "entrepreneurs.name"),
             duplicates(t.users, "username", "users.username"),
             duplicates(t.roles, "name", "roles.name"),
             duplicates(t.booking_cases, "receipt_no", "booking_cases.receipt_no")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_counts(violations: DataFrame) -> DataFrame:
    """Violations per rule."""
    return violations.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def referenced_ids(targets: DataFrame, fact: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """The target ids that a fact still references (the EXISTS guard before a delete or assign)."""
    used = fact.select(F.col(fk).alias(key)).where(F.col(key).isNotNull()).distinct()
    return targets.select(key).distinct().join(used, key, "left_semi")
