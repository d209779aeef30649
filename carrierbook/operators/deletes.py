"""Delete requests (W7): every guard of the delete routes, then the effects on all tables.

A request is (request_id, actor_id, kind, target_id).  The first guard that fails is its reason:

=============  =======================================================================================
every kind     a target id (not null, not 0)
case           the case exists; it is at the actor's location; permission ``cases.delete``
user           full access; not the actor's own row
role           full access; no user has it
location       full access; no ledger line, then no case, is there
department     full access
partner        permission ``masterdata.entrepreneurs_manage``
=============  =======================================================================================

The route of a case looks for the case and its location before the permission, the others check the permission first.
Requests judge the tables as they stand before the batch.  What is deleted takes its references with it: notices of cases
and users go, references to users, departments and locations become NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.functions import rules as R
from carrierbook.operators import access
from carrierbook.session import reliable_checkpoint
from carrierbook.sources import schema as S

CASE, USER, ROLE, LOCATION, DEPARTMENT, PARTNER = KINDS = ("case", "user", "role", "location", "department", "partner")

# The texts of the delete routes.
ERR_ID = "invalid id"
ERR_ADMIN = "Admin only"
ERR_PERMISSIONS = "No Permissions"
ERR_SELF = "cannot delete yourself"
ERR_ROLE_USED = "role is assigned to users"
ERR_LOCATION_LINES = "Standort hat bereits Buchungen und kann nicht gelöscht werden"
ERR_LOCATION_CASES = "Standort hat bereits Vorgänge und kann nicht gelöscht werden"

# Per kind of target: (table, column, whether the row goes or the reference becomes NULL).
EFFECTS = {
    CASE: [("booking_cases", "id", "delete"), ("user_notifications", "case_id", "delete")],
    USER: [("users", "id", "delete"), ("user_notifications", "user_id", "delete"), ("bookings", "user_id", "set null"),
           *[("booking_cases", c, "set null") for c in ("created_by", "claimed_by", "submitted_by", "approved_by")]],
    ROLE: [("roles", "id", "delete")],
    LOCATION: [("locations", "id", "delete"), ("users", "location_id", "set null")],
    DEPARTMENT: [("departments", "id", "delete"), ("users", "fixed_department_id", "set null"), ("bookings", "department_id", "set null"),
                 ("booking_cases", "department_id", "set null")],
    PARTNER: [("entrepreneurs", "id", "delete")],
}
_RIGHTS = ["cases.delete", "masterdata.entrepreneurs_manage", "admin.full_access"]


def _used(requests: DataFrame, table: DataFrame, column: str, name: str) -> DataFrame:
    """``requests`` with the flag ``name``: the target id stands in ``table.column``.

    The column's distinct ids are found inside the scan's tasks, so no row of a fact table is shuffled to a hot id.
    """
    asked = requests.select(F.col("target_id").alias(column)).distinct()
    held = table.select(column).distinct().join(asked, column, "left_semi").select(F.col(column).alias("target_id"), F.lit(True).alias(name))
    return requests.join(held, "target_id", "left")


def judge(requests: DataFrame, users: DataFrame, roles: DataFrame, bookings: DataFrame, booking_cases: DataFrame) -> DataFrame:
    """``requests`` with ``reason``, the first guard that fails (null: granted)."""
    perms = access.permission_columns(users, roles, _RIGHTS)
    actors = perms.select(F.col("user_id").alias("actor_id"), access.location_lock(perms).alias("_lock"),
                          *[F.coalesce(p.replace(".", "_"), F.lit(False)).alias("_" + p.split(".")[1]) for p in _RIGHTS])
    r = requests.join(actors, "actor_id", "left")
    r = r.join(booking_cases.select(F.col("id").alias("target_id"), F.col("location_id").alias("_at")), "target_id", "left")
    r = _used(r, users.withColumnRenamed("role_id", "_role"), "_role", "_role_used")
    r = _used(r, bookings, "location_id", "_lines")
    r = _used(r, booking_cases, "location_id", "_cases")

    def may(right: str) -> Column:
        return F.coalesce(F.col("_" + right), F.lit(False))

    kind, admin = F.col("kind"), F.when(~may("full_access"), F.lit(ERR_ADMIN))
    lacking_id = F.when(F.coalesce("target_id", F.lit(0)) == 0, F.lit(ERR_ID))
    own = R.first_reason(admin, lacking_id, F.when(F.col("target_id") == F.col("actor_id"), F.lit(ERR_SELF)))
    of_case = R.first_reason(lacking_id, F.when(F.col("_at").isNull(), F.lit(S.ERR_NOT_FOUND)),
                             F.when(F.col("_lock") != F.col("_at"), F.lit(S.ERR_FORBIDDEN)),
                             F.when(~may("delete"), F.lit(S.ERR_NO_PERMISSION)))
    reason = (F.when(kind == CASE, of_case).when(kind == USER, own)
              .when(kind == ROLE, R.first_reason(admin, lacking_id, F.when(F.col("_role_used"), F.lit(ERR_ROLE_USED))))
              .when(kind == LOCATION, R.first_reason(admin, lacking_id, F.when(F.col("_lines"), F.lit(ERR_LOCATION_LINES)),
                                                     F.when(F.col("_cases"), F.lit(ERR_LOCATION_CASES))))
              .when(kind == DEPARTMENT, R.first_reason(admin, lacking_id))
              .when(kind == PARTNER, R.first_reason(F.when(~may("entrepreneurs_manage"), F.lit(ERR_PERMISSIONS)), lacking_id))
              .otherwise(F.lit(S.ERR_UNKNOWN_ACTION)))
    return r.select(*requests.columns, reason.alias("reason"))


def effects(granted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, effect, n): how many rows the granted requests delete or change, per table and reference."""
    granted = reliable_checkpoint(granted.select("kind", "target_id").distinct())  # met by every table below
    out = None
    for kind, parts in EFFECTS.items():
        gone = granted.where(F.col("kind") == kind).select("target_id")
        for table, column, effect in parts:
            # Counted per id before the shuffle: a hot user's or department's lines are one row per task.
            held = tables[table].groupBy(F.col(column).alias("target_id")).agg(F.count(F.lit(1)).alias("n"))
            one = held.join(gone, "target_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.lit(effect).alias("effect"), "n")
            out = one if out is None else out.unionByName(one)
    return out


def apply(granted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after the granted requests."""
    granted = reliable_checkpoint(granted.select("kind", "target_id").distinct())
    out = dict(tables)
    for kind, parts in EFFECTS.items():
        gone = granted.where(F.col("kind") == kind).select(F.col("target_id").alias("_gone"))
        for table, column, effect in parts:
            df = out[table]
            if effect == "delete":
                out[table] = df.join(gone, F.col(column) == F.col("_gone"), "left_anti")
            else:
                hit = df.join(gone, F.col(column) == F.col("_gone"), "left")
                out[table] = hit.select(*[(F.when(F.col("_gone").isNull(), F.col(c)) if c == column else F.col(c)).alias(c) for c in df.columns])
    return out
