"""Case list, search and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.operators.filters import all_of, equals_if_given, key_lookup, location_scope, search_cases
from carrierbook.operators.skew import heavy_keys, is_small, join_dimension, join_heavy, join_salted
from carrierbook.sources import schema as S

CASE_USER_ROLES = (("created_by", "created_by_name"), ("claimed_by", "claimed_by_name"),
                   ("submitted_by", "submitted_by_name"), ("approved_by", "approved_by_name"))


def with_transfer_flag(booking_cases: DataFrame, flag=None) -> DataFrame:
    """Add ``translogica_transferred`` when the case table lacks it (default from ``flag`` or FALSE)."""
    if "translogica_transferred" in booking_cases.columns:
        return booking_cases
    return booking_cases.withColumn("translogica_transferred",
                                    flag if flag is not None else F.lit(False))


def _user_names_once(cases: DataFrame, users: DataFrame) -> DataFrame:
    """The four user names of every case with one lookup join (for user tables too big to broadcast).

    The four ids are unpivoted into narrow (case, role, user) rows, joined to
    the users once, and pivoted back per case; the wide case rows are then
    shuffled once (join on the case id) instead of once per user role.
    """
    roles = [name for _, name in CASE_USER_ROLES]
    ids = cases.select(F.col("id").alias("_cid"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("r"), F.col(id_col).alias("uid")) for id_col, name in CASE_USER_ROLES])).alias("x"))
    ids = ids.select("_cid", "x.r", "x.uid").where(F.col("uid").isNotNull())
    named = join_heavy(ids, users.select(F.col("id").alias("uid"), "username"), "uid", ["_cid", "r"], "inner")
    wide = named.groupBy("_cid").pivot("r", roles).agg(F.first("username"))
    return wide.select("_cid", *[F.col(n).alias(f"_{n}") for n in roles])


def enrich_cases(cases: DataFrame, departments: DataFrame, locations: DataFrame, users: DataFrame,
                 large_users: bool = False) -> DataFrame:
    """Department (left, placeholder), location (inner), and four user names (left, placeholder).

    Departments and users counted to be small are broadcast; the cases meet
    larger ones with their heavy keys (a few clerks, no clerk yet) salted.  With
    ``large_users`` the four names come from one unpivoted lookup
    (:func:`_user_names_once`), so a large users table costs one shuffle of the
    case rows, not four.  A never-set user id shows the placeholder, as in the
    reference.
    """
    out = (join_dimension(cases, departments.select(F.col("id").alias("department_id"), F.col("name").alias("_dname")),
                          "department_id", ["id", "created_at"])
           .join(locations.select(F.col("id").alias("_lid"), F.col("name").alias("location")),
                 F.col("location_id") == F.col("_lid"), "inner"))
    if large_users:
        names = _user_names_once(cases, users)
        out = out.join(names, F.col("id") == F.col("_cid"), "left")
    else:
        names = users.select("id", "username")
        small = is_small(names)
        heavy = {} if small else heavy_keys(cases, [id_col for id_col, _ in CASE_USER_ROLES])
        for id_col, name_col in CASE_USER_ROLES:
            u = names.select(F.col("id").alias(id_col), F.col("username").alias(f"_{name_col}"))
            out = (out.join(F.broadcast(u), id_col, "left") if small
                   else join_salted(out, u, id_col, heavy[id_col], ["id", "created_at"]))
    return out.select(
        *cases.columns,
        F.coalesce(F.col("_dname"), F.lit(S.DELETED_DEPARTMENT)).alias("department"),
        F.col("location"),
        *[F.coalesce(F.col(f"_{n}"), F.lit(S.DELETED_USER)).alias(n) for _, n in CASE_USER_ROLES])


def case_filter(*, location_id: int | None, status: int | None = None, translogica: bool | None = None,
                mine_user_id: int | None = None, search: str | None = None, escape: bool = False):
    """F1, F3, F4 combined.  ``status=0`` is a real filter here (the reference ignores it)."""
    return all_of(location_scope(location_id), equals_if_given("status", status),
                  equals_if_given("translogica_transferred", translogica),
                  equals_if_given("created_by", mine_user_id), search_cases(search, escape))


def list_cases(booking_cases: DataFrame, departments: DataFrame, locations: DataFrame, users: DataFrame, *,
               location_id: int | None, status: int | None = None, translogica: bool | None = None,
               mine_user_id: int | None = None, search: str | None = None, limit: int | None = 500,
               escape: bool = False, large_users: bool = False) -> DataFrame:
    """Case list: filters, then enrichment, newest ``limit`` by id (L1; ``None`` = all)."""
    c = with_transfer_flag(booking_cases)
    c = c.where(case_filter(location_id=location_id, status=status, translogica=translogica,
                            mine_user_id=mine_user_id, search=search, escape=escape))
    out = enrich_cases(c, departments, locations, users, large_users=large_users)
    if limit is not None:
        # Top-k on the filtered cases: TakeOrderedAndProject keeps k rows per task.
        out = out.orderBy(F.col("id").desc()).limit(limit)
    return out


def get_cases(booking_cases: DataFrame, departments: DataFrame, locations: DataFrame, users: DataFrame,
              keys, lock_location: int | None = None) -> DataFrame:
    """one case by id, or a batch of ids given as a DataFrame (semi join), enriched.

    ``lock_location`` applies F2's strict form for single reads: a user
    locked to a location gets no rows of other locations (the reference
    answers those with Forbidden, without the all-locations exception).
    """
    c = key_lookup(with_transfer_flag(booking_cases), keys)
    if lock_location is not None:
        c = c.where(F.col("location_id") == F.lit(lock_location))
    return enrich_cases(c, departments, locations, users)
