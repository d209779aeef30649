"""Permissions as data (P1-P4) and row-level location scope (F2).

Effective permissions are resolved once per *role* (a handful of rows): the
role's JSON is parsed to a VARIANT and merged over the defaults leaf by leaf;
users then pick up their role's leaves with an equi join.  The work per user
is a join, not a JSON parse.

Merge rules (the reference's deep merge): a group given as an object merges
leaf by leaf; a leaf given explicitly (also as JSON null) replaces the default;
a group given as a non-object replaces the whole group, so its leaves are
undefined (not granted).  A leaf is granted only when it is JSON ``true``;
``admin.full_access`` (or the ``admin`` user role) grants every leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.sources import schema as S

NO_ROLE = -1       # role key of users without a business role (defaults apply)
ADMIN_ROLE = -2    # role key of users whose user role is 'admin' (everything granted)


def _leaf_table(spark) -> DataFrame:
    """The 25 leaves as rows (for the fixed no-role / admin keys)."""
    rows = [(g, leaf, f"{g}.{leaf}", bool(v), bool(S.FULL_ACCESS_PERMISSIONS[g][leaf]))
            for g, leaves in S.DEFAULT_PERMISSIONS.items() for leaf, v in leaves.items()]
    return spark.createDataFrame(rows, "grp string, leaf string, path string, default_value boolean, full_value boolean")


def role_permissions(roles: DataFrame) -> DataFrame:
    """P1 per role: (role_key, path, value, granted, effective) incl. the no-role and admin keys.

    ``granted`` is the path check (full access grants every path);
    ``effective`` is the value the routes read: the full-access tree when the
    user has full access (where ``cases.require_employee_code`` is false),
    else the merged leaf being JSON true.
    """
    spark = roles.sparkSession
    leaves = _leaf_table(spark)
    parsed = roles.select(F.col("id").alias("role_key"),
                          F.try_parse_json(F.coalesce(F.col("permissions"), F.lit("{}"))).alias("v"))
    # Per (role, leaf): every role row is expanded to its 25 leaves (a generator,
    # no join), then the group and the leaf are looked up in the role's JSON.
    leaf_rows = F.explode(F.array(*[
        F.struct(F.lit(g).alias("grp"), F.lit(leaf).alias("leaf"), F.lit(f"{g}.{leaf}").alias("path"),
                 F.lit(bool(v)).alias("default_value"), F.lit(bool(S.FULL_ACCESS_PERMISSIONS[g][leaf])).alias("full_value"))
        for g, leaves in S.DEFAULT_PERMISSIONS.items() for leaf, v in leaves.items()]))
    rl = parsed.select("role_key", "v", leaf_rows.alias("_l")).select("role_key", "v", "_l.*")
    grp_v = F.expr("try_variant_get(v, concat('$.', grp))")
    leaf_v = F.expr("try_variant_get(v, concat('$.', grp, '.', leaf))")
    grp_is_obj = F.startswith(F.schema_of_variant(grp_v), F.lit("OBJECT"))
    value = (F.when(grp_v.isNull(), F.col("default_value").cast("string"))
             .when(~grp_is_obj, F.lit(None))
             .when(leaf_v.isNull(), F.col("default_value").cast("string"))
             .otherwise(F.to_json(leaf_v)))
    rl = rl.withColumn("value", value)
    granted = F.coalesce(F.col("value") == F.lit("true"), F.lit(False))
    full = F.max(F.when((F.col("path") == "admin.full_access") & granted, True).otherwise(False)).over(
        Window.partitionBy("role_key"))
    rl = rl.withColumns({"granted": granted | full,
                         "effective": F.when(full, F.col("full_value")).otherwise(granted)}) \
        .select("role_key", "path", "value", "granted", "effective")
    defaults = leaves.select(F.lit(NO_ROLE).alias("role_key"), "path",
                             F.col("default_value").cast("string").alias("value"), F.col("default_value").alias("granted"),
                             F.col("default_value").alias("effective"))
    admin = leaves.select(F.lit(ADMIN_ROLE).alias("role_key"), "path",
                          F.col("full_value").cast("string").alias("value"), F.lit(True).alias("granted"),
                          F.col("full_value").alias("effective"))
    return rl.unionByName(defaults).unionByName(admin)


def role_key(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with the key of the permission set that applies to them.

    admin user role -> ADMIN_ROLE; no role id -> NO_ROLE; a role id that no
    longer exists -> NO_ROLE as well (its permissions read as ``{}``).
    """
    known = roles.select(F.col("id").alias("_rid"))
    u = users.join(known, users["role_id"] == known["_rid"], "left")
    key = (F.when(F.col("role") == "admin", F.lit(ADMIN_ROLE))
           .when(F.col("role_id").isNull() | (F.col("role_id") == 0) | F.col("_rid").isNull(), F.lit(NO_ROLE))
           .otherwise(F.col("role_id")))
    return u.withColumn("role_key", key).drop("_rid")


def effective_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Long table (user_id, path, granted) with 25 rows per user."""
    per_role = role_permissions(roles)
    u = role_key(users, roles).select(F.col("id").alias("user_id"), "role_key")
    return u.join(per_role, "role_key", "inner").select("user_id", "path", "granted")


def _merged_is_true(v: Column, path: str) -> Column:
    """Whether a leaf of a role's permission VARIANT, merged over the defaults, is JSON true."""
    grp, leaf = path.split(".")
    grp_v = F.try_variant_get(v, f"$.{grp}", "variant")
    leaf_v = F.try_variant_get(v, f"$.{grp}.{leaf}", "variant")
    default = F.lit(bool(S.DEFAULT_PERMISSIONS[grp][leaf]))
    is_true = (F.schema_of_variant(leaf_v) == "BOOLEAN") & F.try_variant_get(leaf_v, "$", "boolean")
    return (F.when(grp_v.isNull(), default)
            .when(~F.startswith(F.schema_of_variant(grp_v), F.lit("OBJECT")), F.lit(False))
            .when(leaf_v.isNull(), default)
            .otherwise(F.coalesce(is_true, F.lit(False))))


def role_columns(roles: DataFrame, paths: list[str]) -> DataFrame:
    """Per role key the effective value of the given paths (one projection over the role rows).

    Same merge rules as :func:`role_permissions`; the two fixed keys (no
    role, admin) are added as literal rows.
    """
    v = F.try_parse_json(F.coalesce(F.col("permissions"), F.lit("{}")))
    full = _merged_is_true(v, "admin.full_access")
    cols = [F.when(full, F.lit(_full_value(p))).otherwise(_merged_is_true(v, p)).alias(p.replace(".", "_"))
            for p in paths]
    per_role = roles.select(F.col("id").alias("role_key"), *cols)
    fixed = [(NO_ROLE, *[_default_value(p) for p in paths]), (ADMIN_ROLE, *[_full_value(p) for p in paths])]
    return per_role.unionByName(roles.sparkSession.createDataFrame(fixed, per_role.schema))


def _default_value(path: str) -> bool:
    g, leaf = path.split(".")
    return bool(S.DEFAULT_PERMISSIONS[g][leaf])


def _full_value(path: str) -> bool:
    g, leaf = path.split(".")
    return bool(S.FULL_ACCESS_PERMISSIONS[g][leaf])


def permission_columns(users: DataFrame, roles: DataFrame, paths: list[str]) -> DataFrame:
    """Wide form for joins: (user_id, role, location_id, fixed_department_id, is_active, <path with '_'>...).

    The values are the effective permissions the routes read.
    """
    wide = role_columns(roles, paths)
    u = role_key(users, roles).select(F.col("id").alias("user_id"), "role", "location_id",
                                      "fixed_department_id", "is_active", "role_key")
    return u.join(wide, "role_key", "left").drop("role_key")


def holders(users: DataFrame, roles: DataFrame, path: str) -> DataFrame:
    """Users that hold a permission path (granted)."""
    return effective_permissions(users, roles).where((F.col("path") == path) & F.col("granted")).select("user_id")


def full_access_users(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with full access: user role 'admin' or a role with ``admin.full_access`` JSON true."""
    return holders(users, roles, "admin.full_access")


def location_lock(users: DataFrame) -> Column:
    """F2 strict form: a non-admin with a location is locked to it (NULL = not locked)."""
    return F.when((F.col("role") != "admin") & F.col("location_id").isNotNull() & (F.col("location_id") != 0),
                  F.col("location_id"))


def user_scope(users: DataFrame, roles: DataFrame) -> DataFrame:
    """per user the location lock and whether the all-locations filter is allowed.

    (user_id, location_lock, all_locations): lists may use -1 only with
    ``all_locations``; a locked user may read other locations only with it.
    """
    perms = permission_columns(users, roles, ["filters.all_locations"])
    return perms.select("user_id", location_lock(perms).alias("location_lock"),
                        F.coalesce(F.col("filters_all_locations"), F.lit(False)).alias("all_locations"))


def scope_rows(facts: DataFrame, scope: DataFrame, user_id: int, requested_location: int,
               column: str = "location_id") -> DataFrame:
    """F2 for one user's request: the rows that user may list for ``requested_location``.

    -1 needs ``all_locations``; another location than the lock needs it too.
    The user's scope is one row, read once; denied requests give no rows.
    """
    row = scope.where(F.col("user_id") == F.lit(user_id)).select("location_lock", "all_locations").first()
    if row is None:
        return facts.where(F.lit(False))
    lock, all_loc = row["location_lock"], bool(row["all_locations"])
    if requested_location == -1:
        allowed = all_loc
    else:
        allowed = lock is None or lock == requested_location or all_loc
    if not allowed:
        return facts.where(F.lit(False))
    return facts if requested_location == -1 else facts.where(F.col(column) == F.lit(requested_location))


def user_list_scope(users: DataFrame, roles: DataFrame) -> DataFrame:
    """P4 per viewer: (viewer_id, sees_all, department_id).

    Admins see every user; holders of ``users.view_department`` see the users
    of their own fixed department; others see none.  This is the scope, not
    the expanded (viewer, user) pairs, which grow with the square of a
    department's size.
    """
    perms = permission_columns(users, roles, ["users.view_department"])
    return perms.select(
        F.col("user_id").alias("viewer_id"), (F.col("role") == "admin").alias("sees_all"),
        F.when((F.col("role") != "admin") & F.coalesce(F.col("users_view_department"), F.lit(False)),
               F.col("fixed_department_id")).alias("department_id"))


def visible_users(users: DataFrame, roles: DataFrame, viewer_id: int) -> DataFrame:
    """P4 for one viewer: the users listed, sorted by username (the viewer's scope is one row, read once)."""
    cols = [c for c in ("id", "username", "role", "location_id", "role_id", "is_active", "fixed_department_id")
            if c in users.columns]
    row = user_list_scope(users, roles).where(F.col("viewer_id") == F.lit(viewer_id)).first()
    if row is None or (not row["sees_all"] and row["department_id"] is None):
        pred = F.lit(False)
    elif row["sees_all"]:
        pred = F.lit(True)
    else:
        pred = F.col("fixed_department_id") == F.lit(row["department_id"])
    return users.where(pred).select(*cols).orderBy("username", "id")


def me(users: DataFrame, roles: DataFrame) -> DataFrame:
    """Every user with the name of their business role (left join: no role → NULL)."""
    r = roles.select(F.col("id").alias("_rid"), F.col("name").alias("business_role_name"))
    cols = [c for c in ("id", "username", "role", "location_id", "role_id", "is_active") if c in users.columns]
    return users.join(r, users["role_id"] == r["_rid"], "left").select(*cols, "business_role_name")
