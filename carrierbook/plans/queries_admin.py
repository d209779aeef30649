"""Registered queries: delete requests with their guards and effects (W7), roles and their permissions."""

from __future__ import annotations

from pyspark.sql import functions as F

from carrierbook.operators import deletes, maintain, role_admin
from carrierbook.plans.catalog import register
from carrierbook.plans.queries_access import PERM_CTES
from carrierbook.sources import schema as S
from carrierbook.sources.fixtures import with_prefix

_JUDGED = with_prefix("users", "roles", "bookings", "locations", "departments", "entrepreneurs", "user_notifications", "delete_requests") + ",\n" + PERM_CTES + """,
may AS (SELECT user_id, bool_or(effective) FILTER (WHERE path='admin.full_access') AS adm, bool_or(effective) FILTER (WHERE path='cases.delete') AS del,
  bool_or(effective) FILTER (WHERE path='masterdata.entrepreneurs_manage') AS ent FROM perm GROUP BY user_id),
asked AS (SELECT r.*, coalesce(m.adm, false) AS adm, coalesce(m.del, false) AS del, coalesce(m.ent, false) AS ent, c.location_id AS at_loc,
  CASE WHEN u.role<>'admin' AND u.location_id IS NOT NULL AND u.location_id<>0 THEN u.location_id END AS lock FROM delete_requests r
  LEFT JOIN may m ON m.user_id=r.actor_id LEFT JOIN users u ON u.id=r.actor_id LEFT JOIN booking_cases c ON c.id=r.target_id),
judged AS (SELECT request_id, actor_id, kind, target_id, CASE
  WHEN kind='case' THEN CASE WHEN coalesce(target_id,0)=0 THEN 'invalid id' WHEN at_loc IS NULL THEN 'Not found' WHEN lock<>at_loc THEN 'Forbidden'
    WHEN NOT del THEN 'Keine Berechtigung' END
  WHEN kind='partner' THEN CASE WHEN NOT ent THEN 'No Permissions' WHEN coalesce(target_id,0)=0 THEN 'invalid id' END
  WHEN kind NOT IN ('user','role','location','department') THEN 'unknown action'
  WHEN NOT adm THEN 'Admin only' WHEN coalesce(target_id,0)=0 THEN 'invalid id'
  WHEN kind='user' AND target_id=actor_id THEN 'cannot delete yourself'
  WHEN kind='role' AND target_id IN (SELECT role_id FROM users WHERE role_id IS NOT NULL) THEN 'role is assigned to users'
  WHEN kind='location' AND target_id IN (SELECT location_id FROM bookings) THEN 'Standort hat bereits Buchungen und kann nicht gelöscht werden'
  WHEN kind='location' AND target_id IN (SELECT location_id FROM booking_cases) THEN 'Standort hat bereits Vorgänge und kann nicht gelöscht werden' END AS reason
  FROM asked),
gone AS (SELECT DISTINCT kind, target_id FROM judged WHERE reason IS NULL)
"""


def _granted(t):
    return deletes.judge(t.delete_requests, t.users, t.roles, t.bookings, t.booking_cases).where("reason is null")


def _tables(t):
    return {name: t[name] for name in ("booking_cases", "user_notifications", "users", "bookings", "roles", "locations", "departments", "entrepreneurs")}


@register("delete_guards", _JUDGED + "SELECT request_id, actor_id, kind, target_id, reason FROM judged")
def delete_guards(t):
    """The first failing guard of every delete request of every kind (null: granted)."""
    return deletes.judge(t.delete_requests, t.users, t.roles, t.bookings, t.booking_cases)


def _effect(kind, table, column, effect):
    return (f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{effect}' AS effect, count(*) AS n FROM {table} "
            f"WHERE {column} IN (SELECT target_id FROM gone WHERE kind='{kind}')")


@register("delete_effects", _JUDGED + " UNION ALL ".join(_effect(k, *part) for k, parts in deletes.EFFECTS.items() for part in parts))
def delete_effects(t):
    """How many rows the granted requests delete or change, per table and reference."""
    return deletes.effects(_granted(t), _tables(t))


@register("delete_applied_cases", _JUDGED + "SELECT id, " + ", ".join(
    f"CASE WHEN {c} NOT IN (SELECT target_id FROM gone WHERE kind='{k}') THEN {c} END AS {c}"
    for c, k in (("department_id", "department"), ("created_by", "user"), ("claimed_by", "user"), ("submitted_by", "user"), ("approved_by", "user")))
    + " FROM booking_cases WHERE id NOT IN (SELECT target_id FROM gone WHERE kind='case')")
def delete_applied_cases(t):
    """The cases after all granted requests, references to deleted users and departments as NULL."""
    after = deletes.apply(_granted(t), _tables(t))["booking_cases"]
    return after.select("id", "department_id", "created_by", "claimed_by", "submitted_by", "approved_by")


_ROLES = with_prefix("roles", "role_requests") + """,
r AS (SELECT request_id, coalesce(trim(name),'') AS name, permissions FROM role_requests),
j AS (SELECT r.*, CASE WHEN name='' THEN 'name required' WHEN name IN (SELECT name FROM roles) OR request_id <> min(request_id) OVER (PARTITION BY name)
   THEN 'role name already exists' END AS reason FROM r),
made AS (SELECT CAST(99 + row_number() OVER (ORDER BY request_id) AS INTEGER) AS id, name,
  CASE WHEN json_valid(permissions) AND json_type(permissions)='OBJECT' THEN permissions ELSE '{}' END AS permissions FROM j WHERE reason IS NULL)
"""


@register("role_intake", _ROLES + "SELECT * FROM made")
def role_intake(t):
    """Roles with their permissions created from requests, ids from 100."""
    return role_admin.create_roles(t.role_requests, t.roles, next_id=100)[0]


@register("role_intake_rejects", _ROLES + "SELECT request_id, reason FROM j WHERE reason IS NOT NULL")
def role_intake_rejects(t):
    """Role requests refused for their name."""
    return role_admin.create_roles(t.role_requests, t.roles, next_id=100)[1]


_PATCHED = _ROLES + """,
p AS (SELECT request_id, CAST(request_id % 7 AS INTEGER) AS id, CASE WHEN request_id%6 IN (1, 2) THEN nullif(trim(name),'') END AS name,
  CASE WHEN json_valid(permissions) AND json_type(permissions)='OBJECT' THEN permissions END AS permissions FROM role_requests),
base AS (SELECT id, name, permissions FROM roles UNION ALL SELECT CAST(k AS INTEGER), 'Spare ' || k, '{}' FROM range(4, 6) t(k)),
want AS (SELECT id, max_by(name, request_id) FILTER (WHERE name IS NOT NULL) AS name, max(request_id) FILTER (WHERE name IS NOT NULL) AS req,
  max_by(permissions, request_id) FILTER (WHERE permissions IS NOT NULL) AS permissions FROM p GROUP BY id),
aft AS (SELECT b.id, b.name, b.permissions, w.name AS wname, w.req, w.permissions AS wperm, coalesce(w.name, b.name) AS nname,
  count(*) OVER (PARTITION BY coalesce(w.name, b.name)) AS n FROM base b LEFT JOIN want w ON w.id=b.id),
done AS (SELECT *, n > 1 AND wname IS NOT NULL AND wname <> name AS refused FROM aft)
"""


def _patched(t):
    spare = t.role_requests.sparkSession.range(4, 6).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("Spare "), F.col("id")).alias("name"),
                                                            F.lit("{}").alias("permissions"))
    patches = t.role_requests.select("request_id", (F.col("request_id") % 7).alias("id"),
                                     F.when((F.col("request_id") % 6).isin(1, 2), F.col("name")).alias("name"), "permissions")
    return role_admin.patch_roles(t.roles.unionByName(spare), patches)


@register("role_patch", _PATCHED + "SELECT id, CASE WHEN refused THEN name ELSE nname END AS name, coalesce(wperm, permissions) AS permissions FROM done")
def role_patch(t):
    """Roles after name and permission patches in request order."""
    return _patched(t)[0]


@register("role_patch_rejects", _PATCHED + """SELECT req AS request_id, 'role name already exists' AS reason FROM done WHERE refused
UNION ALL SELECT request_id, 'Not found' FROM p WHERE id NOT IN (SELECT id FROM base)""")
def role_patch_rejects(t):
    """Patches refused because another role has the name, or for unknown roles."""
    return _patched(t)[1]


@register("permission_audit", with_prefix("role_requests") + """,
v AS (SELECT request_id AS id, CASE WHEN json_valid(coalesce(permissions,'{}')) THEN coalesce(permissions,'{}') END AS p FROM role_requests),
whole AS (SELECT id, '$' AS path, 'not an object' AS problem FROM v WHERE p IS NULL OR json_type(p)<>'OBJECT'),
g AS (SELECT id, grp, json_extract(p, '$."' || grp || '"') AS g FROM (SELECT id, p, unnest(json_keys(p)) AS grp FROM v WHERE p IS NOT NULL AND json_type(p)='OBJECT')),
l AS (SELECT id, grp, leaf, json_extract(g, '$."' || leaf || '"') AS x FROM (SELECT id, grp, g, unnest(json_keys(g)) AS leaf FROM g WHERE json_type(g)='OBJECT')),
known(path) AS (VALUES """ + ", ".join(f"('{p}')" for p in S.permission_paths()) + """),
grps AS (SELECT DISTINCT split_part(path, '.', 1) AS grp FROM known)
SELECT * FROM whole UNION ALL SELECT id, grp, 'unknown group' FROM g WHERE grp NOT IN (SELECT grp FROM grps)
UNION ALL SELECT id, grp, 'not an object' FROM g WHERE grp IN (SELECT grp FROM grps) AND json_type(g)<>'OBJECT'
UNION ALL SELECT id, grp || '.' || leaf, CASE WHEN grp || '.' || leaf NOT IN (SELECT path FROM known) THEN 'unknown permission' ELSE 'not a boolean' END
 FROM l WHERE grp IN (SELECT grp FROM grps) AND (grp || '.' || leaf NOT IN (SELECT path FROM known) OR json_type(x)<>'BOOLEAN')""")
def permission_audit(t):
    """Q7: what the permission check does not know or cannot read in the requested roles' permissions."""
    return role_admin.permission_violations(t.role_requests.withColumnRenamed("request_id", "id"))


_MAIL = with_prefix("users", "user_requests") + """,
c AS (SELECT CAST(request_id + 1 AS INTEGER) AS id, location_id, nullif(trim(email),'') AS mail,
  CASE request_id%3 WHEN 0 THEN ['email'] WHEN 1 THEN ['email', 'location_id'] ELSE [] END AS m FROM user_requests),
j AS (SELECT *, CASE WHEN len(m)=0 THEN 'no changes' WHEN mail IS NOT NULL AND NOT regexp_full_match(mail, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')
  THEN 'E-Mail-Adresse ungültig' END AS reason FROM c)
"""


def _mailed(t):
    users = t.users.withColumn("email", F.concat(F.lit("u"), F.col("id"), F.lit("@carrier.example")))
    patches = t.user_requests.select(
        (F.col("request_id") + 1).alias("id"), F.when(F.col("request_id") % 3 == 0, "email").when(F.col("request_id") % 3 == 1, "email,location_id")
        .otherwise("").alias("present"), "location_id", F.lit(None).cast("boolean").alias("is_active"), "role_id", "fixed_department_id", "email")
    return maintain.user_patch(users, patches, t.roles, t.departments)


@register("user_patch_email", _MAIL + """SELECT u.id, CASE WHEN list_contains(j.m, 'location_id') THEN j.location_id ELSE u.location_id END AS location_id,
 CASE WHEN j.id IS NOT NULL THEN lower(j.mail) ELSE 'u' || u.id || '@carrier.example' END AS email
FROM users u LEFT JOIN (SELECT * FROM j WHERE reason IS NULL) j ON j.id=u.id""")
def user_patch_email(t):
    """Users after patches of their e-mail address, a blank one clears it."""
    return _mailed(t)[0].select("id", "location_id", "email")


@register("user_patch_email_rejects", _MAIL + "SELECT id, reason FROM j WHERE reason IS NOT NULL")
def user_patch_email_rejects(t):
    """Patches refused for an invalid address or without a change."""
    return _mailed(t)[1]
