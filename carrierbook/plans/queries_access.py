"""Registered queries: effective permissions (P1-P4) and user scope (F2)."""

from __future__ import annotations

from carrierbook.operators import access
from carrierbook.plans.catalog import register
from carrierbook.sources import schema as S
from carrierbook.sources.fixtures import with_prefix

_LEAVES = ", ".join(f"('{g}','{leaf}','{g}.{leaf}',{str(v).lower()},{str(S.FULL_ACCESS_PERMISSIONS[g][leaf]).lower()})"
                    for g, leaves in S.DEFAULT_PERMISSIONS.items() for leaf, v in leaves.items())

PERM_CTES = f"""leaves(grp, leaf, path, dflt, fv) AS (VALUES {_LEAVES}),
rk AS (SELECT u.*, CASE WHEN u.role='admin' THEN -2 WHEN u.role_id IS NULL OR u.role_id=0 OR r.id IS NULL THEN -1 ELSE u.role_id END AS role_key,
  COALESCE(r.permissions,'{{}}') AS p FROM users u LEFT JOIN roles r ON r.id=u.role_id),
lv AS (SELECT rk.id AS user_id, rk.role_key, l.path, l.dflt, l.fv, json_extract(rk.p, '$.' || l.grp) AS g,
  json_extract(rk.p, '$.' || l.grp || '.' || l.leaf) AS v FROM rk, leaves l),
m AS (SELECT user_id, path, fv, CASE WHEN role_key=-2 THEN true WHEN role_key=-1 THEN dflt WHEN g IS NULL THEN dflt
  WHEN json_type(g)<>'OBJECT' THEN false WHEN v IS NULL THEN dflt ELSE (json_type(v)='BOOLEAN' AND CAST(v AS BOOLEAN)) END AS ok FROM lv),
f AS (SELECT *, bool_or(path='admin.full_access' AND ok) OVER (PARTITION BY user_id) AS is_full FROM m),
perm AS (SELECT user_id, path, (ok OR is_full) AS granted, CASE WHEN is_full THEN fv ELSE ok END AS effective FROM f)
"""
PERM_SQL = with_prefix("users", "roles") + ",\n" + PERM_CTES


@register("permissions_effective", PERM_SQL + "SELECT user_id, path, granted FROM perm")
def permissions_effective(t):
    """25 permission leaves per user, role JSON deep-merged over the defaults."""
    return access.effective_permissions(t.users, t.roles)


@register("permission_holders", PERM_SQL + "SELECT user_id FROM perm WHERE path='cases.claim' AND granted")
def permission_holders(t):
    """Users holding cases.claim."""
    return access.holders(t.users, t.roles, "cases.claim")


@register("full_access_users", PERM_SQL + "SELECT user_id FROM perm WHERE path='admin.full_access' AND granted")
def full_access_users(t):
    """Users with full access."""
    return access.full_access_users(t.users, t.roles)


@register("user_scope", PERM_SQL + """SELECT u.id AS user_id,
 CASE WHEN u.role<>'admin' AND u.location_id IS NOT NULL AND u.location_id<>0 THEN u.location_id END AS location_lock,
 COALESCE(p.effective,false) AS all_locations FROM users u LEFT JOIN perm p ON p.user_id=u.id AND p.path='filters.all_locations'""")
def user_scope(t):
    """per user the location lock and the all-locations permission."""
    return access.user_scope(t.users, t.roles)


@register("user_list_scope", PERM_SQL + """SELECT u.id AS viewer_id, u.role='admin' AS sees_all,
 CASE WHEN u.role<>'admin' AND COALESCE(p.effective,false) THEN u.fixed_department_id END AS department_id
 FROM users u LEFT JOIN perm p ON p.user_id=u.id AND p.path='users.view_department'""")
def user_list_scope(t):
    """P4 per viewer: all users (admin), own fixed department (users.view_department), or none."""
    return access.user_list_scope(t.users, t.roles)


@register("visible_users", PERM_SQL + """, v AS (SELECT u.role='admin' AS sees_all,
 CASE WHEN u.role<>'admin' AND COALESCE(p.effective,false) THEN u.fixed_department_id END AS dep
 FROM users u LEFT JOIN perm p ON p.user_id=u.id AND p.path='users.view_department' WHERE u.id=4)
SELECT x.id, x.username, x.role, x.location_id, x.role_id, x.is_active, x.fixed_department_id FROM users x, v
WHERE v.sees_all OR (v.dep IS NOT NULL AND x.fixed_department_id=v.dep) ORDER BY x.username""")
def visible_users(t):
    """P4 for viewer 4 (a full-access role user): users of the viewer's department."""
    return access.visible_users(t.users, t.roles, 4)
