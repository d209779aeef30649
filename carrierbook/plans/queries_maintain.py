"""Registered queries: table maintenance (W1-W9) and data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.operators import maintain, quality
from carrierbook.plans.catalog import register
from carrierbook.sources import schema as S
from carrierbook.sources.fixtures import with_prefix


@register("partner_upsert", with_prefix("entrepreneurs", "partner_updates") + """,
b AS (SELECT seq, nullif(trim(name),'') AS name, nullif(trim(street),'') AS street, nullif(trim(postal_code),'') AS postal_code,
  nullif(trim(city),'') AS city FROM partner_updates),
r AS (SELECT name, min(seq) AS first_seq, arg_max(street, seq) FILTER (WHERE street IS NOT NULL) AS street,
  arg_max(postal_code, seq) FILTER (WHERE postal_code IS NOT NULL) AS postal_code,
  arg_max(city, seq) FILTER (WHERE city IS NOT NULL) AS city FROM b WHERE name IS NOT NULL GROUP BY name)
SELECT e.id, e.name, coalesce(r.street, e.street) AS street, coalesce(r.postal_code, e.postal_code) AS postal_code,
 coalesce(r.city, e.city) AS city FROM entrepreneurs e LEFT JOIN r ON r.name=e.name
UNION ALL
SELECT CAST((SELECT max(id) FROM entrepreneurs) + row_number() OVER (ORDER BY r.first_seq) AS INTEGER), r.name, r.street, r.postal_code, r.city
FROM r WHERE r.name NOT IN (SELECT name FROM entrepreneurs)""")
def partner_upsert(t):
    """Partner master data after the update batch (NULL keeps the old value; new names appended)."""
    return maintain.upsert_keep_old(t.entrepreneurs, t.partner_updates, key="name", seq="seq")[0]


@register("theme_preferences", with_prefix("theme_updates") + """
SELECT ip_address, arg_max(ts, ts) AS updated_at, arg_max(lower(trim(theme)), ts) AS theme FROM theme_updates
WHERE lower(trim(theme)) IN ('light','dark') GROUP BY ip_address""")
def theme_preferences(t):
    """Per address the last valid theme (last write wins) from an empty preference table."""
    empty = t.theme_updates.sparkSession.createDataFrame([], S.IP_PREFERENCES)
    return maintain.theme_updates(empty, t.theme_updates)[0]


@register("booking_patch", with_prefix("bookings", "booking_patches") + """,
p AS (SELECT p.*, CASE WHEN p.quantity IS NOT NULL AND p.quantity <= 0 THEN 'quantity must be positive integer'
   WHEN p.license_plate IS NOT NULL AND trim(p.license_plate)<>'' AND regexp_matches(upper(trim(p.license_plate)),'\\s') THEN 'Kennzeichen bitte ohne Leerzeichen eingeben'
   WHEN k.id IS NULL THEN 'Not found' END AS reason FROM booking_patches p LEFT JOIN (SELECT DISTINCT id FROM bookings) k ON k.id=p.id),
ok AS (SELECT id, quantity, nullif(trim(note),'') AS note, nullif(trim(entrepreneur),'') AS entrepreneur,
   CASE WHEN license_plate IS NOT NULL AND trim(license_plate)<>'' THEN upper(trim(license_plate)) END AS license_plate FROM p WHERE reason IS NULL)
SELECT b.id, b.location_id, b.department_id, b.user_id, b.type, coalesce(ok.quantity, b.quantity) AS quantity, coalesce(ok.note, b.note) AS note,
 b.receipt_no, coalesce(ok.license_plate, b.license_plate) AS license_plate, coalesce(ok.entrepreneur, b.entrepreneur) AS entrepreneur,
 b.line_no, b.product_type, b.created_at FROM bookings b LEFT JOIN ok ON ok.id=b.id""")
def booking_patch(t):
    """W3 + Q1 + Q6: the ledger after the line patches (COALESCE patch of valid patches)."""
    return maintain.booking_patch(t.bookings, t.booking_patches)[0]


@register("booking_patch_rejects", with_prefix("bookings", "booking_patches") + """
SELECT DISTINCT id, CASE WHEN quantity IS NOT NULL AND quantity <= 0 THEN 'quantity must be positive integer'
 WHEN license_plate IS NOT NULL AND trim(license_plate)<>'' AND regexp_matches(upper(trim(license_plate)),'\\s') THEN 'Kennzeichen bitte ohne Leerzeichen eingeben'
 WHEN k.id IS NULL THEN 'Not found' END AS reason FROM booking_patches p LEFT JOIN (SELECT DISTINCT id FROM bookings) k USING (id)
WHERE reason IS NOT NULL""")
def booking_patch_rejects(t):
    """Rejected line patches with the first failing rule."""
    return maintain.booking_patch(t.bookings, t.booking_patches)[1]


_USER_PATCH = with_prefix("users", "roles", "departments", "user_patches") + """,
p AS (SELECT p.*, string_split(coalesce(p.present,''), ',') AS m FROM user_patches p),
c AS (SELECT p.*, CASE WHEN list_contains(m,'is_active') AND is_active IS NULL THEN 'invalid is_active'
   WHEN list_contains(m,'role_id') AND coalesce(role_id,0)=0 THEN 'business role required'
   WHEN list_contains(m,'role_id') AND role_id NOT IN (SELECT id FROM roles) THEN 'Business-Rolle nicht gefunden'
   WHEN list_contains(m,'fixed_department_id') AND coalesce(fixed_department_id,0)<>0 AND fixed_department_id NOT IN (SELECT id FROM departments) THEN 'Abteilung nicht gefunden'
   WHEN NOT (list_contains(m,'location_id') OR list_contains(m,'is_active') OR list_contains(m,'role_id') OR list_contains(m,'fixed_department_id')) THEN 'no changes' END AS reason FROM p)
"""


@register("user_patch", _USER_PATCH + """
SELECT u.id, u.username, u.role,
 CASE WHEN list_contains(c.m,'location_id') THEN c.location_id ELSE u.location_id END AS location_id,
 CASE WHEN list_contains(c.m,'role_id') THEN c.role_id ELSE u.role_id END AS role_id,
 CASE WHEN list_contains(c.m,'is_active') THEN c.is_active ELSE u.is_active END AS is_active,
 CASE WHEN list_contains(c.m,'fixed_department_id') THEN nullif(c.fixed_department_id,0) ELSE u.fixed_department_id END AS fixed_department_id
FROM users u LEFT JOIN (SELECT * FROM c WHERE reason IS NULL) c ON c.id=u.id""")
def user_patch(t):
    """Users after presence-mask patches (a present NULL clears)."""
    return maintain.user_patch(t.users, t.user_patches, t.roles, t.departments)[0]


@register("user_patch_rejects", _USER_PATCH + "SELECT id, reason FROM c WHERE reason IS NOT NULL")
def user_patch_rejects(t):
    """Rejected user patches."""
    return maintain.user_patch(t.users, t.user_patches, t.roles, t.departments)[1]


_DEPT_INTAKE = with_prefix("departments", "department_requests") + """,
r AS (SELECT seq, nullif(trim(name),'') AS name FROM department_requests),
fresh AS (SELECT * FROM r WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM departments)),
win AS (SELECT name, min(seq) AS seq FROM fresh GROUP BY name)
"""


@register("department_intake", _DEPT_INTAKE + """
SELECT CAST((SELECT max(id) FROM departments) + row_number() OVER (ORDER BY seq) AS INTEGER) AS id, name, seq FROM win""")
def department_intake(t):
    """New departments from the request batch (unique names, serial ids after the largest)."""
    return maintain.insert_if_new(t.departments, t.department_requests)[0]


@register("department_intake_rejects", _DEPT_INTAKE + """
SELECT seq, 'name required' AS reason FROM r WHERE name IS NULL
UNION ALL SELECT seq, 'duplicate key' FROM r WHERE name IS NOT NULL AND seq NOT IN (SELECT seq FROM win)""")
def department_intake_rejects(t):
    """Blank names and duplicates (existing or earlier in the batch)."""
    return maintain.insert_if_new(t.departments, t.department_requests)[1]


_USER_INTAKE = with_prefix("users", "roles", "departments", "user_requests") + """,
c AS (SELECT r.*, trim(coalesce(r.username,'')) AS nm, CASE WHEN length(trim(coalesce(r.username,''))) < 3 THEN 'username too short'
   WHEN nullif(trim(r.email),'') IS NOT NULL AND NOT regexp_full_match(lower(trim(r.email)), '[^@\\s]+@[^@\\s]+\\.[^@\\s]+') THEN 'E-Mail-Adresse ungültig'
   WHEN coalesce(r.role_id,0)=0 THEN 'business role required'
   WHEN r.role_id NOT IN (SELECT id FROM roles) THEN 'Business-Rolle nicht gefunden'
   WHEN coalesce(r.fixed_department_id,0)<>0 AND r.fixed_department_id NOT IN (SELECT id FROM departments) THEN 'Abteilung nicht gefunden' END AS reason
  FROM user_requests r),
fresh AS (SELECT * FROM c WHERE reason IS NULL AND nm NOT IN (SELECT username FROM users)),
win AS (SELECT * FROM fresh QUALIFY request_id = min(request_id) OVER (PARTITION BY nm))
"""


@register("user_intake", _USER_INTAKE + """
SELECT CAST((SELECT max(id) FROM users) + row_number() OVER (ORDER BY request_id) AS INTEGER) AS id, nm AS username, 'disponent' AS role,
 location_id, role_id, true AS is_active, CASE WHEN coalesce(fixed_department_id,0)<>0 THEN fixed_department_id END AS fixed_department_id,
 lower(nullif(trim(email),'')) AS email, request_id FROM win""")
def user_intake(t):
    """W5 + Q10 + Q4: new users from the request batch, serial ids after the largest."""
    return maintain.insert_new_users(t.users, t.user_requests, t.roles, t.departments)[0]


@register("user_intake_rejects", _USER_INTAKE + """
SELECT request_id, reason FROM c WHERE reason IS NOT NULL
UNION ALL SELECT request_id, 'username already exists' FROM c WHERE reason IS NULL AND request_id NOT IN (SELECT request_id FROM win)""")
def user_intake_rejects(t):
    """W5 + Q10: rejected user requests (rule order, then duplicates)."""
    return maintain.insert_new_users(t.users, t.user_requests, t.roles, t.departments)[1]


_REPLACE = with_prefix("entrepreneurs", "partner_replacements") + """,
r AS (SELECT id, nullif(trim(name),'') AS name, nullif(trim(street),'') AS street, nullif(trim(postal_code),'') AS postal_code,
  nullif(trim(city),'') AS city FROM partner_replacements),
c AS (SELECT r.*, CASE WHEN r.name IS NULL THEN 'Name erforderlich' WHEN r.id NOT IN (SELECT id FROM entrepreneurs) THEN 'Unternehmer nicht gefunden' END AS reason FROM r),
ok0 AS (SELECT * FROM c WHERE reason IS NULL),
keep AS (SELECT * FROM entrepreneurs WHERE id NOT IN (SELECT id FROM ok0)),
clash AS (SELECT id FROM ok0 WHERE name IN (SELECT name FROM keep)
  UNION SELECT id FROM ok0 o WHERE id <> (SELECT min(id) FROM ok0 x WHERE x.name=o.name)),
ok AS (SELECT * FROM ok0 WHERE id NOT IN (SELECT id FROM clash))
"""


@register("partner_replace", _REPLACE + """
SELECT e.id, CASE WHEN ok.id IS NOT NULL THEN ok.name ELSE e.name END AS name,
 CASE WHEN ok.id IS NOT NULL THEN ok.street ELSE e.street END AS street,
 CASE WHEN ok.id IS NOT NULL THEN ok.postal_code ELSE e.postal_code END AS postal_code,
 CASE WHEN ok.id IS NOT NULL THEN ok.city ELSE e.city END AS city FROM entrepreneurs e LEFT JOIN ok ON ok.id=e.id""")
def partner_replace(t):
    """Partner rows replaced by id (all fields), unknown ids and name clashes refused."""
    return maintain.replace_by_id(t.entrepreneurs, t.partner_replacements,
                                  columns=["id", "name", "street", "postal_code", "city"])[0]


@register("partner_replace_rejects", _REPLACE + """
SELECT id, reason FROM c WHERE reason IS NOT NULL UNION ALL SELECT id, 'Unternehmer existiert bereits' FROM clash""")
def partner_replace_rejects(t):
    """Refused replacements with their reason."""
    return maintain.replace_by_id(t.entrepreneurs, t.partner_replacements,
                                  columns=["id", "name", "street", "postal_code", "city"])[1]


@register("location_delete_restrict", with_prefix("locations", "bookings", "location_delete_requests") + """,
tg AS (SELECT * FROM location_delete_requests)
SELECT tg.id, CASE WHEN EXISTS (SELECT 1 FROM bookings b WHERE b.location_id=tg.id) THEN 'Standort hat bereits Buchungen und kann nicht gelöscht werden'
 WHEN EXISTS (SELECT 1 FROM booking_cases c WHERE c.location_id=tg.id) THEN 'Standort hat bereits Vorgänge und kann nicht gelöscht werden' END AS reason
FROM tg WHERE reason IS NOT NULL""")
def location_delete_restrict(t):
    """W7 restrict + J10: location delete requests refused because ledger lines or cases use them."""
    targets = t.location_delete_requests
    _, refused = maintain.delete_restrict(t.locations, targets, [
        (t.bookings, "location_id", "Standort hat bereits Buchungen und kann nicht gelöscht werden"),
        (t.booking_cases, "location_id", "Standort hat bereits Vorgänge und kann nicht gelöscht werden")])
    return refused


@register("department_delete_set_null", with_prefix("booking_cases") + """
SELECT id, CASE WHEN department_id=5 THEN NULL ELSE department_id END AS department_id, status FROM booking_cases""")
def department_delete_set_null(t):
    """W7 set-null: cases after department 5 is deleted (references become NULL)."""
    gone = t.departments.where(F.col("id") == 5).select("id")
    return maintain.set_null_on_delete(t.booking_cases, gone, "department_id").select("id", "department_id", "status")


@register("user_delete_cascade", with_prefix("users", "user_notifications") + """
SELECT n.* FROM user_notifications n WHERE n.user_id NOT IN (SELECT id FROM users WHERE NOT is_active)""")
def user_delete_cascade(t):
    """W7 cascade: notices left after the inactive users are deleted."""
    gone = t.users.where(~F.col("is_active")).select("id")
    return maintain.cascade_delete(t.user_notifications, gone, "user_id")


@register("case_delete", with_prefix("booking_cases", "user_notifications") + """
SELECT n.* FROM user_notifications n WHERE n.case_id IS NULL OR n.case_id NOT IN (SELECT id FROM booking_cases WHERE status=0)""")
def case_delete(t):
    """Cancelled cases deleted together with their notices; the notices that remain."""
    targets = t.booking_cases.where(F.col("status") == 0).select("id")
    return maintain.delete_cases(t.booking_cases, t.user_notifications, targets)[1]


_FULL_CASES = T.StructType(list(S.BOOKING_CASES.fields) + [
    T.StructField(n, t, True) for n, t in (("translogica_transferred", T.BooleanType()), ("claimed_at", T.TimestampNTZType()),
                                           ("submitted_at", T.TimestampNTZType()), ("approved_at", T.TimestampNTZType()),
                                           ("updated_at", T.TimestampNTZType()))])


@register("schema_evolve", with_prefix("booking_cases") + """
SELECT *, false AS translogica_transferred, CAST(NULL AS TIMESTAMP) AS claimed_at, CAST(NULL AS TIMESTAMP) AS submitted_at,
 CAST(NULL AS TIMESTAMP) AS approved_at, CAST(NULL AS TIMESTAMP) AS updated_at FROM booking_cases""")
def schema_evolve(t):
    """Cases evolved to the full case schema (added columns take their defaults)."""
    return maintain.evolve_schema(t.booking_cases, _FULL_CASES, {"translogica_transferred": False})


@register("role_backfill", with_prefix("users", "legacy_users") + """
SELECT id, CASE WHEN role IS NULL OR role='user' THEN 'disponent' ELSE role END AS role FROM legacy_users""")
def role_backfill(t):
    """Legacy user roles ('user' or NULL) become 'disponent'."""
    return maintain.backfill_roles(t.legacy_users).select("id", "role")


_FK_RULES = [
    ("users", "location_id", "locations", "users.location_id→locations"),
    ("users", "role_id", "roles", "users.role_id→roles"),
    ("users", "fixed_department_id", "departments", "users.fixed_department_id→departments"),
    ("bookings", "location_id", "locations", "bookings.location_id→locations"),
    ("bookings", "department_id", "departments", "bookings.department_id→departments"),
    ("bookings", "user_id", "users", "bookings.user_id→users"),
    ("booking_cases", "location_id", "locations", "booking_cases.location_id→locations"),
    ("booking_cases", "department_id", "departments", "booking_cases.department_id→departments"),
    ("booking_cases", "created_by", "users", "booking_cases.created_by→users"),
    ("booking_cases", "claimed_by", "users", "booking_cases.claimed_by→users"),
    ("booking_cases", "submitted_by", "users", "booking_cases.submitted_by→users"),
    ("booking_cases", "approved_by", "users", "booking_cases.approved_by→users"),
    ("user_notifications", "user_id", "users", "user_notifications.user_id→users"),
    ("user_notifications", "case_id", "booking_cases", "user_notifications.case_id→booking_cases"),
]
_CHECK_RULES = [
    ("users", "role IS NULL OR role NOT IN ('admin','disponent','lager')", "users.role in (admin, disponent, lager)"),
    ("bookings", "type IS NULL OR type NOT IN ('IN','OUT')", "bookings.type in (IN, OUT)"),
    ("bookings", "quantity IS NULL OR quantity <= 0", "bookings.quantity > 0"),
    ("bookings", "product_type NOT IN ('euro','h1','gitterbox')", "bookings.product_type in list"),
    ("booking_cases", "status IS NULL OR status NOT IN (0,1,2,3,4)", "booking_cases.status in 0..4"),
    ("booking_cases", "product_type NOT IN ('euro','h1','gitterbox')", "booking_cases.product_type in list"),
]
_AUDIT_SQL = with_prefix("users", "roles", "locations", "departments", "bookings", "user_notifications") + ",\nv AS (" + \
    "\nUNION ALL ".join(
        [f"SELECT '{r}' AS rule FROM {t} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {d})" for t, c, d, r in _FK_RULES]
        + [f"SELECT '{r}' FROM {t} WHERE {cond}" for t, cond, r in _CHECK_RULES]) + \
    ")\nSELECT rule, count(*) AS violations FROM v GROUP BY rule"


@register("reference_audit_counts", _AUDIT_SQL)
def reference_audit_counts(t):
    """Q7: violations per foreign-key / CHECK rule."""
    return quality.audit_counts(quality.reference_audit(t))


@register("uniqueness_audit", with_prefix("booking_cases", "users", "entrepreneurs", "locations", "departments", "roles") + """
SELECT 'locations.name' AS rule, name AS key, count(*) AS rows FROM locations GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'departments.name', name, count(*) FROM departments GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'entrepreneurs.name', name, count(*) FROM entrepreneurs GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'users.username', username, count(*) FROM users GROUP BY username HAVING count(*) > 1
UNION ALL SELECT 'roles.name', name, count(*) FROM roles GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'booking_cases.receipt_no', receipt_no, count(*) FROM booking_cases WHERE receipt_no IS NOT NULL GROUP BY receipt_no HAVING count(*) > 1""")
def uniqueness_audit(t):
    """Q8: duplicate names, usernames and receipt numbers."""
    return quality.uniqueness_audit(t)


@register("orphan_notifications", with_prefix("booking_cases", "users", "user_notifications") + """
SELECT 'user_notifications.case_id→booking_cases' AS rule, CAST(id AS VARCHAR) AS key, CAST(case_id AS VARCHAR) AS value
FROM user_notifications n WHERE case_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM booking_cases c WHERE c.id=n.case_id)""")
def orphan_notifications(t):
    """Notices whose case does not exist (NOT EXISTS as an anti join)."""
    return quality.missing_reference(t.user_notifications, "case_id", t.booking_cases,
                                     "user_notifications.case_id→booking_cases")


@register("role_delete_restrict", with_prefix("roles", "users") + """
SELECT r.id, 'role is assigned to users' AS reason FROM roles r WHERE EXISTS (SELECT 1 FROM users u WHERE u.role_id=r.id)""")
def role_delete_restrict(t):
    """W7 restrict + J10: a request to delete every role; roles still assigned to users are refused."""
    _, refused = maintain.delete_restrict(t.roles, t.roles.select("id"),
                                          [(t.users, "role_id", "role is assigned to users")])
    return refused
