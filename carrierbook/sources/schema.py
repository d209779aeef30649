"""Table schemas, status codes and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference application's values for the
# results to match (product list, status codes, placeholder and message texts,
# notification titles, validation messages).
# ---------------------------------------------------------------------------
PRODUCT_TYPES = ["euro", "h1", "gitterbox"]
DEFAULT_PRODUCT = "euro"

STATUS_CANCELLED = 0
STATUS_ANNOUNCED = 1
STATUS_IN_PROGRESS = 2
STATUS_IN_REVIEW = 3
STATUS_BOOKED = 4

DELETED_DEPARTMENT = "(gelöschte Abteilung)"
DELETED_USER = "(gelöscht)"

TITLE_LOCATION = "Aviso Standort (Status 1)"
TITLE_DEPARTMENT = "Aviso Abteilung (Status 3)"
MSG_LOCATION = "Neues Aviso #{id} am {location}."          # location fan-out message
MSG_DEPARTMENT = "Aviso #{id} ist in Prüfung ({department})."  # department fan-out message
FALLBACK_LOCATION = "Standort {id}"
FALLBACK_DEPARTMENT = "Abteilung {id}"

RECEIPT_PREFIX = "ICS"
RECEIPT_DEFAULT_LETTER = "L"
RECEIPT_PAD = 6
RECEIPT_LINE_NO_DEFAULT = 999999   # receipt line order for lines without a number

USER_ROLES = ["admin", "disponent", "lager"]
LEGACY_ROLE_VALUES = ["user"]      # backfilled to "disponent" (as is NULL)
THEMES = ["light", "dark"]

# Validation messages (first failing rule wins).
ERR_PLATE_REQUIRED = "Kennzeichen ist Pflicht"
ERR_PLATE_DASH = "Kennzeichen bitte ohne '-' eingeben"
ERR_PLATE_SPACE = "Kennzeichen bitte ohne Leerzeichen eingeben"
ERR_PLATE_CHARS = "Kennzeichen nur Buchstaben/Zahlen (ohne Sonderzeichen)"
ERR_PLATE_SHORT = "Kennzeichen zu kurz"
ERR_EMPLOYEE_CODE = "Lagermitarbeiter muss genau 2 Zeichen haben (Buchstaben/Zahlen)"
ERR_EMPLOYEE_CODE_REQUIRED = "Lagermitarbeiter (2-stellig) ist bei Status 2 Pflicht"
ERR_EMAIL = "E-Mail-Adresse ungültig"
ERR_PRODUCT = "product_type invalid"
ERR_NO_PERMISSION = "Keine Berechtigung"
ERR_FORBIDDEN = "Forbidden"
ERR_IDS_REQUIRED = "location_id + department_id required"
ERR_QTY_IN = "qty_in invalid"
ERR_QTY_OUT = "qty_out invalid"
ERR_QTY_BOTH_ZERO = "qty_in oder qty_out muss > 0 sein"
ERR_TO_LOCATION = "to_location_id required"
ERR_QTY = "qty invalid"
ERR_NOTE_REQUIRED = "Notiz ist Pflicht"
ERR_SAME_LOCATION = "from_location_id und to_location_id dürfen nicht identisch sein"
ERR_EDIT_STATUS = "Nur in Status 1/2 editierbar"
ERR_CLAIM_STATUS = "Nur aus Status 1 möglich"
ERR_SUBMIT_STATUS = "Nur aus Status 2 möglich"
ERR_APPROVE_STATUS = "Nur aus Status 3 möglich"
ERR_TRANSLOGICA_STATUS = "Nur für gebuchte Vorgänge möglich"
ERR_TRANSLOGICA_BOOL = "translogica_transferred must be boolean"
ERR_CANCEL_BOOKED = "Gebuchte Vorgänge können nicht storniert werden"
ERR_CANCEL_CANCELLED = "Vorgang ist bereits storniert"
ERR_UNKNOWN_ACTION = "unknown action"
ERR_NOT_FOUND = "Not found"
ERR_NON_EXCH = "non_exchangeable_qty invalid"
ERR_NON_EXCH_SOLL = "non_exchangeable_qty darf positives Soll nicht übersteigen"
ERR_NON_EXCH_STATUS = "non_exchangeable_qty nur in Status 2 editierbar"
ERR_EMPLOYEE_CODE_STATUS = "employee_code nur in Status 2 editierbar"
ERR_USERNAME_SHORT = "username too short"
ERR_ROLE_REQUIRED = "business role required"
ERR_ROLE_MISSING = "Business-Rolle nicht gefunden"
ERR_DEPARTMENT_MISSING = "Abteilung nicht gefunden"
ERR_NAME_REQUIRED = "Name erforderlich"
ERR_DUPLICATE = "duplicate key"

# Default permissions of a user without a business role, and the full set
# granted to admins / full-access roles (group -> leaf -> granted).
DEFAULT_PERMISSIONS = {
    "bookings": {"create": True, "view": True, "export": True, "receipt": True, "edit": False, "delete": False, "translogica": False},
    "stock": {"view": True, "overall": True},
    "cases": {"create": True, "internal_transfer": False, "claim": False, "edit": False, "submit": False, "approve": False, "cancel": False, "delete": False, "require_employee_code": False},
    "filters": {"all_locations": False},
    "masterdata": {"manage": False, "entrepreneurs_manage": False},
    "users": {"manage": False, "view_department": False},
    "roles": {"manage": False},
    "admin": {"full_access": False},
}
FULL_ACCESS_PERMISSIONS = {
    "bookings": {"create": True, "view": True, "export": True, "receipt": True, "edit": True, "delete": True, "translogica": True},
    "stock": {"view": True, "overall": True},
    "cases": {"create": True, "internal_transfer": True, "claim": True, "edit": True, "submit": True, "approve": True, "cancel": True, "delete": True, "require_employee_code": False},
    "filters": {"all_locations": True},
    "masterdata": {"manage": True, "entrepreneurs_manage": True},
    "users": {"manage": True, "view_department": True},
    "roles": {"manage": True},
    "admin": {"full_access": True},
}
# ---------------------------------------------------------------------------


def permission_paths() -> list[str]:
    """The 25 permission leaves as dotted paths, in declaration order."""
    return [f"{g}.{leaf}" for g, leaves in DEFAULT_PERMISSIONS.items() for leaf in leaves]


def _s(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


I, L, S, B, TS = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()

LOCATIONS = _s([("id", I), ("name", S)])
DEPARTMENTS = _s([("id", I), ("name", S)])
ENTREPRENEURS = _s([("id", I), ("name", S), ("street", S), ("postal_code", S), ("city", S)])
USERS = _s([("id", I), ("username", S), ("role", S), ("location_id", I), ("role_id", I),
            ("is_active", B), ("fixed_department_id", I)])
BOOKING_CASES = _s([("id", I), ("location_id", I), ("department_id", I), ("created_by", I), ("status", I),
                    ("license_plate", S), ("entrepreneur", S), ("note", S), ("qty_in", I), ("qty_out", I),
                    ("non_exchangeable_qty", I), ("product_type", S), ("employee_code", S), ("created_at", TS),
                    ("receipt_no", S), ("claimed_by", I), ("submitted_by", I), ("approved_by", I)])
BOOKINGS = _s([("id", L), ("location_id", I), ("department_id", I), ("user_id", I), ("type", S),
               ("quantity", I), ("note", S), ("receipt_no", S), ("license_plate", S), ("entrepreneur", S),
               ("line_no", I), ("product_type", S), ("created_at", TS)])
USER_NOTIFICATIONS = _s([("id", I), ("user_id", I), ("case_id", I), ("title", S), ("is_read", B), ("created_at", TS)])
ROLES = _s([("id", I), ("name", S), ("permissions", S)])
CASE_ACTIONS = _s([("action_id", I), ("case_id", I), ("actor_id", I), ("action", S), ("ts", TS)])
LOGIN_ATTEMPTS = _s([("attempt_id", L), ("ip", S), ("ok", B), ("ts", TS)])
PARTNER_UPDATES = _s([("seq", I), ("name", S), ("street", S), ("postal_code", S), ("city", S)])
CASE_REQUESTS = _s([("request_id", I), ("location_id", I), ("department_id", I), ("license_plate", S),
                    ("qty_in", I), ("qty_out", I), ("product_type", S), ("employee_code", S)])
TRANSFER_REQUESTS = _s([("request_id", I), ("from_location_id", I), ("to_location_id", I), ("qty", I), ("note", S)])

READ_MARKS = _s([("notification_id", I), ("user_id", I), ("read_at", TS)])

THEME_UPDATES = _s([("ip_address", S), ("theme", S), ("ts", TS)])
IP_PREFERENCES = _s([("ip_address", S), ("theme", S), ("updated_at", TS)])
BOOKING_PATCHES = _s([("id", L), ("quantity", I), ("note", S), ("entrepreneur", S), ("license_plate", S)])
USER_PATCHES = _s([("id", I), ("present", S), ("location_id", I), ("is_active", B), ("role_id", I),
                   ("fixed_department_id", I)])
USER_REQUESTS = _s([("request_id", I), ("username", S), ("location_id", I), ("role_id", I),
                    ("fixed_department_id", I), ("email", S)])
PARTNER_REPLACEMENTS = ENTREPRENEURS
CASE_EDITS = _s([("action_id", I), ("case_id", I), ("actor_id", I), ("ts", TS), ("department_id", I),
                 ("license_plate", S), ("entrepreneur", S), ("note", S), ("qty_in", I), ("qty_out", I),
                 ("non_exchangeable_qty", I), ("employee_code", S), ("product_type", S)])

CASE_LOG = _s([*[(f.name, f.dataType) for f in CASE_ACTIONS.fields], ("department_id", I), ("license_plate", S), ("entrepreneur", S),
               ("note", S), ("qty_in", I), ("qty_out", I), ("non_exchangeable_qty", I), ("employee_code", S), ("product_type", S),
               ("translogica_transferred", B)])

SCHEMAS = {
    "locations": LOCATIONS, "departments": DEPARTMENTS, "entrepreneurs": ENTREPRENEURS, "users": USERS,
    "booking_cases": BOOKING_CASES, "bookings": BOOKINGS, "user_notifications": USER_NOTIFICATIONS,
    "roles": ROLES, "case_actions": CASE_ACTIONS, "case_log": CASE_LOG,
    "delete_requests": _s([("request_id", I), ("actor_id", I), ("kind", S), ("target_id", I)]),
    "role_requests": _s([("request_id", I), ("name", S), ("permissions", S)]),
    "ledger_feed": _s([("id", L), ("location_id", I), ("department_id", I), ("type", S), ("quantity", I), ("product_type", S), ("created_at", TS), ("delivery", I)]),
    "login_attempts": LOGIN_ATTEMPTS,
    "partner_updates": PARTNER_UPDATES, "case_requests": CASE_REQUESTS, "transfer_requests": TRANSFER_REQUESTS, "read_marks": READ_MARKS,
    "theme_updates": THEME_UPDATES, "booking_patches": BOOKING_PATCHES, "user_patches": USER_PATCHES,
    "user_requests": USER_REQUESTS, "partner_replacements": PARTNER_REPLACEMENTS, "case_edits": CASE_EDITS,
    "legacy_users": USERS, "location_delete_requests": _s([("id", I)]),
    "department_requests": _s([("seq", I), ("name", S)]),
    "booking_cases_flagged": T.StructType(list(BOOKING_CASES.fields) + [T.StructField("translogica_transferred", B, True)]),
}
