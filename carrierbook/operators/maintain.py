"""Table maintenance as rewrite jobs.

Plain Parquet tables have no MERGE/UPDATE, so each job maps (table, batch)
to (new table[, rejects]); the caller writes the result.  Batches may hold
several rows per key: they are reduced per key with partial aggregates
(``max_by`` over a sequence column), never collected per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.functions import rules as R
from carrierbook.functions.text import js_trim, trim_to_null
from carrierbook.operators.numbering import number_rows
from carrierbook.sources import schema as S


def _max_id(df: DataFrame, col: str = "id") -> int:
    """Largest id of a table (one scalar aggregate) — the start of new serial ids."""
    v = df.agg(F.max(col)).first()[0]
    return int(v or 0)


def upsert_keep_old(table: DataFrame, batch: DataFrame, *, key: str = "name", seq: str = "seq",
                    columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Insert new keys, update existing ones; a NULL (or blank) new value keeps the old one.

    Applying the batch in ``seq`` order equals: per column, the last non-NULL
    value of the batch, else the stored value.  Blank keys are rejected.
    New keys get serial ids after the table's largest id, in first-seen order.
    → (new table, rejects(seq, reason)).
    """
    columns = columns or [c for c in table.columns if c not in ("id", key)]
    b = batch.select(F.col(seq), trim_to_null(key).alias(key), *[trim_to_null(c).alias(c) for c in columns])
    rejects = b.where(F.col(key).isNull()).select(seq, F.lit(S.ERR_NAME_REQUIRED).alias("reason"))
    b = b.where(F.col(key).isNotNull())
    red = b.groupBy(key).agg(F.min(seq).alias("_first"),
                             *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_n_{c}")
                               for c in columns])
    j = table.join(red, key, "full_outer")
    merged = j.select("id", key, "_first", *[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) for c in columns])
    old = merged.where(F.col("id").isNotNull()).drop("_first")
    new = merged.where(F.col("id").isNull()).drop("id")
    new = number_rows(new, ["_first"], start=_max_id(table) + 1, out="id").drop("_first")
    new = new.withColumn("id", F.col("id").cast(table.schema["id"].dataType))
    return old.unionByName(new).select(*table.columns), rejects


def last_write_wins(table: DataFrame, batch: DataFrame, *, key: str, ts: str, value_cols: list[str]) -> DataFrame:
    """Per key the newest row of table ∪ batch wins; of equal timestamps, the batch's row, then
    the largest values, so that the choice never depends on the order of arrival."""
    u = (table.select(key, ts, *value_cols, F.lit(0).alias("_late"))
         .unionByName(batch.select(key, ts, *value_cols, F.lit(1).alias("_late"))))
    g = u.groupBy(key).agg(F.max(F.struct(ts, "_late", *value_cols)).alias("_w"))
    return g.select(key, *[F.col(f"_w.{c}").alias(c) for c in [ts, *value_cols]])


def theme_updates(prefs: DataFrame, requests: DataFrame, *, key: str = "ip_address") -> tuple[DataFrame, DataFrame]:
    """W2 for theme preferences: value trimmed + lower-cased, only light / dark; → (table, rejects)."""
    r = requests.withColumn("theme", F.lower(trim_to_null("theme")))
    bad = r.where(~F.coalesce(F.col("theme").isin(*S.THEMES), F.lit(False)))
    ok = r.where(F.col("theme").isin(*S.THEMES)).select(key, "theme", F.col("ts").alias("updated_at"))
    return last_write_wins(prefs, ok, key=key, ts="updated_at", value_cols=["theme"]), \
        bad.select(key, "ts", F.lit("invalid theme").alias("reason"))


def _sequence(batch: DataFrame, seq: str):
    """The batch's order column; rows of a batch without one count as simultaneous."""
    return (F.col(seq) if seq in batch.columns else F.lit(0)).alias("o")


def coalesce_patch(table: DataFrame, patches: DataFrame, *, key: str = "id", columns: list[str],
                   seq: str = "seq") -> DataFrame:
    """``SET c = COALESCE(new, c)`` for every patched row; NULL means keep.

    Patches of one key are reduced first: per column the last non-NULL value in ``seq`` order (of
    simultaneous ones the largest), which equals applying them one after another.
    """
    order = _sequence(patches, seq)
    p = patches.groupBy(F.col(key).alias("_k")).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct(order, F.col(c).alias("v")))).alias(f"_p_{c}") for c in columns])
    j = table.join(p, table[key] == p["_k"], "left")
    return j.select(*[(F.coalesce(F.col(f"_p_{c}.v"), F.col(c)) if c in columns else F.col(c)).alias(c)
                      for c in table.columns])


def booking_patch(bookings: DataFrame, patches: DataFrame, *, lock_location: int | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """W3 for ledger lines (PUT booking): quantity > 0, plate rule (when given), trimmed note
    and partner; unknown ids and locked locations are rejected.  → (bookings, rejects)."""
    p = patches
    q = F.col("quantity")
    plate_given = trim_to_null("license_plate").isNotNull()
    # Only the ledger lines that the batch names are looked at.
    named = patches.select(F.col("id").alias("_pid")).distinct()
    known = (bookings.select(F.col("id").alias("_bid"), F.col("location_id").alias("_bloc"))
             .join(named, F.col("_bid") == F.col("_pid"), "left_semi").distinct())
    p = p.join(known, p["id"] == known["_bid"], "left")
    reason = R.first_reason(
        F.when(q.isNotNull() & (q <= 0), F.lit("quantity must be positive integer")),
        F.when(plate_given, R.plate_error("license_plate")),
        F.when(F.col("_bid").isNull(), F.lit(S.ERR_NOT_FOUND)),
        F.when(F.lit(lock_location).isNotNull() & (F.col("_bloc") != F.lit(lock_location)), F.lit(S.ERR_FORBIDDEN))
        if lock_location is not None else None)
    p = p.withColumn("reason", reason)
    rejects = p.where(F.col("reason").isNotNull()).select("id", "reason").distinct()
    ok = p.where(F.col("reason").isNull()).select(
        "id", *[c for c in ("seq",) if c in p.columns], "quantity", trim_to_null("note").alias("note"),
        trim_to_null("entrepreneur").alias("entrepreneur"),
        F.when(plate_given, R.plate_value("license_plate")).alias("license_plate"))
    return coalesce_patch(bookings, ok, columns=["quantity", "note", "entrepreneur", "license_plate"]), rejects


def masked_patch(table: DataFrame, patches: DataFrame, *, key: str = "id", columns: list[str],
                 present: str = "present", seq: str = "seq") -> DataFrame:
    """Set exactly the columns named in ``present`` (a comma list); a given NULL clears.

    Patches of one key are reduced first: per column the last one in ``seq`` order that names it
    (of simultaneous ones the largest value).
    """
    mask = F.split(F.coalesce(F.col(present), F.lit("")), ",")
    order = _sequence(patches, seq)
    p = patches.groupBy(F.col(key).alias("_k")).agg(
        *[F.max(F.when(F.array_contains(mask, F.lit(c)), F.struct(order, F.col(c).alias("v")))).alias(f"_p_{c}")
          for c in columns])
    j = table.join(p, table[key] == p["_k"], "left")
    return j.select(*[(F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(c))
                       if c in columns else F.col(c)).alias(c) for c in table.columns])


def user_patch(users: DataFrame, patches: DataFrame, roles: DataFrame, departments: DataFrame
               ) -> tuple[DataFrame, DataFrame]:
    """W4 for users: present columns only; role must exist (and not be cleared), an e-mail address must be
    valid (a blank one clears it; where the patches have the column), department
    must exist when set; an empty change set is rejected.  → (users, rejects)."""
    has = lambda c: F.array_contains(F.split(F.coalesce(F.col("present"), F.lit("")), ","), F.lit(c))
    r = roles.select(F.col("id").alias("_rid"))
    d = departments.select(F.col("id").alias("_did"))
    p = (patches.join(r, patches["role_id"] == r["_rid"], "left")
         .join(d, patches["fixed_department_id"] == d["_did"], "left"))
    mail = "email" in patches.columns
    cols = ["location_id", "is_active", "role_id", *(["email"] if mail else []), "fixed_department_id"]
    any_present = F.lit(False)
    for c in cols:
        any_present = any_present | has(c)
    reason = R.first_reason(
        F.when(has("is_active") & F.col("is_active").isNull(), F.lit("invalid is_active")),
        F.when(has("role_id") & (F.coalesce(F.col("role_id"), F.lit(0)) == 0), F.lit(S.ERR_ROLE_REQUIRED)),
        F.when(has("role_id") & F.col("_rid").isNull(), F.lit(S.ERR_ROLE_MISSING)),
        F.when(has("email"), R.email_error("email")) if mail else None,
        F.when(has("fixed_department_id") & (F.coalesce(F.col("fixed_department_id"), F.lit(0)) != 0)
               & F.col("_did").isNull(), F.lit(S.ERR_DEPARTMENT_MISSING)),
        F.when(~any_present, F.lit("no changes")))
    p = p.withColumn("reason", reason)
    rejects = p.where(F.col("reason").isNotNull()).select("id", "reason")
    ok = p.where(F.col("reason").isNull()).withColumn(
        "fixed_department_id", F.when(F.col("fixed_department_id") != 0, F.col("fixed_department_id")))
    if mail:
        ok = ok.withColumn("email", R.email_value("email"))
    return masked_patch(users, ok, columns=cols), rejects


def insert_if_new(table: DataFrame, requests: DataFrame, *, key: str = "name", seq: str = "seq",
                  id_col: str = "id", required_reason: str = "name required") -> tuple[DataFrame, DataFrame]:
    """W5 for dimensions with a unique name (locations, departments, roles): insert new names.

    Names are trimmed; blank ones are rejected; a name that exists already, or
    that an earlier request of the batch takes, is a duplicate.  New rows get
    serial ids after the table's largest id, in request order.
    → (new rows (id, name, seq), rejects (seq, reason)).
    """
    r = requests.select(F.col(seq), trim_to_null(key).alias(key))
    blank = r.where(F.col(key).isNull()).select(seq, F.lit(required_reason).alias("reason"))
    valid = r.where(F.col(key).isNotNull())
    fresh = valid.join(table.select(key), key, "left_anti")
    winners = fresh.groupBy(key).agg(F.min(seq).alias(seq))
    accepted = fresh.join(winners, [key, seq], "left_semi")
    dup = valid.join(accepted.select(seq), seq, "left_anti").select(seq, F.lit(S.ERR_DUPLICATE).alias("reason"))
    new = number_rows(accepted, [seq], start=_max_id(table, id_col) + 1, out=id_col)
    new = new.select(F.col(id_col).cast(table.schema[id_col].dataType).alias(id_col), key, seq)
    return new, blank.unionByName(dup)


def insert_new_users(users: DataFrame, requests: DataFrame, roles: DataFrame, departments: DataFrame
                     ) -> tuple[DataFrame, DataFrame]:
    """W5 + Q10 + Q4: user intake; existing and in-batch duplicate usernames are rejected.

    Rule order: username ≥ 3 characters, e-mail, role given, role exists,
    department exists, unique username (the earliest request of a name wins).
    → (new user rows, rejects(request_id, reason)).
    """
    r = roles.select(F.col("id").alias("_rid"))
    d = departments.select(F.col("id").alias("_did"))
    name = js_trim(F.coalesce(F.col("username"), F.lit("")))
    req = (requests.withColumn("_name", name)
           .join(r, requests["role_id"] == r["_rid"], "left")
           .join(d, requests["fixed_department_id"] == d["_did"], "left"))
    dep_given = F.coalesce(F.col("fixed_department_id"), F.lit(0)) != 0
    reason = R.first_reason(
        F.when(F.length(F.col("_name")) < 3, F.lit(S.ERR_USERNAME_SHORT)),
        R.email_error("email"),
        F.when(F.coalesce(F.col("role_id"), F.lit(0)) == 0, F.lit(S.ERR_ROLE_REQUIRED)),
        F.when(F.col("_rid").isNull(), F.lit(S.ERR_ROLE_MISSING)),
        F.when(dep_given & F.col("_did").isNull(), F.lit(S.ERR_DEPARTMENT_MISSING)))
    checked = req.withColumn("reason", reason)
    valid = checked.where(F.col("reason").isNull())
    existing = users.select(F.col("username").alias("_name"))
    fresh = valid.join(existing, "_name", "left_anti")
    winners = fresh.groupBy("_name").agg(F.min("request_id").alias("request_id"))
    accepted = fresh.join(winners, ["_name", "request_id"], "left_semi")
    dup = valid.join(accepted.select("request_id"), "request_id", "left_anti") \
        .select("request_id", F.lit("username already exists").alias("reason"))
    rejects = checked.where(F.col("reason").isNotNull()).select("request_id", "reason").unionByName(dup)
    new = number_rows(accepted, ["request_id"], start=_max_id(users) + 1, out="id")
    new = new.select(F.col("id").cast("int").alias("id"), F.col("_name").alias("username"),
                     F.lit("disponent").alias("role"), F.col("location_id").cast("int").alias("location_id"),
                     F.col("role_id").cast("int").alias("role_id"), F.lit(True).alias("is_active"),
                     F.when(dep_given, F.col("fixed_department_id")).cast("int").alias("fixed_department_id"),
                     R.email_value("email").alias("email"), "request_id")
    return new, rejects


def replace_by_id(table: DataFrame, rows: DataFrame, *, key: str = "id", unique: str | None = "name",
                  columns: list[str], seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Full replace of rows by id; unknown ids and unique-name clashes are rejected.

    Of several valid replacements of one id the last in ``seq`` order holds (of simultaneous ones
    the largest).  A replacement may not take a name held by another row (after the batch).
    → (new table, rejects(id, reason)).
    """
    columns = [c for c in columns if c != key]
    r = rows.select(key, _sequence(rows, seq), *[trim_to_null(c).alias(c) for c in columns])
    known = table.select(F.col(key).alias("_k"))
    r = r.join(known, r[key] == known["_k"], "left")
    reason = R.first_reason(F.when(F.col(unique).isNull(), F.lit(S.ERR_NAME_REQUIRED)) if unique else None,
                            F.when(F.col("_k").isNull(), F.lit("Unternehmer nicht gefunden")))
    r = r.withColumn("reason", reason)
    ok = (r.where(F.col("reason").isNull()).groupBy(key).agg(F.max(F.struct("o", *columns)).alias("_w"))
          .select(key, *[F.col(f"_w.{c}").alias(c) for c in columns]))
    bad = r.where(F.col("reason").isNotNull()).select(key, "reason")
    if unique:
        # names held by rows that are not replaced, plus names the batch gives twice
        keep = table.join(ok.select(key), key, "left_anti").select(F.col(unique).alias("_u"), F.col(key).alias("_o"))
        clash1 = ok.join(keep, ok[unique] == keep["_u"], "left_semi").select(key)
        first = ok.groupBy(unique).agg(F.min(key).alias(key))
        clash2 = ok.join(first, [unique, key], "left_anti").select(key)
        clashes = clash1.unionByName(clash2).distinct()
        bad = bad.unionByName(clashes.select(key, F.lit("Unternehmer existiert bereits").alias("reason")))
        ok = ok.join(clashes, key, "left_anti")
    p = ok.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_p_{c}") for c in columns if c != key])
    j = table.join(p, table[key] == p["_k"], "left")
    out = j.select(*[(F.when(F.col("_k").isNotNull(), F.col(f"_p_{c}")).otherwise(F.col(c))
                      if c in columns and c != key else F.col(c)).alias(c) for c in table.columns])
    return out, bad


def delete_restrict(dim: DataFrame, targets: DataFrame, refs: list[tuple[DataFrame, str, str]],
                    key: str = "id") -> tuple[DataFrame, DataFrame]:
    """W7 restrict: delete dimension rows only when no fact row references them.

    ``refs`` = [(fact, fk column, refusal reason)] checked in order.  → (new dim, refused(id, reason)).
    """
    t = targets.select(F.col(key)).distinct()
    reason = None
    for i, (fact, fk, msg) in enumerate(refs):
        used = fact.select(F.col(fk).alias(key)).where(F.col(key).isNotNull()).distinct()
        t = t.join(used.withColumn(f"_u{i}", F.lit(True)), key, "left")
        cond = F.when(F.col(f"_u{i}"), F.lit(msg))
        reason = cond if reason is None else F.coalesce(reason, cond)
    t = t.withColumn("reason", reason)
    refused = t.where(F.col("reason").isNotNull()).select(key, "reason")
    gone = t.where(F.col("reason").isNull()).select(key)
    return dim.join(gone, key, "left_anti"), refused


def set_null_on_delete(fact: DataFrame, deleted: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """W7 set-null: references to deleted rows become NULL (``ON DELETE SET NULL``)."""
    d = deleted.select(F.col(key).alias("_gone")).distinct().withColumn("_hit", F.lit(True))
    j = fact.join(d, fact[fk] == d["_gone"], "left")
    return j.select(*[(F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(c)).cast(fact.schema[c].dataType)
                       if c == fk else F.col(c)).alias(c) for c in fact.columns])


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """W7 cascade: child rows of deleted parents go too (``ON DELETE CASCADE``)."""
    d = deleted.select(F.col(key).alias(fk)).where(F.col(fk).isNotNull()).distinct()
    return child.join(d, fk, "left_anti")


def delete_cases(cases: DataFrame, notifications: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete cases and, in the same job, their notices (the reference leaves them as orphans)."""
    t = targets.select(F.col("id")).distinct()
    return cases.join(t, "id", "left_anti"), cascade_delete(notifications, t, "case_id")


def evolve_schema(df: DataFrame, target: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Add the target's missing columns with their defaults (typed), keep the rest, target order first."""
    defaults = defaults or {}
    have = set(df.columns)
    out = df
    for f in target.fields:
        if f.name not in have:
            out = out.withColumn(f.name, F.lit(defaults.get(f.name)).cast(f.dataType))
    extra = [c for c in df.columns if c not in {f.name for f in target.fields}]
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in target.fields], *extra)


def backfill_roles(users: DataFrame) -> DataFrame:
    """Legacy user roles ('user' or NULL) become 'disponent'."""
    role = F.when(F.col("role").isNull() | F.col("role").isin(*S.LEGACY_ROLE_VALUES), F.lit("disponent")) \
        .otherwise(F.col("role"))
    return users.withColumn("role", role).select(*users.columns)
