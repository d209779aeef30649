"""Case lifecycle: apply action batches (B5) and replay action logs.

State machine (reference rules, first failing check is the reason):

==============  ============  =========================================
action          allowed from  effect
==============  ============  =========================================
edit            1, 2          patch (no status change)
claim           1             → 2, claimed_by
submit          2             → 3, submitted_by; employee code required
                              when the actor's role says so
approve         3             → 4, approved_by, receipt number, postings
set_translogica 4             flag (boolean payload required)
cancel          not 0, not 4  → 0
==============  ============  =========================================

Every action is first checked for: case exists, actor's location lock,
known action, actor's permission.  Those checks and the employee-code rule
do not depend on the case's evolving state, so an action's outcome is a
function of the status it meets alone.  The status only moves 1→2→3→4 or to 0
(both terminal), so a case's path has at most three transitions, and each
is *the earliest eligible action after the previous transition*.

The replay therefore needs no per-case sequential fold: one partial
aggregate finds each case's first mover of every kind, two small rounds find
the first submit after the claim and the first approve after the submit,
and one more join gives every action the status it met.  Each step is a
shuffle with map-side partial aggregation, so a case that holds a third of
all actions is still split across tasks; no action list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierbook.operators import access
from carrierbook.session import reliable_checkpoint
from carrierbook.sources import schema as S

ACTION_PERMISSION = {
    "edit": "cases.edit", "claim": "cases.claim", "submit": "cases.submit", "approve": "cases.approve",
    "set_translogica": "bookings.translogica", "cancel": "cases.cancel",
}
KNOWN_ACTIONS = list(ACTION_PERMISSION)
_PATHS = sorted(set(ACTION_PERMISSION.values()) | {"cases.require_employee_code"})

_ROUNDS = 3


def actor_rights(users: DataFrame, roles: DataFrame) -> DataFrame:
    """(actor_id, _lock, _p_<permission> ...): what each user may do to cases."""
    perms = access.permission_columns(users, roles, _PATHS)
    return perms.select(F.col("user_id").alias("actor_id"), access.location_lock(perms).alias("_lock"),
                        *[F.coalesce(F.col(p.replace(".", "_")), F.lit(False)).alias("_p_" + p.replace(".", "_"))
                          for p in _PATHS])


def action_facts(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Per action the checks that do not depend on the case's state.

    Adds: _key (ts, action_id) order key, _found, _forbidden, _known, _perm,
    _need_code (submit without the required employee code), _submit_err (a
    submit payload's non_exchangeable_qty check), _flag_ok (set_translogica
    has a boolean payload), _loc, _s0 (stored status).

    Optional payload columns on ``actions``: ``non_exchangeable_qty`` and
    ``employee_code`` (submit; NULL = not sent) and ``translogica_transferred``
    (set_translogica).  A submit's quantity check uses the stored quantities,
    as the reference does, so it stays independent of the evolving status.
    """
    from carrierbook.functions import rules as R
    a = actions
    for name, typ in (("translogica_transferred", "boolean"), ("non_exchangeable_qty", "int"), ("employee_code", "string")):
        if name not in a.columns:
            a = a.withColumn(name, F.lit(None).cast(typ))
    c = cases.select(F.col("id").alias("case_id"), F.col("location_id").alias("_loc"),
                     F.col("status").alias("_s0"), F.col("employee_code").alias("_code"),
                     F.col("qty_in").alias("_cin"), F.col("qty_out").alias("_cout"))
    a = a.join(c, "case_id", "left").join(actor_rights(users, roles), "actor_id", "left")
    perm = F.lit(False)
    for act, path in ACTION_PERMISSION.items():
        perm = F.when(F.col("action") == act, F.col("_p_" + path.replace(".", "_"))).otherwise(perm)
    nonx = F.col("non_exchangeable_qty")
    soll = F.greatest(F.coalesce(F.col("_cin"), F.lit(0)) - F.coalesce(F.col("_cout"), F.lit(0)), F.lit(0))
    submit_err = R.first_reason(F.when(nonx.isNotNull() & (nonx < 0), F.lit(S.ERR_NON_EXCH)),
                                F.when(nonx.isNotNull() & (nonx > soll), F.lit(S.ERR_NON_EXCH_SOLL)),
                                F.when(F.col("employee_code").isNotNull(), R.employee_code_error("employee_code")))
    code_after = F.when(F.col("employee_code").isNotNull(), R.employee_code_value("employee_code")) \
        .otherwise(F.nullif(F.col("_code"), F.lit("")))
    return a.select(
        *actions.columns, "_loc", "_s0",
        F.struct(F.col("ts"), F.col("action_id")).alias("_key"),
        F.col("_loc").isNotNull().alias("_found"),
        (F.col("_lock").isNotNull() & (F.col("_lock") != F.col("_loc"))).alias("_forbidden"),
        F.col("action").isin(*KNOWN_ACTIONS).alias("_known"),
        F.coalesce(perm, F.lit(False)).alias("_perm"),
        submit_err.alias("_submit_err"),
        (F.coalesce(F.col("_p_cases_require_employee_code"), F.lit(False)) & code_after.isNull()).alias("_need_code"),
        code_after.alias("_code_after"),
        F.col("translogica_transferred").isNotNull().alias("_flag_ok"),
        F.col("translogica_transferred").alias("_flag"))


def _base_ok() -> Column:
    return F.col("_found") & ~F.col("_forbidden") & F.col("_known") & F.col("_perm")


def _mover_kind() -> Column:
    """For an action that can move a status: the move it makes ('claim', ..., 'cancel'), else NULL."""
    ok = _base_ok()
    a = F.col("action")
    return (F.when(ok & (a == "claim"), F.lit("claim"))
            .when(ok & (a == "submit") & F.col("_submit_err").isNull() & ~F.col("_need_code"), F.lit("submit"))
            .when(ok & (a == "approve"), F.lit("approve"))
            .when(ok & (a == "cancel"), F.lit("cancel")))


def transitions(facts: DataFrame) -> DataFrame:
    """Per case: the (at most three) status transitions of its log.

    (case_id, s0, k1, a1, s1, k2, a2, s2, k3, a3, s3): k = order key of the
    action that moved the case, a = its actor, s = status after it.

    The forward chain is claim (1→2), submit (2→3), approve (3→4), each the
    earliest eligible mover after the previous step; a cancel mover moves
    1, 2 or 3 to 0, so only the first one matters.  One partial aggregate
    finds every first-of-kind; two follow-up rounds look only at submit and
    approve movers after a per-case threshold.
    """
    movers = facts.where(F.col("_found")).withColumn("_kind", _mover_kind()).where(F.col("_kind").isNotNull()) \
        .select("case_id", "_s0", "_key", "_kind", "actor_id")

    def first_of(kind):
        return F.min(F.when(F.col("_kind") == kind, F.struct("_key", "actor_id"))).alias(kind)

    first = movers.groupBy("case_id").agg(F.max("_s0").alias("s0"), first_of("claim"), first_of("submit"),
                                          first_of("approve"), first_of("cancel"))

    def first_after(kind, thresholds):
        m = movers.where(F.col("_kind") == kind).select("case_id", "_key", "actor_id")
        j = m.join(thresholds, "case_id", "inner").where(F.col("_key") > F.col("_thr"))
        return j.groupBy("case_id").agg(F.min(F.struct("_key", "actor_id")).alias(kind + "_after"))

    # round 2: the first submit after the claim (cases that start announced)
    thr2 = first.where((F.col("s0") == 1) & F.col("claim").isNotNull()) \
        .select("case_id", F.col("claim._key").alias("_thr"))
    r2 = first_after("submit", thr2)
    chain = first.join(r2, "case_id", "left")
    sub = F.when(F.col("s0") == 1, F.col("submit_after")).when(F.col("s0") == 2, F.col("submit"))
    # round 3: the first approve after the submit (cases that start announced or in progress)
    thr3 = chain.where(sub.isNotNull()).select("case_id", sub["_key"].alias("_thr"))
    r3 = first_after("approve", thr3)
    chain = chain.join(r3, "case_id", "left")

    def step(m: Column, to: int) -> Column:
        return F.when(m.isNotNull(), F.struct(m["_key"].alias("k"), F.lit(to).alias("s"), m["actor_id"].alias("a")))

    s0 = F.col("s0")
    app = F.when(s0 == 3, F.col("approve")).otherwise(F.col("approve_after"))
    steps = F.array(
        F.when(s0 == 1, step(F.col("claim"), 2)).when(s0 == 2, step(F.col("submit"), 3)).when(s0 == 3, step(app, 4)),
        F.when(s0 == 1, step(F.col("submit_after"), 3)).when(s0 == 2, step(app, 4)),
        F.when(s0 == 1, step(app, 4)))
    x = F.col("cancel")
    kept = F.filter(steps, lambda e: e.isNotNull() & (x.isNull() | (e["k"] < x["_key"])))
    status_at_cancel = F.coalesce(F.try_element_at(kept, F.lit(-1))["s"], s0)
    cancel_step = F.struct(x["_key"].alias("k"), F.lit(S.STATUS_CANCELLED).alias("s"), x["actor_id"].alias("a"))
    all_steps = F.when(x.isNotNull() & status_at_cancel.isin(1, 2, 3),
                       F.concat(kept, F.array(cancel_step))).otherwise(kept)
    out = chain.select("case_id", "s0", all_steps.alias("_steps"))
    cols = []
    for r in range(1, _ROUNDS + 1):
        e = F.try_element_at(F.col("_steps"), F.lit(r))
        cols += [e["k"].alias(f"k{r}"), e["a"].alias(f"a{r}"), e["s"].alias(f"s{r}")]
    return out.select("case_id", "s0", *cols)


def _reason(start: Column) -> Column:
    a = F.col("action")
    perm_missing = F.when(~F.col("_perm"), F.lit(S.ERR_NO_PERMISSION))
    by_action = (
        F.when(a == "edit", F.coalesce(perm_missing, F.when(~start.isin(1, 2), F.lit(S.ERR_EDIT_STATUS))))
        .when(a == "claim", F.coalesce(perm_missing, F.when(start != 1, F.lit(S.ERR_CLAIM_STATUS))))
        .when(a == "submit", F.coalesce(perm_missing, F.when(start != 2, F.lit(S.ERR_SUBMIT_STATUS)),
                                        F.col("_submit_err"),
                                        F.when(F.col("_need_code"), F.lit(S.ERR_EMPLOYEE_CODE_REQUIRED))))
        .when(a == "approve", F.coalesce(perm_missing, F.when(start != 3, F.lit(S.ERR_APPROVE_STATUS))))
        .when(a == "set_translogica", F.coalesce(perm_missing, F.when(start != 4, F.lit(S.ERR_TRANSLOGICA_STATUS)),
                                                 F.when(~F.col("_flag_ok"), F.lit(S.ERR_TRANSLOGICA_BOOL))))
        .when(a == "cancel", F.coalesce(perm_missing, F.when(start == 4, F.lit(S.ERR_CANCEL_BOOKED)),
                                        F.when(start == 0, F.lit(S.ERR_CANCEL_CANCELLED))))
        .otherwise(F.lit(S.ERR_UNKNOWN_ACTION)))
    return (F.when(~F.col("_found"), F.lit(S.ERR_NOT_FOUND))
            .when(F.col("_forbidden"), F.lit(S.ERR_FORBIDDEN))
            .otherwise(by_action))


def replay(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame) -> DataFrame:
    """Every action's outcome when each case's log is applied in (ts, action_id) order.

    (action_id, case_id, actor_id, action, ts, start_status, end_status, accepted, reason).
    """
    # The facts feed the aggregate, both rounds and the final join: pin them
    # once (reliable checkpoint in the shared folder) instead of re-reading
    # and re-joining the action log for every use.
    facts = reliable_checkpoint(action_facts(actions, cases, users, roles))
    tr = transitions(facts)
    j = facts.join(tr.select("case_id", "k1", "s1", "k2", "s2", "k3", "s3"), "case_id", "left")
    k = F.col("_key")
    start = (F.when(F.col("k1").isNull() | (k <= F.col("k1")), F.col("_s0"))
             .when(F.col("k2").isNull() | (k <= F.col("k2")), F.col("s1"))
             .when(F.col("k3").isNull() | (k <= F.col("k3")), F.col("s2"))
             .otherwise(F.col("s3")))
    j = j.withColumn("start_status", start).withColumn("reason", _reason(F.col("start_status")))
    moved_to = (F.when(k == F.col("k1"), F.col("s1")).when(k == F.col("k2"), F.col("s2"))
                .when(k == F.col("k3"), F.col("s3")))
    extra = [c for c in ("translogica_transferred", "non_exchangeable_qty") if c in actions.columns]
    if "employee_code" in actions.columns:
        extra.append(F.col("_code_after").alias("employee_code_after"))
    return j.select(
        "action_id", "case_id", "actor_id", "action", "ts", "start_status",
        F.coalesce(moved_to, F.col("start_status")).alias("end_status"),
        F.col("reason").isNull().alias("accepted"), "reason", *extra)


def final_state(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """B6 result per case: status and stamps after the log, plus accepted / rejected counts.

    Stamps come from the accepted transition actions; the flag from the last
    accepted set_translogica.  All are partial aggregates per case.
    """
    o = outcomes
    acc = F.col("accepted")
    key = F.struct("ts", "action_id")
    aggs = [
        F.max_by(F.col("end_status"), key).alias("_last_status"),
        F.max(F.when(acc & (F.col("action") == "claim"), F.struct("ts", "actor_id"))).alias("_claim"),
        F.max(F.when(acc & (F.col("action") == "submit"), F.struct("ts", "actor_id"))).alias("_submit"),
        F.max(F.when(acc & (F.col("action") == "approve"), F.struct("ts", "actor_id"))).alias("_approve"),
        F.count_if(acc).alias("accepted"), F.count_if(~acc).alias("rejected"),
    ]
    if "translogica_transferred" in o.columns:
        aggs.append(F.max_by(F.when(acc & (F.col("action") == "set_translogica"), F.col("translogica_transferred")),
                             F.when(acc & (F.col("action") == "set_translogica"), key)).alias("_flag"))
    g = o.where(F.col("reason").isNull() | (F.col("reason") != S.ERR_NOT_FOUND)).groupBy("case_id").agg(*aggs)
    c = cases.select(F.col("id").alias("case_id"), "status", "claimed_by", "submitted_by", "approved_by")
    j = g.join(c, "case_id", "inner")
    return j.select(
        "case_id", F.col("_last_status").alias("status"),
        F.coalesce(F.col("_claim.actor_id"), F.col("claimed_by")).alias("claimed_by"),
        F.col("_claim.ts").alias("claimed_at"),
        F.coalesce(F.col("_submit.actor_id"), F.col("submitted_by")).alias("submitted_by"),
        F.col("_submit.ts").alias("submitted_at"),
        F.coalesce(F.col("_approve.actor_id"), F.col("approved_by")).alias("approved_by"),
        F.col("_approve.ts").alias("approved_at"),
        "accepted", "rejected", *(["_flag"] if "_flag" in g.columns else []))


def first_action_per_case(actions: DataFrame) -> DataFrame:
    """A batch with at most one action per case: each case's earliest action (partial ``min``)."""
    cols = [c for c in actions.columns if c not in ("case_id",)]
    m = actions.groupBy("case_id").agg(F.min(F.struct("ts", "action_id", *[c for c in cols if c not in ("ts", "action_id")])).alias("_m"))
    return m.select("case_id", *[F.col(f"_m.{c}").alias(c) for c in cols])


def apply_batch(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame,
                outcomes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply a batch of actions in (ts, action_id) order → (new case rows, rejected actions).

    A case may have several actions; its row appears once, after its last accepted action, with the
    actor of every accepted step, the submit's payload and the last transfer flag.  The stamps
    claimed_at, submitted_at and approved_at follow where the case table has them.  Rejects carry
    the reason.  ``outcomes``: the batch's replay, where the caller has it already.
    """
    if outcomes is None:
        outcomes = replay(actions, cases, users, roles)
    rejects = outcomes.where(~F.col("accepted")).select("action_id", "case_id", "actor_id", "action", "reason")
    has_nonx = "non_exchangeable_qty" in outcomes.columns
    has_code = "employee_code_after" in outcomes.columns
    has_flag = "translogica_transferred" in outcomes.columns

    def last(action: str, *fields) -> Column:
        return F.max(F.when(F.col("action") == action, F.struct("ts", "action_id", *fields))).alias("_" + action)

    ok = outcomes.where(F.col("accepted")).groupBy(F.col("case_id").alias("_cid")).agg(
        F.max(F.struct("ts", "action_id", "action", "end_status")).alias("_last"),
        last("claim", "actor_id"), last("approve", "actor_id"),
        last("submit", "actor_id",
             (F.col("non_exchangeable_qty") if has_nonx else F.lit(None).cast("int")).alias("nonx"),
             (F.col("employee_code_after") if has_code else F.lit(None).cast("string")).alias("code")),
        last("set_translogica", (F.col("translogica_transferred") if has_flag else F.lit(None).cast("boolean")).alias("flag")))
    c = cases.join(ok, cases["id"] == ok["_cid"], "left")

    def patched(col: str, action: str, value: str) -> Column:
        return F.when(F.col("_" + action).isNotNull(), F.col(f"_{action}.{value}")).otherwise(F.col(col))

    patch = {
        "status": F.coalesce(F.col("_last.end_status"), F.col("status")),
        "non_exchangeable_qty": F.coalesce(F.col("_submit.nonx"), F.col("non_exchangeable_qty")),
        "claimed_by": patched("claimed_by", "claim", "actor_id"), "claimed_at": patched("claimed_at", "claim", "ts"),
        "submitted_by": patched("submitted_by", "submit", "actor_id"), "submitted_at": patched("submitted_at", "submit", "ts"),
        "approved_by": patched("approved_by", "approve", "actor_id"), "approved_at": patched("approved_at", "approve", "ts"),
    }
    if has_code:
        patch["employee_code"] = patched("employee_code", "submit", "code")
    if has_flag:
        patch["translogica_transferred"] = patched("translogica_transferred", "set_translogica", "flag")
    new = c.select(*[patch.get(x, F.col(x)).alias(x) for x in cases.columns],
                   F.col("_last.action").alias("applied_action"), F.col("_last.ts").alias("updated_at"))
    return new.select(*cases.columns, "applied_action", "updated_at"), rejects


def approvals(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """Accepted approvals joined to their case, ready for numbering (B3) and posting (B1)."""
    a = outcomes.where(F.col("accepted") & (F.col("action") == "approve")).select(
        "case_id", F.col("actor_id").alias("approved_by"), F.col("ts").alias("approved_at"), "action_id")
    c = cases.drop("approved_by", "approved_at")
    return c.join(a, c["id"] == a["case_id"], "inner").drop("case_id")


def commit_batch(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame,
                 locations: DataFrame, *, receipt_start: int, day) -> tuple[DataFrame, DataFrame, DataFrame]:
    """B5 end to end: apply a batch, number the approvals, post them.

    → (new case rows with receipt numbers on approved cases, ledger lines of
    the approvals, rejected actions).  Approvals are numbered consecutively
    from ``receipt_start`` in (ts, action_id) order (B3) and posted as 0-2
    lines each (B1) with the approver as the line's user.
    """
    from carrierbook.operators import posting
    outcomes = reliable_checkpoint(replay(actions, cases, users, roles))
    new, rejects = apply_batch(actions, cases, users, roles, outcomes)
    # The rows after the batch: a submit before the approval may have changed the quantities.
    appr = approvals(outcomes, new.select(*cases.columns))
    numbered = posting.assign_receipt_numbers(appr, locations, order=["approved_at", "action_id"],
                                              start=receipt_start, day=day)
    lines = posting.post_cases(numbered)
    rno = numbered.select(F.col("id").alias("_nid"), F.col("receipt_no").alias("_rno"))
    snap = new.join(rno, new["id"] == rno["_nid"], "left") \
        .withColumn("receipt_no", F.coalesce(F.col("_rno"), F.col("receipt_no"))).drop("_nid", "_rno")
    return snap.select(*new.columns), lines, rejects


def apply_edits(edits: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B5 ``edit`` with payloads: a batch of edits → (new case rows, rejects).

    A case's edits apply in (ts, action_id) order and its row appears once; each edit is checked against what
    the ones before it set, by the reference's rules in their order (a NULL payload field means "not
    sent").  Accepted edits are COALESCE patches; non_exchangeable_qty and employee_code change only in
    status 2.  ``updated_at`` is the time of the last accepted edit.
    """
    from carrierbook.operators import payload_replay
    new, rejects = payload_replay.apply_log(edits.withColumn("action", F.lit("edit")), cases, users, roles)
    return new.drop("applied_action"), rejects.drop("action")
