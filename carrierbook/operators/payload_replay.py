"""Replay of action logs whose edits and submits carry payloads.

An edit can change the quantities and the employee code that later edits and submits are checked
against, so an action's outcome depends on all earlier ones of its case.  No case is gathered:

1. *Facts.*  Everything that does not depend on the evolving case (permissions, location lock, formats, signs)
   becomes columns.  What is left of an action is its move: how it turns a case's state (status, qty_in,
   qty_out, whether an employee code is stored) into the next one.
2. *Ranges.*  The log is range-partitioned and sorted on (case, time, action) and pinned, so a case that holds a
   third of the log is spread over as many tasks as its rows are worth.
3. *Maps.*  Only the cases that reach over a partition's edge need more.  Their rows in one partition become a
   map from the state met to the state left: a list of branches, each with the bounds on the state for which
   it holds and what it sets.  A map that would pass ``MOST_BRANCHES`` is closed and a further one begun,
   so maps are bounded whatever the log holds, and exact.
4. *Chaining.*  A case's maps, a few per partition, are applied in order to its stored state; that gives the
   state every partition begins with.
5. *Walk.*  Each partition walks its rows once from those states and adds to every action the state it met.
   The reasons and the case rows are plain columns and aggregates from there.

Defined results: actions of unknown cases are rejected (``Not found``); equal times go by action id; a
missing actor has no permission; a null payload field means "not sent" (an employee code that was sent
blank is the empty text); null quantities count as 0 in checks.
"""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.functions import rules as R
from carrierbook.functions.text import trim_to_null
from carrierbook.operators import lifecycle
from carrierbook.operators.skew import join_heavy
from carrierbook.session import reliable_checkpoint, worker_imports
from carrierbook.sources import schema as S

PAYLOAD = {"department_id": "int", "license_plate": "string", "entrepreneur": "string", "note": "string", "qty_in": "int",
           "qty_out": "int", "non_exchangeable_qty": "int", "employee_code": "string", "product_type": "string",
           "translogica_transferred": "boolean"}

# Moves.  EDIT_ANY is valid in status 1 and 2, EDIT_CLAIMED in status 2 alone (it has a quantity or code that needs it).
NOTHING, CLAIM, SUBMIT, APPROVE, CANCEL, EDIT_ANY, EDIT_CLAIMED = range(7)
NOT_SENT, BLANK, GIVEN = range(3)  # what an action says about the employee code

MOST_BRANCHES = 64
_NO, _FAR = -(1 << 62), 1 << 62


# --- moves ----------------------------------------------------------------------------------------

def step(state: tuple, move: tuple) -> tuple:
    """The state (status, qty_in, qty_out, has_code) after a move (kind, qty_in, qty_out, least, code, need)."""
    status, held_in, held_out, has_code = state
    kind, new_in, new_out, least, code, need = move
    if kind == CLAIM:
        return (2, *state[1:]) if status == 1 else state
    if kind == APPROVE:
        return (4, *state[1:]) if status == 3 else state
    if kind == CANCEL:
        return (0, *state[1:]) if status in (1, 2, 3) else state
    if kind in (EDIT_ANY, EDIT_CLAIMED):
        if status != 2 and not (status == 1 and kind == EDIT_ANY):
            return state
        next_in = held_in if new_in is None else new_in
        next_out = held_out if new_out is None else new_out
        if least > 0 and next_in - next_out < least:
            return state
        return status, next_in, next_out, has_code if code == NOT_SENT else code == GIVEN
    if kind == SUBMIT and status == 2:
        after = has_code if code == NOT_SENT else code == GIVEN
        if (least > 0 and held_in - held_out < least) or (need and not after):
            return state
        return 3, held_in, held_out, after
    return state


# --- maps -----------------------------------------------------------------------------------------
# A branch is [status met, code met (-1: either), bounds of qty_in, of qty_out and of their difference (low, high each),
# status left, qty_in set, qty_out set (_NO: kept), code left (-1: kept)].

def _identity() -> list[list[int]]:
    return [[status, -1, _NO, _FAR, _NO, _FAR, _NO, _FAR, status, _NO, _NO, -1] for status in range(5)]


def _split(branch: list[int], low: int, least: int) -> tuple[list[int] | None, list[int] | None]:
    """The parts of a branch where the quantity bounded at ``low`` reaches ``least``, and where it does not."""
    yes, no = list(branch), list(branch)
    yes[low], no[low + 1] = max(branch[low], least), min(branch[low + 1], least - 1)
    return (yes if yes[low] <= yes[low + 1] else None), (no if no[low] <= no[low + 1] else None)


def _reaching(branch: list[int], new_in: int | None, new_out: int | None, least: int):
    """Split by qty_in - qty_out >= least after the given quantities."""
    known_in = new_in if new_in is not None else (branch[9] if branch[9] != _NO else None)
    known_out = new_out if new_out is not None else (branch[10] if branch[10] != _NO else None)
    if least <= 0 or (known_in is not None and known_out is not None and known_in - known_out >= least):
        return branch, None
    if known_in is not None and known_out is not None:
        return None, branch
    if known_out is not None:
        return _split(branch, 2, known_out + least)
    if known_in is not None:  # qty_out <= known_in - least
        no, yes = _split(branch, 4, known_in - least + 1)
        return yes, no
    return _split(branch, 6, least)


def _coded(branch: list[int]):
    """Split by whether an employee code is stored."""
    known = branch[11] if branch[11] >= 0 else branch[1]
    if known >= 0:
        return (branch, None) if known else (None, branch)
    yes, no = list(branch), list(branch)
    yes[1], no[1] = 1, 0
    return yes, no


def _advance(branches: list[list[int]], move: tuple) -> list[list[int]]:
    kind, new_in, new_out, least, code, need = move
    out = []
    for b in branches:
        status = b[8]
        if kind in (EDIT_ANY, EDIT_CLAIMED) and (status == 2 or (status == 1 and kind == EDIT_ANY)):
            yes, no = _reaching(b, new_in, new_out, least)
            if yes is not None:
                yes = list(yes)
                yes[9] = yes[9] if new_in is None else new_in
                yes[10] = yes[10] if new_out is None else new_out
                yes[11] = yes[11] if code == NOT_SENT else int(code == GIVEN)
                out.append(yes)
            if no is not None:
                out.append(no)
        elif kind == SUBMIT and status == 2:
            yes, no = _reaching(b, None, None, least)
            parts = [] if no is None else [no]
            if yes is not None:
                left = code == GIVEN
                if code == NOT_SENT and need:
                    yes, no = _coded(yes)
                    parts += [] if no is None else [no]
                elif need and not left:
                    parts.append(yes)
                    yes = None
            if yes is not None:
                yes = list(yes)
                yes[8] = 3
                yes[11] = yes[11] if code == NOT_SENT else int(code == GIVEN)
                parts.append(yes)
            out += parts
        elif kind in (CLAIM, APPROVE, CANCEL):
            b = list(b)
            b[8] = step((status, 0, 0, False), move)[0]
            out.append(b)
        else:
            out.append(b)
    return out


def apply_map(flat: list[int], state: tuple) -> tuple:
    """The state that a map (its branches one after the other) makes of ``state``."""
    status, held_in, held_out, has_code = state
    for k in range(0, len(flat), 12):
        b = flat[k:k + 12]
        if (b[0] == status and b[1] in (-1, int(has_code)) and b[2] <= held_in <= b[3] and b[4] <= held_out <= b[5]
                and b[6] <= held_in - held_out <= b[7]):
            return b[8], held_in if b[9] == _NO else b[9], held_out if b[10] == _NO else b[10], has_code if b[11] < 0 else bool(b[11])
    raise ValueError("no branch holds for the state")


def maps_of(moves) -> list[list[int]]:
    """The maps that moves, in order, amount to: mostly one, more where one would pass ``MOST_BRANCHES``."""
    out, branches = [], _identity()
    for move in moves:
        grown = _advance(branches, move)
        if len(grown) > MOST_BRANCHES:
            out.append([v for b in branches for v in b])
            grown = _advance(_identity(), move)
        branches = grown
    return [*out, [v for b in branches for v in b]]


# --- facts ----------------------------------------------------------------------------------------

def _facts(actions: DataFrame, cases: DataFrame, rights: DataFrame) -> DataFrame:
    """The log with its payload columns, the checks that need no state, the move and the stored state."""
    a = actions
    for name, kind in PAYLOAD.items():
        if name not in a.columns:
            a = a.withColumn(name, F.lit(None).cast(kind))
    c = cases.select(F.col("id").alias("case_id"), F.col("location_id").alias("_loc"), F.col("status").alias("_s0"),
                     F.coalesce("qty_in", F.lit(0)).alias("_in0"), F.coalesce("qty_out", F.lit(0)).alias("_out0"),
                     (F.coalesce("employee_code", F.lit("")) != "").alias("_code0"))
    a = join_heavy(a, c, "case_id", ["action_id"])
    # One clerk or service account may send most of a log.
    a = join_heavy(a, rights, "actor_id", ["action_id"], seen_in=actions)
    perm = F.lit(False)
    for act, path in lifecycle.ACTION_PERMISSION.items():
        perm = F.when(F.col("action") == act, F.col("_p_" + path.replace(".", "_"))).otherwise(perm)
    code = R.employee_code_value("employee_code")
    sent = F.col("employee_code").isNotNull()
    nonx = F.col("non_exchangeable_qty")
    a = a.withColumns({
        "_found": F.col("_loc").isNotNull(),
        "_forbidden": F.coalesce(F.col("_lock") != F.col("_loc"), F.lit(False)),
        "_perm": F.coalesce(perm, F.lit(False)),
        "_need": F.coalesce(F.col("_p_cases_require_employee_code"), F.lit(False)),
        "_code": F.when(sent, code),
        "_plate_err": F.when(F.col("license_plate").isNotNull(), R.plate_error("license_plate")),
        "_qty_err": R.first_reason(F.when(F.col("qty_in") < 0, F.lit(S.ERR_QTY_IN)), F.when(F.col("qty_out") < 0, F.lit(S.ERR_QTY_OUT)),
                                   F.when(nonx < 0, F.lit(S.ERR_NON_EXCH))),
        "_product_err": F.when(F.col("product_type").isNotNull(), R.product_error("product_type")),
        "_code_err": F.when(sent, R.employee_code_error("employee_code")),
    })
    allowed = F.col("_found") & ~F.col("_forbidden") & F.col("_perm")
    act = F.col("action")
    edit_ok = F.col("_plate_err").isNull() & F.col("_qty_err").isNull() & F.col("_product_err").isNull()
    claimed_ok = edit_ok & F.col("_code_err").isNull() & ~(sent & F.col("_need") & F.col("_code").isNull())
    submit_ok = ~F.coalesce(nonx < 0, F.lit(False)) & F.col("_code_err").isNull()
    move = (F.when(~allowed, NOTHING).when(act == "claim", CLAIM).when(act == "approve", APPROVE).when(act == "cancel", CANCEL)
            .when((act == "edit") & edit_ok & nonx.isNull() & ~sent, EDIT_ANY).when((act == "edit") & claimed_ok, EDIT_CLAIMED)
            .when((act == "submit") & submit_ok, SUBMIT).otherwise(NOTHING))
    return a.withColumn("_move", move.cast("int")).select(
        "action_id", "case_id", "actor_id", "action", "ts", *PAYLOAD, "_found", "_forbidden", "_perm", "_need", "_code",
        "_plate_err", "_qty_err", "_product_err", "_code_err", "_move", F.coalesce(nonx, F.lit(0)).alias("_least"),
        F.when(~sent, NOT_SENT).when(F.col("_code").isNull(), BLANK).otherwise(GIVEN).cast("int").alias("_sent"),
        F.coalesce("_s0", F.lit(-1)).alias("_s0"), F.coalesce("_in0", F.lit(0)).alias("_in0"),
        F.coalesce("_out0", F.lit(0)).alias("_out0"), F.coalesce("_code0", F.lit(False)).alias("_code0"))


_STORED = ["_s0", "_in0", "_out0", "_code0"]
_MOVE = ["_move", "qty_in", "qty_out", "_least", "_sent", "_need"]


def _rows(batch: pa.RecordBatch, names: list[str]):
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def _part_maps(batches):
    """The maps of each case's rows in one partition (rows of a case follow each other, none are held)."""
    rows = (row for batch in batches for row in _rows(batch, ["case_id", "_part", *_STORED, *_MOVE]))
    for (case_id, part), own in itertools.groupby(rows, lambda row: row[:2]):
        first = next(own)
        stored = first[2:6]
        found = maps_of(row[6:] for row in itertools.chain([first], own))
        n = len(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([case_id] * n, pa.int32()), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int32()),
             pa.array(found, pa.list_(pa.int64())), *(pa.array([v] * n, t) for v, t in
                                                      zip(stored, (pa.int32(), pa.int32(), pa.int32(), pa.bool_())))],
            names=["case_id", "_part", "_nr", "_map", *_STORED])


def _chain(batches):
    """The state before each partition's rows of a case, from its maps in order."""
    at = state = None
    out = []
    for batch in batches:
        for case_id, part, nr, one, *stored in _rows(batch, ["case_id", "_part", "_nr", "_map", *_STORED]):
            if case_id != at:
                at, state = case_id, tuple(stored)
            if nr == 0:
                out.append((case_id, part, *state))
            state = apply_map(one, state) if state[0] >= 0 else state
    if out:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["case_id", "_part", *_STORED])


def _walker(begins: dict):
    """Adds to every row the state its action met."""
    def walk(batches):
        at = state = None
        for batch in batches:
            met = []
            for case_id, part, *rest in _rows(batch, ["case_id", "_part", *_STORED, *_MOVE]):
                if case_id != at:
                    at, state = case_id, begins.get((case_id, part)) or tuple(rest[:4])
                met.append(state)
                if state[0] >= 0:
                    state = step(state, tuple(rest[4:]))
            columns = list(zip(*met)) if met else [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds))],
                                             names=[*batch.schema.names, "_st", "_in", "_out", "_has"])
    return walk


def _met(facts: DataFrame) -> DataFrame:
    """``facts`` with the state that each action met (_st, _in, _out, _has) and its place ``_seq`` in the log's order."""
    worker_imports(facts.sparkSession)
    keys = ["case_id", "ts", "action_id"]
    placed = reliable_checkpoint(facts.repartitionByRange(*keys).sortWithinPartitions(*keys)
                                 .withColumn("_seq", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright(F.col("_seq"), 33))
    # One row per partition: its first and last case.  A case over an edge is the last of one and the first of the next.
    edges = placed.groupBy("_part").agg(F.min("case_id").alias("a"), F.max("case_id").alias("b")).orderBy("_part").collect()
    over = {x["b"] for x, y in zip(edges, edges[1:]) if x["b"] == y["a"]}
    parts = [(e["_part"], c) for e in edges for c in {e["a"], e["b"]} if c in over]
    begins = {}
    if parts:
        wanted = facts.sparkSession.createDataFrame(parts, "_part long, case_id int")
        rows = placed.select("_part", *_STORED, *_MOVE, "case_id").join(F.broadcast(wanted), ["_part", "case_id"], "left_semi")
        stored = "_s0 int, _in0 int, _out0 int, _code0 boolean"
        maps = rows.mapInArrow(_part_maps, f"case_id int, _part long, _nr int, _map array<long>, {stored}")
        chained = (maps.repartition("case_id").sortWithinPartitions("case_id", "_part", "_nr")
                   .mapInArrow(_chain, f"case_id int, _part long, {stored}"))
        # At most two rows per partition.
        begins = {(r["case_id"], r["_part"]): (r["_s0"], r["_in0"], r["_out0"], r["_code0"]) for r in chained.collect()}
    out = T.StructType([*placed.schema.fields, T.StructField("_st", T.IntegerType()), T.StructField("_in", T.IntegerType()),
                        T.StructField("_out", T.IntegerType()), T.StructField("_has", T.BooleanType())])
    return placed.mapInArrow(_walker(begins), out)


# --- outcomes -------------------------------------------------------------------------------------

def _reason() -> Column:
    """The first failing rule of the reference's order, in the state the action met."""
    st, act, nonx = F.col("_st"), F.col("action"), F.col("non_exchangeable_qty")
    sent = F.col("employee_code").isNotNull()
    no_perm = F.when(~F.col("_perm"), F.lit(S.ERR_NO_PERMISSION))

    def room(in_, out_):
        return F.greatest(in_ - out_, F.lit(0))

    edit = R.first_reason(
        no_perm, F.when(~st.isin(1, 2), F.lit(S.ERR_EDIT_STATUS)), F.col("_plate_err"), F.col("_qty_err"),
        F.when((st != 2) & nonx.isNotNull(), F.lit(S.ERR_NON_EXCH_STATUS)),
        F.when((st == 2) & (nonx > room(F.coalesce("qty_in", "_in"), F.coalesce("qty_out", "_out"))), F.lit(S.ERR_NON_EXCH_SOLL)),
        F.col("_product_err"), F.when(sent & (st != 2), F.lit(S.ERR_EMPLOYEE_CODE_STATUS)), F.col("_code_err"),
        F.when(sent & F.col("_need") & F.col("_code").isNull(), F.lit(S.ERR_EMPLOYEE_CODE_REQUIRED)))
    submit = R.first_reason(
        no_perm, F.when(st != 2, F.lit(S.ERR_SUBMIT_STATUS)), F.when(nonx < 0, F.lit(S.ERR_NON_EXCH)),
        F.when(nonx > room(F.col("_in"), F.col("_out")), F.lit(S.ERR_NON_EXCH_SOLL)), F.col("_code_err"),
        F.when(F.col("_need") & ~F.when(sent, F.col("_code").isNotNull()).otherwise(F.col("_has")), F.lit(S.ERR_EMPLOYEE_CODE_REQUIRED)))
    by_action = (
        F.when(act == "edit", edit).when(act == "submit", submit)
        .when(act == "claim", F.coalesce(no_perm, F.when(st != 1, F.lit(S.ERR_CLAIM_STATUS))))
        .when(act == "approve", F.coalesce(no_perm, F.when(st != 3, F.lit(S.ERR_APPROVE_STATUS))))
        .when(act == "set_translogica", F.coalesce(no_perm, F.when(st != 4, F.lit(S.ERR_TRANSLOGICA_STATUS)),
                                                   F.when(F.col("translogica_transferred").isNull(), F.lit(S.ERR_TRANSLOGICA_BOOL))))
        .when(act == "cancel", F.coalesce(no_perm, F.when(st == 4, F.lit(S.ERR_CANCEL_BOOKED)),
                                          F.when(st == 0, F.lit(S.ERR_CANCEL_CANCELLED))))
        .otherwise(F.lit(S.ERR_UNKNOWN_ACTION)))
    return F.when(~F.col("_found"), F.lit(S.ERR_NOT_FOUND)).when(F.col("_forbidden"), F.lit(S.ERR_FORBIDDEN)).otherwise(by_action)


def replay(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame, rights: DataFrame | None = None) -> DataFrame:
    """Every action's outcome when each case's log is applied in (ts, action_id) order, payloads included.

    (action_id, case_id, actor_id, action, ts, start_status, end_status, accepted, reason, start_qty_in, start_qty_out,
    the payload columns as sent, seq).  ``seq`` ascends in a case's order.
    ``rights``: ``lifecycle.actor_rights`` of the users and roles, where the caller has them already.
    """
    if rights is None:
        rights = lifecycle.actor_rights(users, roles)
    met = _met(_facts(actions, cases, rights)).withColumn("reason", _reason())
    ok = F.col("reason").isNull()
    known = F.col("_st") >= 0
    to = F.create_map(*[F.lit(x) for pair in (("claim", 2), ("submit", 3), ("approve", 4), ("cancel", 0)) for x in pair])
    start = F.when(known, F.col("_st"))
    return met.select(
        "action_id", "case_id", "actor_id", "action", "ts", start.alias("start_status"),
        F.when(ok, F.coalesce(F.try_element_at(to, "action"), start)).otherwise(start).alias("end_status"),
        ok.alias("accepted"), "reason", F.when(known, F.col("_in")).alias("start_qty_in"),
        F.when(known, F.col("_out")).alias("start_qty_out"), *PAYLOAD, F.col("_seq").alias("seq"))


def _patches() -> dict[str, tuple[Column, Column]]:
    """Per case column: when an accepted action sets it, and to what."""
    act, st = F.col("action"), F.col("start_status")
    edit, submit = act == "edit", act == "submit"
    entrepreneur, note = trim_to_null("entrepreneur"), trim_to_null("note")
    return {
        "status": (act.isin("claim", "submit", "approve", "cancel"), F.col("end_status")),
        "department_id": (edit & (F.coalesce("department_id", F.lit(0)) != 0), F.col("department_id")),
        "license_plate": (edit & F.col("license_plate").isNotNull(), R.plate_value("license_plate")),
        "entrepreneur": (edit & entrepreneur.isNotNull(), entrepreneur),
        "note": (edit & note.isNotNull(), note),
        "qty_in": (edit & F.col("qty_in").isNotNull(), F.col("qty_in")),
        "qty_out": (edit & F.col("qty_out").isNotNull(), F.col("qty_out")),
        "product_type": (edit & F.col("product_type").isNotNull(), R.product_value("product_type")),
        "non_exchangeable_qty": ((submit | (edit & (st == 2))) & F.col("non_exchangeable_qty").isNotNull(), F.col("non_exchangeable_qty")),
        "employee_code": ((submit | edit) & F.col("employee_code").isNotNull(), R.employee_code_value("employee_code")),
        "claimed_by": (act == "claim", F.col("actor_id")), "claimed_at": (act == "claim", F.col("ts")),
        "submitted_by": (submit, F.col("actor_id")), "submitted_at": (submit, F.col("ts")),
        "approved_by": (act == "approve", F.col("actor_id")), "approved_at": (act == "approve", F.col("ts")),
        "translogica_transferred": (act == "set_translogica", F.col("translogica_transferred")),
        "applied_action": (F.lit(True), act), "updated_at": (F.lit(True), F.col("ts")),
    }


def case_rows(outcomes: DataFrame, cases: DataFrame) -> DataFrame:
    """The case table after a replay: one row per case with ``applied_action`` and ``updated_at`` of its last accepted action
    (null for cases without one, unless the table has these columns).

    Numbers find the last action that set each column (a hash aggregate that combines before its
    shuffle); only those actions, a bounded few per case, are looked up for their values.
    """
    patches = {c: p for c, p in _patches().items() if c in cases.columns or c in ("applied_action", "updated_at")}
    ok = outcomes.where("accepted")
    last = ok.groupBy("case_id").agg(*[F.max(F.when(when, F.col("seq"))).alias(c) for c, (when, _) in patches.items()])
    # (seq, columns it sets): an action may be the last one for several columns.
    setters = (last.select(F.inline(F.array(*[F.struct(F.col(c).alias("seq"), F.lit(c).alias("col")) for c in patches])))
               .where(F.col("seq").isNotNull()).groupBy("seq").agg(F.collect_set("col").alias("_sets")))
    found = ok.join(setters, "seq").select(
        F.col("case_id").alias("_cid"),
        *[F.when(F.array_contains("_sets", c), F.struct(value.alias("v"))).alias("_" + c) for c, (_, value) in patches.items()])
    new = found.groupBy("_cid").agg(*[F.first("_" + c, ignorenulls=True).alias("_" + c) for c in patches])
    joined = cases.join(new, cases["id"] == new["_cid"], "left")
    return joined.select(*[(F.when(F.col("_" + c).isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) if c in patches else F.col(c)).alias(c)
                           for c in cases.columns],
                         *[F.col(f"_{c}.v").alias(c) for c in ("applied_action", "updated_at") if c not in cases.columns])


def apply_log(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B5 for a batch of any size, several actions per case included: (new case rows, rejected actions with reason)."""
    outcomes = reliable_checkpoint(replay(actions, cases, users, roles))
    return case_rows(outcomes, cases), outcomes.where(~F.col("accepted")).select("action_id", "case_id", "actor_id", "action", "reason")


def commit_log(actions: DataFrame, cases: DataFrame, users: DataFrame, roles: DataFrame, locations: DataFrame, *,
               receipt_start: int, day) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a batch, number its approvals in (ts, action_id) order from ``receipt_start`` (B3) and post them (B1).

    (new case rows with receipt numbers, ledger lines, rejected actions).  An approval posts the row as it
    stands then; nothing but the transfer flag can change after it.
    """
    from carrierbook.operators import posting

    outcomes = reliable_checkpoint(replay(actions, cases, users, roles))
    new = case_rows(outcomes, cases)
    approved = lifecycle.approvals(outcomes, new.select(*cases.columns))
    numbered = posting.assign_receipt_numbers(approved, locations, order=["approved_at", "action_id"], start=receipt_start, day=day)
    given = numbered.select(F.col("id").alias("_nid"), F.col("receipt_no").alias("_rno"))
    snap = new.join(given, new["id"] == given["_nid"], "left").withColumn("receipt_no", F.coalesce("_rno", "receipt_no"))
    rejects = outcomes.where(~F.col("accepted")).select("action_id", "case_id", "actor_id", "action", "reason")
    return snap.select(*new.columns), posting.post_cases(numbered), rejects
