"""Live cases from an action stream (T3): state by buckets, late actions, receipts, ledger lines, notices and changes.

Cases are dealt to ``buckets`` by the hash of their id.  Under ``folder`` (shared storage) every batch n writes, for the
buckets it touches alone, ``<table>/v=n/bucket=b``:

* ``log``       the batch's actions, as they came;
* ``base``      cases as they were before any action (given at the start, or created by a ``create`` action);
* ``cases``     the bucket's cases after the batch, with the last action applied to each;
* ``notices``   the live notices of the bucket's cases, by audience (T2);
* ``lines``     the ledger lines of the bucket's cases approved here (B1), with ids, group ids and times;
* ``outcomes``  every action judged in the batch;  ``events`` what changed (S5) at cases and in the ledger, numbered;
* ``notice-changes``  the notices that came and went, by audience, and ``readers`` who read them then.  What each reader is
  told follows from both: notices times readers, written out by ``LiveCases.events`` for who reads them.

A batch that is killed and run again reads the versions before itself, takes the same numbers
(``NumberAllocator``) and overwrites what it wrote (``Versions``).

*Late actions.*  An action at or before the last one applied to its case is late: the case goes back to its base
row and its whole log, the late action in its place, is replayed.  So any order of arrival ends in the same
cases, notices and lines as arrival in order.  A case keeps the receipt number that it once got, also while a
rewind takes its approval back, so numbers are never given twice.  An action delivered twice counts once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carrierbook.functions.receipt_no import receipt_number
from carrierbook.operators import audience, lifecycle, payload_replay, posting
from carrierbook.operators.numbering import number_rows
from carrierbook.session import path_exists, reliable_checkpoint
from carrierbook.sources import schema as S
from carrierbook.streaming import change_log
from carrierbook.streaming.allocator import NumberAllocator
from carrierbook.streaming.versions import Versions

CREATE = "create"
RECEIPTS, LINES = "receipts", "lines"
_OWN = T.StructType([T.StructField("_ts", T.TimestampNTZType()), T.StructField("_action", T.IntegerType()),
                     T.StructField("_number", T.LongType()), T.StructField("_receipt", T.StringType()),
                     T.StructField("_line", T.LongType()), T.StructField("_approved", T.TimestampNTZType())])
_NOTICE = T.StructType([T.StructField("case_id", T.IntegerType()), T.StructField("title", T.StringType()),
                        T.StructField("audience", T.StringType()), T.StructField("audience_id", T.IntegerType()),
                        T.StructField("except_user", T.IntegerType()), T.StructField("message", T.StringType()),
                        T.StructField("created_at", T.TimestampNTZType())])
_CHANGE = T.StructType([*[f for f in _NOTICE.fields if f.name not in ("message", "created_at")], T.StructField("came", T.BooleanType())])
_MEMBER = T.StructType([T.StructField("audience", T.StringType()), T.StructField("audience_id", T.IntegerType()),
                        T.StructField("user_id", T.IntegerType())])


def bucket_of(case_id, buckets: int):
    return F.pmod(F.xxhash64(case_id.cast("long")), F.lit(buckets)).cast("int")


class LiveCases:
    """``foreachBatch`` runner; also callable on plain DataFrames batch by batch."""

    def __init__(self, spark: SparkSession, folder: str, users: DataFrame, roles: DataFrame, locations: DataFrame, departments: DataFrame,
                 cases: DataFrame, *, notices: DataFrame | None = None, buckets: int = 64, receipt_start: int = 1, line_start: int = 1):
        self.spark, self.buckets, self.store = spark, buckets, Versions(spark, folder)
        self.users, self.roles, self.locations, self.departments = users, roles, locations, departments
        self.rights = reliable_checkpoint(lifecycle.actor_rights(users, roles))
        self.case_schema = cases.schema
        self.numbers = NumberAllocator(spark, os.path.join(folder, "numbers-receipts"), receipt_start)
        self.line_ids = NumberAllocator(spark, os.path.join(folder, "numbers-lines"), line_start)
        if self.last_batch() is None:
            dealt = cases.withColumn("bucket", bucket_of(F.col("id"), buckets))
            self.store.write("base", -1, dealt)
            self.store.write("cases", -1, dealt.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in _OWN.fields]))
            given = notices if notices is not None else spark.createDataFrame([], _NOTICE)
            self.store.write("notices", -1, given.select(*[F.col(f.name).cast(f.dataType) for f in _NOTICE.fields])
                        .withColumn("bucket", bucket_of(F.col("case_id"), buckets)))
            self.store.write("first-notices", -1, self._read("notices", {b: -1 for b in range(buckets)}))
            self.store.commit(-1, list(range(buckets)))

    def _schema(self, table: str) -> T.StructType:
        if table in ("cases", "base"):
            return T.StructType([*self.case_schema.fields, *(_OWN.fields if table == "cases" else [])])
        if table in ("notices", "first-notices"):
            return _NOTICE
        if table == "log":
            return T.StructType([*S.CASE_LOG.fields, T.StructField("location_id", T.IntegerType())])
        return T.StructType([*S.BOOKINGS.fields, T.StructField("case_id", T.IntegerType()), T.StructField("booking_group_id", T.StringType())])

    def _read(self, table: str, versions: dict[int, int]) -> DataFrame:
        return self.store.read(table, self._schema(table), versions)

    def last_batch(self) -> int | None:
        return self.store.last_batch()

    # --- views ------------------------------------------------------------------------------------

    def cases(self, before: int | None = None) -> DataFrame:
        """The case table after the last committed batch (before batch ``before``)."""
        return self._read("cases", self.store.current(before)).select(*self.case_schema.names)

    def lines(self) -> DataFrame:
        """The ledger lines of approvals made here, ready to be united with the ledger (B1)."""
        return self._read("lines", self.store.current()).drop("bucket")

    def notices(self, before: int | None = None) -> DataFrame:
        """The live notices by audience (``audience.for_readers`` gives them per reader)."""
        return self._read("notices", self.store.current(before)).drop("bucket")

    def events(self, batch: int) -> DataFrame:
        """What changed in a batch (S5): one row per event and channel, numbered in its channel.

        The readers' events are written out here, when they are read; where only other channels are wanted (``user_id is
        null``) Spark drops them from the plan.
        """
        kept = self.spark.read.parquet(self.store.place("events", batch))
        if not path_exists(self.spark, self.store.place("notice-changes", batch)):  # written before changes were kept by audience
            return kept
        changed = self.spark.read.schema(_CHANGE).parquet(self.store.place("notice-changes", batch))
        readers = self.spark.read.schema(_MEMBER).parquet(self.store.place("readers", batch)).where(F.col("user_id").isNotNull())
        told = change_log.notice_events(*self._told(changed, readers)).where(F.col("user_id").isNotNull())
        # A column that cannot be null, as the filter above has it, so that "user_id is null" is known to be false here.
        told = told.withColumn("user_id", F.coalesce("user_id", F.lit(0)))
        return kept.unionByName(change_log.numbered_by_reader(told, batch))

    # --- a batch ----------------------------------------------------------------------------------

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.store.write("log", batch_id, self._log_rows(batch))
        new = self._read("log", {b: batch_id for b in range(self.buckets)})
        touched = sorted(r[0] for r in new.select("bucket").distinct().collect())  # at most one per bucket
        versions = self.store.current(before=batch_id)
        old = self._read("cases", {b: versions[b] for b in touched if b in versions})
        self.store.write("base", batch_id, self._created(new, old))
        base = self.store.grown("base", self._schema("base"), batch_id, touched)

        late = reliable_checkpoint(self._late(new, old))
        rewound = late.limit(1).count() > 0
        actions = new
        if rewound:
            whole = self.store.grown("log", self._schema("log"), batch_id, touched).drop("v")
            actions = (new.join(late, "case_id", "left_anti")
                       .unionByName(whole.join(late, "case_id", "left_semi")))
        actions = actions.where(F.col("action") != CREATE).dropDuplicates(["action_id"])
        # The whole case table meets the batch's ids once; all that follows reads its cases alone.
        ids = actions.select(F.col("case_id").alias("id")).distinct().unionByName(late.withColumnRenamed("case_id", "id")).distinct()
        mine = reliable_checkpoint(old.join(ids, "id", "left_semi"))
        changed = mine.select(*self.case_schema.names, "bucket")
        if rewound:
            again = late.withColumnRenamed("case_id", "id")
            changed = reliable_checkpoint(changed.join(again, "id", "left_anti").unionByName(
                base.join(again, "id", "left_semi").select(*self.case_schema.names, "bucket")))

        outcomes = payload_replay.replay(actions, changed.select(*self.case_schema.names), self.users, self.roles, self.rights)
        outcomes.write.mode("overwrite").parquet(self.store.place("outcomes", batch_id))
        outcomes = self.spark.read.schema(outcomes.schema).parquet(self.store.place("outcomes", batch_id))
        rows = self._rows(outcomes, changed, mine)
        rows = self._numbered(rows, batch_id)
        untouched = old.join(rows.select("id"), "id", "left_anti")
        after = untouched.select(*rows.columns).unionByName(rows)
        self.store.write("cases", batch_id, after)
        after = self._read("cases", {b: batch_id for b in touched})

        notices_before = self._read("notices", {b: versions[b] for b in touched if b in versions})
        self.store.write("notices", batch_id, self._notices(notices_before, outcomes, after, late, base, touched))
        self.store.write("lines", batch_id, self._lines(after))
        now = {b: batch_id for b in touched}
        was = {b: versions[b] for b in touched if b in versions}
        told = self._notice_differences(self._read("notices", was), self._read("notices", now))
        told.write.mode("overwrite").parquet(self.store.place("notice-changes", batch_id))
        told = self.spark.read.schema(_CHANGE).parquet(self.store.place("notice-changes", batch_id))
        audience.members(self.users).distinct().write.mode("overwrite").parquet(self.store.place("readers", batch_id))
        alike = self._indistinct(old, untouched).select(*self.case_schema.names)
        events = (change_log.case_events(mine.select(*self.case_schema.names).unionByName(alike), rows.select(*self.case_schema.names).unionByName(alike))
                  .unionByName(change_log.ledger_events(self._read("lines", was), self._read("lines", now))))
        # Users without an id have no channel: their events are numbered with the others that have none.
        nameless = self.spark.read.schema(_MEMBER).parquet(self.store.place("readers", batch_id)).where(F.col("user_id").isNull())
        if nameless.limit(1).count():
            events = events.unionByName(change_log.notice_events(*self._told(told, nameless)))
        change_log.numbered(events, batch_id).write.mode("overwrite").parquet(self.store.place("events", batch_id))
        self.store.commit(batch_id, touched)

    def _log_rows(self, batch: DataFrame) -> DataFrame:
        fields = self._schema("log").fields
        have = set(batch.columns)
        rows = batch.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        return rows.withColumn("bucket", bucket_of(F.col("case_id"), self.buckets))

    def _created(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """The base rows of ``create`` actions; a case that is created again keeps its first creation."""
        made = new.where(F.col("action") == CREATE).join(old.select(F.col("id").alias("case_id")), "case_id", "left_anti")
        first = made.groupBy("case_id").agg(F.min("action_id").alias("action_id"))
        made = made.join(first, ["case_id", "action_id"], "left_semi").dropDuplicates(["case_id"])
        fixed = {"id": F.col("case_id"), "created_by": F.col("actor_id"), "status": F.lit(S.STATUS_ANNOUNCED), "created_at": F.col("ts"),
                 "non_exchangeable_qty": F.lit(0)}
        names = set(new.columns)
        return made.select(*[(fixed[f.name] if f.name in fixed else F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in self.case_schema.fields], "bucket")

    def _late(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """(case_id) of the cases to rewind: with an action not after the last one applied, or created now."""
        at = old.where(F.col("_ts").isNotNull()).select(F.col("id").alias("case_id"), "_ts", "_action")
        # The earliest new time decides but where it equals the last one applied.
        first = new.groupBy("case_id").agg(F.min("ts").alias("ts"))
        early = first.join(at, "case_id").where(F.col("ts") <= F.col("_ts"))
        tied = new.join(early.select("case_id", "_ts", "_action"), "case_id").where(
            (F.col("ts") < F.col("_ts")) | ((F.col("ts") == F.col("_ts")) & (F.col("action_id") <= F.col("_action"))))
        made = new.where(F.col("action") == CREATE).select("case_id")
        known = old.select(F.col("id").alias("case_id"))
        return tied.select("case_id").unionByName(made.join(known, "case_id", "left_anti")).distinct()

    def _rows(self, outcomes: DataFrame, changed: DataFrame, old: DataFrame) -> DataFrame:
        """The rows of the changed cases after their actions, with what this runner keeps of them."""
        rows = payload_replay.case_rows(outcomes, changed).select(*self.case_schema.names, "bucket")
        last = outcomes.groupBy("case_id").agg(F.max("seq").alias("seq"))
        last = outcomes.join(last, ["case_id", "seq"], "left_semi").select(F.col("case_id").alias("id"), F.col("ts").alias("_ts"),
                                                                           F.col("action_id").alias("_action"))
        approved = outcomes.where(F.col("accepted") & (F.col("action") == "approve")).select(
            F.col("case_id").alias("id"), F.col("ts").alias("_now_approved"), F.col("action_id").alias("_approval"))
        kept = old.select("id", "_number", "_receipt", "_line", F.col("_approved").alias("_was_approved"),
                          F.col("_ts").alias("_old_ts"), F.col("_action").alias("_old_action"))
        rows = rows.join(last, "id", "left").join(approved, "id", "left").join(kept, "id", "left")
        # A case that was approved here stays so while later actions (the transfer flag) come; a rewind decides anew.
        approved_at = F.when(F.col("status") == S.STATUS_BOOKED, F.coalesce("_now_approved", "_was_approved"))
        return rows.select(*self.case_schema.names, "bucket", F.coalesce("_ts", "_old_ts").alias("_ts"),
                           F.coalesce("_action", "_old_action").alias("_action"), "_number", "_receipt", "_line", approved_at.alias("_approved"),
                           "_approval")

    def _numbered(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Receipt numbers and line ids of the cases approved now for the first time, in the order of their approvals."""
        rows = reliable_checkpoint(rows)
        fresh = rows.where(F.col("_approved").isNotNull() & F.col("_number").isNull())
        count = fresh.count()
        first, line = self.numbers.take(RECEIPTS, batch_id, count), self.line_ids.take(LINES, batch_id, 2 * count)
        if count:
            given = number_rows(fresh.select("id", "_approved", "_approval", "location_id"), ["_approved", "_approval"], out="_k")
            at = self.locations.select(F.col("id").alias("location_id"), F.col("name").alias("_lname"))
            given = given.join(at, "location_id", "left").select(
                "id", (F.col("_k") + F.lit(first - 1)).alias("_n"), (F.lit(line) + 2 * (F.col("_k") - 1)).alias("_l"),
                receipt_number(F.col("_lname"), F.col("location_id"), F.to_date("_approved"), F.col("_k") + F.lit(first - 1)).alias("_r"))
            rows = (rows.join(given, "id", "left").withColumns({"_number": F.coalesce("_number", "_n"), "_receipt": F.coalesce("_receipt", "_r"),
                                                                "_line": F.coalesce("_line", "_l")}).drop("_n", "_l", "_r"))
        return rows.drop("_approval").withColumn("receipt_no", F.when(F.col("_approved").isNotNull(), F.col("_receipt")).otherwise(F.col("receipt_no")))

    def _lines(self, after: DataFrame) -> DataFrame:
        """The ledger lines of the cases approved here: line 1 and 2 have the two ids that the case was given."""
        posted = posting.post_cases(after.where(F.col("_approved").isNotNull()))
        own = after.select(F.col("id").alias("case_id"), "_line", F.col("_approved").alias("created_at"), "bucket")
        lines = posted.join(own, "case_id").withColumn("id", F.col("_line") + F.col("line_no") - 1)
        return lines.select(*[F.col(f.name).cast(f.dataType) for f in self._schema("lines").fields], "bucket")

    def _notices(self, was: DataFrame, outcomes: DataFrame, after: DataFrame, late: DataFrame, base: DataFrame, touched: list[int]) -> DataFrame:
        """The live notices of the touched buckets: the newest of a notice's creation and its deletes holds.

        A rewound case begins again with the notices it was given at the start and that of its creation.
        """
        names = [f.name for f in _NOTICE.fields]
        first = self._read("first-notices", {b: -1 for b in touched}).select(*names)
        made = base.where(F.col("v") >= 0).join(late.withColumnRenamed("case_id", "id"), "id", "left_semi")
        created = audience.location_notices(made, self.locations).join(
            made.select(F.col("id").alias("case_id"), "created_at"), "case_id").select(*names)
        held = (was.select(*names).join(late, "case_id", "left_anti")
                .unionByName(first.join(late, "case_id", "left_semi")).unionByName(created))
        ok = outcomes.where("accepted")
        # What takes notices away: (case, title), and the place in the case's order.
        gone = F.when(F.col("action") == "submit", F.array(F.lit(S.TITLE_LOCATION))).when(
            F.col("action") == "approve", F.array(F.lit(S.TITLE_DEPARTMENT))).when(
            F.col("action") == "cancel", F.array(F.lit(S.TITLE_LOCATION), F.lit(S.TITLE_DEPARTMENT)))
        deletes = (ok.where(gone.isNotNull()).select("case_id", F.explode(gone).alias("title"), "seq")
                   .groupBy("case_id", "title").agg(F.max("seq").alias("_gone")))
        sent = ok.where(F.col("action") == "submit").select(F.col("case_id").alias("id"), F.col("actor_id").alias("_by"),
                                                            F.col("ts").alias("_at"), F.col("seq").alias("_seq"))
        rows = after.select("id", "department_id", "created_by").join(sent, "id").withColumn("submitted_by", F.col("_by"))
        now = (audience.department_notices(rows, self.departments).join(rows.select(F.col("id").alias("case_id"), "_at", "_seq"), "case_id")
               .withColumn("created_at", F.col("_at")).select(*names, F.col("_seq").alias("_made")))
        # Notices held before come before every action of the batch.
        every = held.withColumn("_made", F.lit(-1).cast("long")).unionByName(now)
        live = every.join(deletes, ["case_id", "title"], "left").where(F.col("_gone").isNull() | (F.col("_made") > F.col("_gone")))
        live = live.select(*names).dropDuplicates(["case_id", "title", "audience", "audience_id"])
        return live.withColumn("bucket", bucket_of(F.col("case_id"), self.buckets))

    @staticmethod
    def _indistinct(old: DataFrame, untouched: DataFrame) -> DataFrame:
        """The untouched cases that no id tells apart: the comparison by id sees these as changed. Other untouched ones need none."""
        ids = old.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where((F.col("_n") > 1) | F.col("id").isNull()).select(F.col("id").alias("_id"))
        if not ids.limit(1).count():
            return untouched.where(F.lit(False))
        return untouched.join(ids, F.col("id").eqNullSafe(F.col("_id")), "left_semi")

    @staticmethod
    def _notice_differences(was: DataFrame, now: DataFrame) -> DataFrame:
        """The notices, by audience, that are in one of both tables alone; ``came``: in the newer one."""
        keys = [f.name for f in _CHANGE.fields if f.name != "came"]
        a, b = was.select(*keys), now.select(*keys)

        def without(x, y):
            on = [x[k].eqNullSafe(y[k]) for k in keys]
            rule = on[0]
            for k in on[1:]:
                rule = rule & k
            return x.join(y, rule, "left_anti")

        return without(a, b).withColumn("came", F.lit(False)).unionByName(without(b, a).withColumn("came", F.lit(True)))

    @staticmethod
    def _told(changed: DataFrame, readers: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Per reader the notices that went and that came."""
        return tuple(audience.for_readers(changed.where(F.col("came") == came).drop("came"), readers, once=True) for came in (False, True))

    def start(self, actions_stream: DataFrame, checkpoint: str):
        return (actions_stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
