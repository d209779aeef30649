"""Notices by audience (M1, M2, J7): one row per case and audience, expanded to its readers when they read.

A notice goes to everyone of a location or of a department but one user.  Written out per user, new cases times users
of their location is the largest table of the application; by audience it is one row per case.  The
membership table says who reads what, one row per user and audience.  A user may also be an audience alone
(notices given per user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carrierbook.operators.numbering import number_rows
from carrierbook.operators.skew import meet_spread
from carrierbook.sources import schema as S

LOCATION, DEPARTMENT, USER = "location", "department", "user"
NOTICE_COLUMNS = ["case_id", "title", "audience", "audience_id", "except_user", "message"]


def members(users: DataFrame) -> DataFrame:
    """(audience, audience_id, user_id): the audiences of every active user, at most three rows each."""
    rows = F.array(F.struct(F.lit(LOCATION).alias("audience"), F.col("location_id").alias("audience_id")),
                   F.struct(F.lit(DEPARTMENT).alias("audience"), F.col("fixed_department_id").alias("audience_id")),
                   F.struct(F.lit(USER).alias("audience"), F.col("id").alias("audience_id")))
    return (users.where(F.col("is_active")).select(F.col("id").alias("user_id"), F.inline(rows))
            .where(F.col("audience_id").isNotNull()))


def _text(pattern: str, field: str, name, fallback: str, name_id):
    before, rest = pattern.split("{id}")
    middle, end = rest.split("{" + field + "}")
    fall, close = fallback.split("{id}")
    shown = F.coalesce(name, F.concat(F.lit(fall), name_id.cast("string"), F.lit(close)))
    return F.concat(F.lit(before), F.col("id").cast("string"), F.lit(middle), shown, F.lit(end))


def location_notices(new_cases: DataFrame, locations: DataFrame) -> DataFrame:
    """M1: the notice of each new case to the users of its location, except its creator."""
    at = locations.select(F.col("id").alias("_lid"), F.col("name").alias("_lname"))
    c = new_cases.join(at, new_cases["location_id"] == at["_lid"], "left")
    return c.select(F.col("id").alias("case_id"), F.lit(S.TITLE_LOCATION).alias("title"), F.lit(LOCATION).alias("audience"),
                    F.col("location_id").alias("audience_id"), F.col("created_by").alias("except_user"),
                    _text(S.MSG_LOCATION, "location", F.col("_lname"), S.FALLBACK_LOCATION, F.col("location_id")).alias("message"))


def department_notices(submitted: DataFrame, departments: DataFrame) -> DataFrame:
    """M2: the notice of each submitted case to its department, except who submitted it (or created it, where
    that is not known); cases without a department notify nobody."""
    to = departments.select(F.col("id").alias("_did"), F.col("name").alias("_dname"))
    c = submitted.where(F.coalesce("department_id", F.lit(0)) != 0)
    c = c.join(to, c["department_id"] == to["_did"], "left")
    return c.select(F.col("id").alias("case_id"), F.lit(S.TITLE_DEPARTMENT).alias("title"), F.lit(DEPARTMENT).alias("audience"),
                    F.col("department_id").alias("audience_id"),
                    F.coalesce(F.nullif("submitted_by", F.lit(0)), F.col("created_by")).alias("except_user"),
                    _text(S.MSG_DEPARTMENT, "department", F.col("_dname"), S.FALLBACK_DEPARTMENT, F.col("department_id")).alias("message"))


def for_readers(notices: DataFrame, members_: DataFrame, readers: DataFrame | None = None, once: bool = False) -> DataFrame:
    """The notices of the given readers (user_id), or of everybody: (user_id and the notices' columns but the audience's).

    For some readers their few audiences are looked up first, so only their own notices are read.  ``once``: the distinct
    (user_id, case_id, title), without a shuffle of the rows written out (``_each_once``).
    """
    m = members_ if readers is None else members_.join(readers.select("user_id").distinct(), "user_id", "left_semi")
    if once:
        return _each_once(notices, m.distinct())
    kept = [c for c in notices.columns if c not in ("audience", "audience_id", "except_user")]
    return (notices.join(m, ["audience", "audience_id"]).where(~F.col("user_id").eqNullSafe(F.col("except_user")))
            .select("user_id", *kept))


def _each_once(notices: DataFrame, members_: DataFrame) -> DataFrame:
    """The distinct (user_id, case_id, title) of ``for_readers``; ``members_`` are distinct.

    Rows are made distinct while they are few, before they are written out per reader.  A notice that goes to one audience gives each
    of its readers one row.  What was given to users alone is at most one row each and left out where a group tells the user the
    same.  Only a notice that goes to several groups needs its readers compared.
    """
    notice, group = ["case_id", "title"], ["audience", "audience_id"]
    # One row per notice and audience; where two except different users, each is told by the other's.
    whom = F.struct(F.col("except_user"))
    one = (notices.where(F.col("audience").isNotNull() & F.col("audience_id").isNotNull()).groupBy(*notice, *group)
           .agg(F.min(whom).alias("_a"), F.max(whom).alias("_b"))
           .select(*notice, *group, F.col("_a.except_user").alias("except_user"), (~F.col("_a").eqNullSafe(F.col("_b"))).alias("_all")))
    told = F.col("_all") | ~F.col("user_id").eqNullSafe(F.col("except_user"))
    alone = F.col("audience") == USER
    groups, people = one.where(~alone), members_.where(~alone)
    where_to = groups.groupBy(*notice).agg((F.count(F.lit(1)) > 1).alias("_several"))
    g, w = groups.alias("g"), where_to.withColumnsRenamed({c: f"_{c}" for c in notice})
    dealt = g.join(w, g["case_id"].eqNullSafe(w["_case_id"]) & g["title"].eqNullSafe(w["_title"])).select("g.*", "_several")
    people = people.join(groups.select(*group).distinct(), group, "left_semi")
    by_group = meet_spread(dealt, people, group, notice).where(told)
    single = by_group.where(~F.col("_several")).select("user_id", *notice)
    several = by_group.where(F.col("_several")).select("user_id", *notice).distinct()
    own = one.where(alone).join(members_.where(alone), group).where(told).select("user_id", *notice).distinct()
    also = own.join(members_.where(~alone).withColumnRenamed("user_id", "_user"), F.col("user_id").eqNullSafe(F.col("_user"))).drop("_user")
    also = also.join(groups.withColumnsRenamed({c: f"_{c}" for c in [*notice, *group]}),
                     F.col("audience").eqNullSafe(F.col("_audience")) & F.col("audience_id").eqNullSafe(F.col("_audience_id"))
                     & F.col("case_id").eqNullSafe(F.col("_case_id")) & F.col("title").eqNullSafe(F.col("_title")))
    also = also.where(told).select(*[F.col(c).alias(f"_{c}") for c in ("user_id", *notice)])
    rest = own.join(also, F.col("user_id").eqNullSafe(F.col("_user_id")) & F.col("case_id").eqNullSafe(F.col("_case_id"))
                    & F.col("title").eqNullSafe(F.col("_title")), "left_anti")
    return single.unionByName(several).unionByName(rest)


def newest_for_readers(notices: DataFrame, members_: DataFrame, readers: DataFrame, n: int = 50) -> DataFrame:
    """L3 by audience: the ``n`` newest notices (case_id desc, title) of the given readers, (user_id, case_id, title).

    A reader's newest are among the first n + k of each of its audiences, k the notices there that the reader is
    excepted from; a notice excepts one user at most, so all the k add up to no more than the notices.  The
    audiences are ranked once and met by rank, never written out per reader.
    """
    audience = ["audience", "audience_id"]
    ranked = number_rows(notices.where(F.col("audience_id").isNotNull()).select(*audience, "except_user", "case_id", "title"),
                         [F.col("case_id").desc(), F.col("title"), F.col("except_user")], group=audience, out="_rank")
    total = ranked.groupBy(*audience).agg(F.count(F.lit(1)).alias("_total"))
    less = (ranked.where(F.col("except_user").isNotNull()).groupBy(*audience, F.col("except_user").alias("user_id"))
            .agg(F.count(F.lit(1)).alias("_less")))
    m = members_.join(readers.select("user_id").distinct(), "user_id", "left_semi")
    reach = F.least(F.col("_total"), F.lit(n).cast("long") + F.coalesce("_less", F.lit(0)))
    wanted = (m.join(total, audience).join(less, [*audience, "user_id"], "left")
              .select("user_id", *audience, F.explode(F.sequence(F.lit(1).cast("long"), reach)).alias("_rank")))
    own = wanted.join(ranked, [*audience, "_rank"]).where(~F.col("user_id").eqNullSafe(F.col("except_user")))
    order = Window.partitionBy("user_id").orderBy(F.col("case_id").desc(), "title")
    return (own.select("user_id", "case_id", "title").withColumn("_rn", F.row_number().over(order))
            .where(F.col("_rn") <= n).drop("_rn"))


def unread_counts(notices: DataFrame, members_: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """A5 over all users without a row per user and notice: (user_id, items, unread).

    An audience's notices are counted once; a user's count adds up the audiences, less the notices that the user is
    excepted from and, for ``unread``, the marks (user_id, case_id, title) that the user has made.
    """
    total = notices.groupBy("audience", "audience_id").agg(F.count(F.lit(1)).alias("n"))
    # Notices a member is excepted from: at most one user per notice.
    less = (notices.join(members_.withColumnRenamed("user_id", "except_user"), ["audience", "audience_id", "except_user"])
            .groupBy(F.col("except_user").alias("user_id")).agg(F.count(F.lit(1)).alias("less")))
    counts = members_.join(total, ["audience", "audience_id"]).groupBy("user_id").agg(F.sum("n").alias("n"))
    counts = counts.join(less, "user_id", "left").withColumn("items", F.col("n") - F.coalesce("less", F.lit(0)))
    if marks is None:
        return counts.select("user_id", "items", F.col("items").alias("unread")).where(F.col("items") > 0)
    read = (marks.select("user_id", "case_id", "title").distinct().join(notices, ["case_id", "title"])
            .where(~F.col("user_id").eqNullSafe(F.col("except_user"))).join(members_, ["audience", "audience_id", "user_id"], "left_semi")
            .groupBy("user_id").agg(F.count(F.lit(1)).alias("seen")))
    return (counts.join(read, "user_id", "left").where(F.col("items") > 0)
            .select("user_id", "items", (F.col("items") - F.coalesce("seen", F.lit(0))).alias("unread")))
