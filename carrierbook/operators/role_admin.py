"""Business roles with their permissions: creation (W5), patch (W3) and audit (Q7).

Permissions are JSON: groups of leaves, each leaf true or false.  The routes store whatever object they are sent;
``permission_violations`` finds what the permission check would not understand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carrierbook.functions import rules as R
from carrierbook.functions.text import js_trim, trim_to_null
from carrierbook.operators.numbering import number_rows
from carrierbook.sources import schema as S

# The texts of the role routes.
ERR_NAME = "name required"
ERR_NAME_USED = "role name already exists"


def _is_object(json):
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(json)), F.lit("OBJECT")), F.lit(False))


def create_roles(requests: DataFrame, roles: DataFrame, *, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(request_id, name, permissions) → (new roles with ids in request order, rejects with reason).

    Names are trimmed and unique, among the roles and inside the batch, where the first request has the name.
    Permissions that are no JSON object are stored as ``{}``, as the route does.
    """
    r = requests.select("request_id", F.coalesce(js_trim(F.col("name")), F.lit("")).alias("name"), "permissions")
    first = r.where("name <> ''").groupBy("name").agg(F.min("request_id").alias("_first"))
    held = roles.select("name", F.lit(True).alias("_held"))
    r = r.join(first, "name", "left").join(held, "name", "left")
    r = r.withColumn("reason", R.first_reason(F.when(F.col("name") == "", F.lit(ERR_NAME)),
                                              F.when(F.col("_held") | (F.col("request_id") != F.col("_first")), F.lit(ERR_NAME_USED))))
    ok = r.where(F.col("reason").isNull()).select(
        "request_id", "name", F.when(_is_object(F.col("permissions")), F.col("permissions")).otherwise(F.lit("{}")).alias("permissions"))
    made = number_rows(ok, ["request_id"], start=next_id, out="id").select(F.col("id").cast("int").alias("id"), "name", "permissions")
    return made, r.where(F.col("reason").isNotNull()).select("request_id", "reason")


def patch_roles(roles: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(request_id, id, name, permissions) in request order → (roles, rejects).

    An empty name or permissions that are no object leave the field as it is.  A name that another role has after the
    batch is refused for all who ask for it and for it alone.
    """
    p = patches.select("request_id", "id", trim_to_null("name").alias("name"),
                       F.when(_is_object(F.col("permissions")), F.col("permissions")).alias("permissions"))
    known = p.join(roles.select("id"), "id", "left_semi")

    def last(column):
        return F.max(F.when(F.col(column).isNotNull(), F.struct("request_id", F.col(column).alias("v")))).alias(column)

    asked = known.groupBy("id").agg(last("name"), last("permissions"))
    want = asked.select("id", F.col("name.v").alias("_name"), F.col("name.request_id").alias("_request"), F.col("permissions.v").alias("_perms"))
    after = roles.join(want, "id", "left").withColumn("_new", F.coalesce("_name", "name"))
    shared = after.groupBy("_new").agg(F.count(F.lit(1)).alias("_n"))
    after = after.join(shared, "_new", "left")
    refused = (F.col("_n") > 1) & F.col("_name").isNotNull() & (F.col("_name") != F.col("name"))
    rejects = (after.where(refused).select(F.col("_request").alias("request_id"), F.lit(ERR_NAME_USED).alias("reason"))
               .unionByName(p.join(roles.select("id"), "id", "left_anti").select("request_id", F.lit(S.ERR_NOT_FOUND).alias("reason"))))
    new = after.select("id", F.when(refused, F.col("name")).otherwise(F.col("_new")).alias("name"),
                       F.coalesce("_perms", "permissions").alias("permissions"))
    return new, rejects


def _keys(json):
    """The keys of a JSON object as rows; none for anything else."""
    return F.explode(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def permission_violations(roles: DataFrame) -> DataFrame:
    """Q7: (id, path, problem) of every permission that the check does not know or cannot read.

    ``not an object`` (the permissions, or a group), ``unknown group``, ``unknown permission``, ``not a boolean``.  A null
    leaf is a stated override in the reference and no boolean either.
    """
    v = roles.select("id", F.coalesce("permissions", F.lit("{}")).alias("p"))
    whole = v.where(~_is_object(F.col("p"))).select("id", F.lit("$").alias("path"), F.lit("not an object").alias("problem"))
    group = v.where(_is_object(F.col("p"))).select("id", "p", _keys(F.col("p")).alias("grp"))
    known = F.col("grp").isin(*S.DEFAULT_PERMISSIONS)
    group = group.withColumn("g", F.to_json(F.try_variant_get(F.try_parse_json("p"), F.concat(F.lit("$['"), F.col("grp"), F.lit("']")), "variant")))
    strange = group.where(~known).select("id", F.col("grp").alias("path"), F.lit("unknown group").alias("problem"))
    flat = group.where(known & ~_is_object(F.col("g"))).select("id", F.col("grp").alias("path"), F.lit("not an object").alias("problem"))
    leaf = group.where(known & _is_object(F.col("g"))).select("id", "grp", "g", _keys(F.col("g")).alias("leaf"))
    path = F.concat("grp", F.lit("."), "leaf")
    value = F.schema_of_variant(F.try_variant_get(F.try_parse_json("g"), F.concat(F.lit("$['"), F.col("leaf"), F.lit("']")), "variant"))
    problem = (F.when(~path.isin(*S.permission_paths()), F.lit("unknown permission"))
               .when(F.coalesce(value, F.lit("VOID")) != "BOOLEAN", F.lit("not a boolean")))
    leaves = leaf.select("id", path.alias("path"), problem.alias("problem")).where(F.col("problem").isNotNull())
    return whole.unionByName(strange).unionByName(flat).unionByName(leaves)
