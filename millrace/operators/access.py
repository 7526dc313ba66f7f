"""Tenancy, roles, audit and uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.scaling import spread_join
from millrace.schemas import CONTINUE_ROLES, MIGRATION_VIEW_ROLES, VIEW_ROLES


def tenant_scope(rows: DataFrame, organizations: DataFrame, schema_name: str) -> DataFrame:
    """Rows of one tenant; an unknown tenant sees nothing."""
    active = organizations.where(F.col("schema_name") == schema_name).select("org_id")
    return rows.join(active, "org_id", "left_semi")


def organizations_of(
    organizations: DataFrame, memberships: DataFrame, user_id: int, is_staff: bool
) -> DataFrame:
    """Organizations one user may inspect, by name: all for staff, else those they run."""
    if is_staff:
        return organizations.orderBy("name")
    run_by = memberships.where(
        (F.col("user_id") == user_id) & F.col("role").isin(*MIGRATION_VIEW_ROLES)
    )
    return organizations.join(run_by, "org_id", "left_semi").orderBy("name")


def organizations_by_viewer(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """The organizations that every viewer may inspect: ``viewer, user_id, org_id, name``.

    Staff see all organizations, whoever they are, so they are one viewer
    (``staff``, without a user); every other user has a row per organization they
    run (``member``). A membership that repeats counts once. A user is staff
    where any of their memberships says so.
    """
    roles = memberships.groupBy("user_id", "org_id").agg(
        F.bool_or(F.col("role").isin(*MIGRATION_VIEW_ROLES)).alias("_runs"), F.bool_or("is_staff").alias("_staff")
    )
    staff = roles.where("_staff").select("user_id").distinct()
    run_by = roles.where("_runs").join(staff, "user_id", "left_anti")
    names = organizations.select("org_id", "name")
    members = spread_join(run_by, names, ["org_id"], ["user_id"]).select(
        F.lit("member").alias("viewer"), "user_id", "org_id", "name"
    )
    everything = names.select(
        F.lit("staff").alias("viewer"), F.lit(None).cast(memberships.schema["user_id"].dataType).alias("user_id"), "org_id", "name"
    )
    return members.unionByName(everything)


def visible_organizations(memberships: DataFrame, organizations: DataFrame) -> DataFrame:
    """How many organizations each user may inspect.

    Staff see all of them; that is one number, not one row per organization.
    """
    everything = organizations.agg(F.count(F.lit(1))).scalar()
    run_by = F.count_if(F.col("role").isin(*MIGRATION_VIEW_ROLES))
    return memberships.groupBy("user_id").agg(
        F.bool_or("is_staff").alias("is_staff"), run_by.alias("_own")
    ).select(
        "user_id",
        "is_staff",
        F.when(F.col("is_staff"), everything).otherwise(F.col("_own")).alias("visible"),
    )


def has_role(roles: list[str]) -> Column:
    return F.col("is_staff") | F.coalesce(F.col("role").isin(*roles), F.lit(False))


def role_access(memberships: DataFrame) -> DataFrame:
    """What each member may do in their organization."""
    return memberships.withColumns(
        {
            "may_view": has_role(VIEW_ROLES),
            "may_continue": has_role(CONTINUE_ROLES),
            "may_view_migration": has_role(MIGRATION_VIEW_ROLES),
            "may_start_migration": F.col("is_staff"),
        }
    )


def may_continue(requests: DataFrame, details: DataFrame, memberships: DataFrame) -> DataFrame:
    """Whether a user may continue a run: eligible, not continued yet, and entitled.

    ``requests`` holds ``request_id, run_id, user_id, org_id, is_staff``;
    ``details`` the run details with ``offer_continue``.
    """
    roles = memberships.select("user_id", "org_id", "role")
    offers = details.select("run_id", "offer_continue")
    return (
        requests.join(offers, "run_id")
        .join(roles, ["user_id", "org_id"], "left")
        .withColumn("allowed", F.col("offer_continue") & has_role(CONTINUE_ROLES))
    )


def audit_events(rows: DataFrame, action: str, target_type: str, metadata: dict[str, str]) -> DataFrame:
    """Audit rows for ``rows`` (``actor, target_id, created_at``), metadata as JSON text."""
    facts = F.struct(*[F.col(c).cast("string").alias(k) for k, c in metadata.items()])
    return rows.select(
        "actor",
        F.lit(action).alias("action"),
        F.lit(target_type).alias("target_type"),
        F.col("target_id").cast("string").alias("target_id"),
        F.to_json(facts).alias("metadata"),
        "created_at",
    )


def newest_first(events: DataFrame) -> DataFrame:
    return events.orderBy(F.col("created_at").desc(), "target_id")


def uniqueness_violations(rows: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    """Keys that occur more than once although a rule forbids it.

    A key with a NULL part never clashes.
    """
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    return (
        rows.where(complete)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select(
            F.lit(rule).alias("rule"),
            F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
            "copies",
        )
    )


def fill_identifiers(rows: DataFrame, column: str, identity: list[str], namespace: str) -> DataFrame:
    """Give every row without identifier a UUID; the others keep theirs.

    The UUID is derived from the row's identity, so a recomputed task gives the
    same one.
    """
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), *[F.col(c).cast("string") for c in identity]), 256)
    variant = F.element_at(
        F.array(*[F.lit(c) for c in "89ab"]),
        (F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1,
    )
    fresh = F.concat_ws(
        "-",
        F.substr(digest, F.lit(1), F.lit(8)),
        F.substr(digest, F.lit(9), F.lit(4)),
        F.concat(F.lit("8"), F.substr(digest, F.lit(14), F.lit(3))),
        F.concat(variant, F.substr(digest, F.lit(18), F.lit(3))),
        F.substr(digest, F.lit(21), F.lit(12)),
    )
    return rows.withColumn(column, F.coalesce(F.col(column), fresh))
