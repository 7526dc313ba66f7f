"""Queries over migration jobs, loads, access and audit."""

from pyspark.sql import functions as F

from millrace.operators import access, jobs, load, migration, runs
from millrace.plans.fixtures import fixture, table
from millrace.plans.registry import query

AS_OF = "2024-01-15 06:00:00"
_ACTIVE = "status IN ('pending', 'running')"
_STALE = f"status = 'running' AND TIMESTAMP '{AS_OF}' - updated_at > INTERVAL 15 MINUTE"


def _as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def _jobs(spark, sf_dir):
    return fixture(spark, sf_dir, "jobs")


@query(
    "job_final_status",
    """SELECT job_id, CASE WHEN raised THEN 'failed' WHEN cancel_requested THEN 'cancelled'
              WHEN dry_run THEN 'succeeded' WHEN missing_objects > 0 OR checksum_conflicts > 0 THEN 'partially_failed'
              ELSE 'succeeded' END AS final_status FROM jobs""",
)
def job_final_status(spark, sf_dir):
    return migration.final_status(_jobs(spark, sf_dir)).select("job_id", "final_status")


@query(
    "job_export",
    r"""SELECT job_id, concat('Raw payload migration job ', job_id, chr(10),
          'Organization: ', o.name, ' (', o.schema_name, ')', chr(10),
          'Mode: ', CASE WHEN dry_run THEN 'dry-run' ELSE 'migration' END, chr(10),
          'Status: ', CASE status WHEN 'partially_failed' THEN 'Partially failed' WHEN 'pending' THEN 'Pending'
             WHEN 'running' THEN 'Running' WHEN 'succeeded' THEN 'Succeeded' WHEN 'failed' THEN 'Failed'
             ELSE 'Cancelled' END, chr(10),
          'Started: ', replace(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '.000000', ''), '+00:00', chr(10),
          'Finished: ', CASE WHEN status IN ('pending', 'running') THEN '-'
             ELSE concat(replace(strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f'), '.000000', ''), '+00:00') END, chr(10), chr(10),
          'Records inspected:   ', records_inspected, chr(10), 'Already migrated:    ', already_migrated, chr(10),
          'Legacy unprefixed:   ', legacy_unprefixed, chr(10), 'Schema-prefixed:     ', schema_prefixed, chr(10),
          'Missing objects:     ', missing_objects, chr(10), 'Checksum conflicts:  ', checksum_conflicts, chr(10),
          'Ready for migration: ', ready_for_migration, chr(10), 'Records migrated:    ', records_migrated, chr(10),
          'Records skipped:     ', records_skipped,
          CASE WHEN error_message IS NOT NULL THEN concat(chr(10), chr(10), 'Error: ', error_message) ELSE '' END,
          chr(10)) AS summary
        FROM jobs j JOIN organizations o ON o.org_id = j.org_id""",
)
def job_export(spark, sf_dir):
    named = _jobs(spark, sf_dir).join(fixture(spark, sf_dir, "organizations"), "org_id")
    moments = named.withColumns(
        {
            "started_at": F.col("created_at"),
            "finished_at": F.when(~jobs.is_active(), F.col("updated_at")),
        }
    )
    return jobs.export_jobs(moments).select("job_id", "summary")


@query(
    "org_job_view",
    f"""SELECT org_id, {_ACTIVE} AS active, created_at, job_id, status FROM jobs
        QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY CASE WHEN {_ACTIVE} THEN 0 ELSE 1 END,
                created_at DESC, job_id DESC) = 1""",
)
def org_job_view(spark, sf_dir):
    return jobs.shown_jobs(_jobs(spark, sf_dir))


@query(
    "active_job_dedupe",
    f"""SELECT org_id, arg_max(job_id, struct_pack(a := created_at, b := job_id)) AS job_id, count(*) AS active_jobs,
               count(*) > 1 AS violation
        FROM jobs WHERE {_ACTIVE} GROUP BY org_id""",
)
def active_job_dedupe(spark, sf_dir):
    return jobs.active_jobs(_jobs(spark, sf_dir))


@query("stale_jobs", f"SELECT job_id, org_id, updated_at FROM jobs WHERE {_STALE}")
def stale_jobs(spark, sf_dir):
    return jobs.stale_jobs(_jobs(spark, sf_dir), _as_of()).select("job_id", "org_id", "updated_at")


@query(
    "job_action_rules",
    f"""WITH judged AS (SELECT job_id, user_org, status, {_STALE} AS stale,
                count(*) FILTER ({_ACTIVE}) OVER (PARTITION BY user_org) AS active_jobs
                FROM (SELECT *, org_id * 1000 + job_id % 700 AS user_org FROM jobs) j)
        SELECT job_id, stale,
               CASE WHEN status = 'running' AND NOT stale THEN 'refused'
                    WHEN active_jobs - (CASE WHEN stale THEN 1 ELSE 0 END) > 0
                      THEN CASE WHEN stale THEN 'cancelled, existing' ELSE 'existing' END
                    WHEN stale THEN 'cancelled, new' ELSE 'new' END AS retry,
               CASE WHEN {_ACTIVE} THEN 'requested' ELSE 'refused' END AS cancel
        FROM judged""",
)
def job_action_rules(spark, sf_dir):
    # Finer organizations, so that some have no other active job.
    spread = _jobs(spark, sf_dir).withColumn(
        "org_id", F.col("org_id") * 1000 + F.col("job_id") % 700
    )
    return jobs.job_actions(spread, _as_of()).select("job_id", "stale", "retry", "cancel")


# --- loads -----------------------------------------------------------------------

_DEST = """
WITH tables AS (SELECT schema_name, table_name, list_sort(list(column_name)) AS known
                FROM destination_columns GROUP BY schema_name, table_name)
"""


def _tables(spark, sf_dir):
    return load.destination_tables(fixture(spark, sf_dir, "destination_columns"))


@query(
    "load_request_audit",
    _DEST
    + """, named AS (
        SELECT *, json_type(config, '$.schema_name') AS st, json_type(config, '$.table_name') AS tt,
               json_type(config, '$.batch_size') AS bt, coalesce(config->>'schema_name', 'dbo') AS sn,
               config->>'table_name' AS tn FROM load_requests),
      judged AS (
        SELECT load_id, n_records, CASE WHEN mode <> 'append' THEN 'mode' WHEN n_records = 0 THEN 'empty'
          WHEN st IS NOT NULL AND (st <> 'VARCHAR' OR NOT regexp_full_match(sn, '[A-Za-z_][A-Za-z0-9_]{0,127}'))
            THEN 'schema_name'
          WHEN tt IS NULL THEN 'table_name unset'
          WHEN NOT regexp_full_match(tn, '[A-Za-z_][A-Za-z0-9_]{0,127}') THEN 'table_name'
          WHEN bt IS NOT NULL AND NOT (bt IN ('BIGINT', 'UBIGINT') AND TRY_CAST(config->>'batch_size' AS DOUBLE) >= 1)
            THEN 'batch_size'
          WHEN t.known IS NULL THEN 'no such table'
          WHEN len(list_filter(string_split(column_list, ','), lambda c: NOT list_contains(t.known, c))) > 0
            THEN 'unknown columns' END AS problem
        FROM named n LEFT JOIN tables t ON t.schema_name = n.sn AND t.table_name = n.tn)
      SELECT load_id, problem,
             CASE problem WHEN 'mode' THEN 'UnsupportedCapability' WHEN 'schema_name' THEN 'ConfigurationError'
                  WHEN 'table_name' THEN 'ConfigurationError' WHEN 'batch_size' THEN 'ConfigurationError'
                  WHEN 'table_name unset' THEN 'UnexpectedError' WHEN 'no such table' THEN 'SchemaMismatchError'
                  WHEN 'unknown columns' THEN 'SchemaMismatchError' END AS category,
             CASE WHEN problem IS NULL THEN n_records WHEN problem = 'empty' THEN 0 END AS loaded
      FROM judged""",
)
def load_request_audit(spark, sf_dir):
    requests = fixture(spark, sf_dir, "load_requests").withColumn(
        "record_columns", F.split("column_list", ",")
    )
    return load.audit_requests(requests, _tables(spark, sf_dir)).select(
        "load_id", "problem", "category", "loaded"
    )


@query(
    "identifier_check",
    """SELECT doc_id, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_]{0,127}') AS valid
       FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(source, 'src', '_t') WHEN 1 THEN concat(doc_id, lang)
                    WHEN 2 THEN repeat('a', CAST(100 + doc_id % 50 AS INTEGER)) ELSE concat(lang, '-', source) END AS name
             FROM documents) t""",
)
def identifier_check(spark, sf_dir):
    key = F.col("doc_id") % 4
    name = (
        F.when(key == 0, F.replace("source", F.lit("src"), F.lit("_t")))
        .when(key == 1, F.concat(F.col("doc_id").cast("string"), "lang"))
        .when(key == 2, F.expr("repeat('a', cast(100 + doc_id % 50 as int))"))
        .otherwise(F.concat("lang", F.lit("-"), "source"))
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", load.is_identifier(name).alias("valid")
    )


@query(
    "schema_check",
    _DEST
    + """, used AS (SELECT load_id, 'dbo' AS schema_name, CASE load_id % 4 WHEN 0 THEN 'orders' WHEN 1 THEN 'parts'
                     WHEN 2 THEN 'events' ELSE 'ghost' END AS table_name,
                     list_sort(list_distinct(string_split(column_list, ','))) AS cols FROM load_requests)
      SELECT load_id, u.schema_name, u.table_name, t.known IS NOT NULL AS table_exists,
             CASE WHEN t.known IS NOT NULL THEN
               array_to_string(list_filter(cols, lambda c: NOT list_contains(t.known, c)), ', ') END AS unknown_columns,
             array_to_string(t.known, ', ') AS known_columns,
             CASE WHEN t.known IS NULL OR len(list_filter(cols, lambda c: NOT list_contains(t.known, c))) > 0
                  THEN 'SchemaMismatchError' END AS category
      FROM used u LEFT JOIN tables t ON t.schema_name = u.schema_name AND t.table_name = u.table_name""",
)
def schema_check(spark, sf_dir):
    which = F.col("load_id") % 4
    target = F.when(which == 0, "orders").when(which == 1, "parts").when(which == 2, "events")
    columns = fixture(spark, sf_dir, "load_requests").select(
        "load_id",
        F.lit("dbo").alias("schema_name"),
        target.otherwise("ghost").alias("table_name"),
        F.explode(F.split("column_list", ",")).alias("column"),
    )
    return load.check_columns(columns, _tables(spark, sf_dir))


@query(
    "load_batches",
    """SELECT run, page, CAST(floor(o_orderkey % 100 / 30) AS BIGINT) AS batch, count(*) AS batch_rows
       FROM order_pages GROUP BY ALL""",
)
def load_batches(spark, sf_dir):
    rows = fixture(spark, sf_dir, "order_pages").withColumn("pos", F.col("o_orderkey") % 100)
    return load.load_batches(rows, 30)


@query(
    "load_outcome",
    """SELECT load_id, CASE WHEN failure IS NOT NULL THEN 'LoadFailed' END AS category,
              CASE WHEN failure IS NOT NULL THEN failure = 'operational' END AS retryable FROM load_errors""",
)
def load_outcome(spark, sf_dir):
    from millrace.functions.outcomes import load_category, load_retryable

    failure = F.col("failure")
    return fixture(spark, sf_dir, "load_errors").select(
        "load_id",
        load_category(failure).alias("category"),
        load_retryable(failure).alias("retryable"),
    )


_KEY = ["l_orderkey", "l_linenumber"]
_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]


@query(
    "duplicate_exposure",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
       GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def duplicate_exposure(spark, sf_dir):
    return load.duplicate_exposure(table(spark, sf_dir, "lineitem"), _KEY)


@query(
    "dedupe_keep_first",
    """SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
               ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) = 1""",
)
def dedupe_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*_KEY, *_ORDER, "l_quantity")
    return load.keep_first(rows, _KEY, _ORDER)


# --- access and audit ------------------------------------------------------------


@query(
    "tenant_scope",
    """SELECT c_custkey AS row_id, CAST(c_nationkey AS BIGINT) AS org_id FROM customer
       WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE lower(n_name) = 'nation_7')""",
)
def tenant_scope(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("bigint").alias("org_id")
    )
    return access.tenant_scope(rows, fixture(spark, sf_dir, "organizations"), "nation_7").select(
        "row_id", "org_id"
    )


@query(
    "org_listing",
    """SELECT org_id, name FROM organizations
       WHERE org_id IN (SELECT org_id FROM memberships WHERE user_id = 6 AND role IN ('owner', 'admin'))""",
)
def org_listing(spark, sf_dir):
    return access.organizations_of(
        fixture(spark, sf_dir, "organizations"), fixture(spark, sf_dir, "memberships"), 6, False
    ).select("org_id", "name")


@query(
    "org_listing_by_viewer",
    """SELECT DISTINCT 'member' AS viewer, m.user_id, o.org_id, o.name
       FROM memberships m JOIN organizations o ON o.org_id = m.org_id
       WHERE m.role IN ('owner', 'admin') AND m.user_id NOT IN (SELECT user_id FROM memberships WHERE is_staff)
       UNION ALL SELECT 'staff', NULL, org_id, name FROM organizations""",
)
def org_listing_by_viewer(spark, sf_dir):
    return access.organizations_by_viewer(
        fixture(spark, sf_dir, "organizations"), fixture(spark, sf_dir, "memberships")
    )


@query(
    "visible_orgs",
    """SELECT user_id, bool_or(is_staff) AS is_staff, CASE WHEN bool_or(is_staff) THEN (SELECT count(*) FROM organizations)
              ELSE count(*) FILTER (role IN ('owner', 'admin')) END AS visible
       FROM memberships GROUP BY user_id""",
)
def visible_orgs(spark, sf_dir):
    return access.visible_organizations(
        fixture(spark, sf_dir, "memberships"), fixture(spark, sf_dir, "organizations")
    )


@query(
    "role_access",
    """SELECT user_id, org_id, is_staff OR role IN ('owner', 'admin', 'engineer', 'analyst') AS may_view,
              is_staff OR role IN ('owner', 'admin', 'engineer') AS may_continue,
              is_staff OR role IN ('owner', 'admin') AS may_view_migration, is_staff AS may_start_migration
       FROM memberships""",
)
def role_access(spark, sf_dir):
    return access.role_access(fixture(spark, sf_dir, "memberships")).drop("is_staff", "role")


@query(
    "can_continue",
    """SELECT r.run_id AS request_id, r.config_id AS user_id,
              r.status = 'failed' AND coalesce(r.error_category, '') = 'PageLimitExceededError'
              AND NOT EXISTS (SELECT 1 FROM runs c WHERE c.continued_from = r.run_id)
              AND (r.config_id % 50 = 0 OR coalesce(m.role IN ('owner', 'admin', 'engineer'), false)) AS allowed
       FROM runs r LEFT JOIN memberships m ON m.user_id = r.config_id AND m.org_id = r.run_id % 25""",
)
def can_continue(spark, sf_dir):
    history = fixture(spark, sf_dir, "runs")
    children = runs.children(history)
    details = (
        history.join(children, "run_id", "left")
        .withColumn("offer_continue", runs.is_continuable() & F.col("child_run").isNull())
    )
    requests = history.select(
        F.col("run_id").alias("request_id"),
        "run_id",
        F.col("config_id").alias("user_id"),
        (F.col("run_id") % 25).alias("org_id"),
        (F.col("config_id") % 50 == 0).alias("is_staff"),
    )
    return access.may_continue(requests, details, fixture(spark, sf_dir, "memberships")).select(
        "request_id", "user_id", "allowed"
    )


@query(
    "audit_trail",
    """SELECT config_id AS actor, 'run.continuation_created' AS action, 'run' AS target_type,
              CAST(run_id AS VARCHAR) AS target_id,
              concat('{"config_id":"', config_id, '","continued_from_run_id":"', continued_from, '","new_run_id":"',
                     run_id, '"}') AS metadata, created_at
       FROM runs WHERE continued_from IS NOT NULL ORDER BY created_at DESC""",
)
def audit_trail(spark, sf_dir):
    rows = fixture(spark, sf_dir, "runs").where("continued_from IS NOT NULL").select(
        F.col("config_id").alias("actor"),
        F.col("run_id").alias("target_id"),
        "config_id",
        "continued_from",
        "created_at",
    )
    events = access.audit_events(
        rows,
        "run.continuation_created",
        "run",
        {"config_id": "config_id", "continued_from_run_id": "continued_from", "new_run_id": "target_id"},
    )
    return access.newest_first(events)


@query(
    "uniqueness_violations",
    """SELECT 'user, organization' AS rule, concat(user_id, '|', org_id) AS key, count(*) AS copies
       FROM memberships GROUP BY user_id, org_id HAVING count(*) > 1
       UNION ALL SELECT 'name, kind', concat(name, '|', kind), count(*) FROM connections
       GROUP BY name, kind HAVING count(*) > 1
       UNION ALL SELECT 'idempotency key', idempotency_key, count(*) FROM trigger_requests
       WHERE idempotency_key IS NOT NULL GROUP BY idempotency_key HAVING count(*) > 1
       UNION ALL SELECT 'run, sequence, checksum', concat(run, '|', sequence, '|', sha), count(*)
       FROM delivery_keys GROUP BY run, sequence, sha HAVING count(*) > 1
       UNION ALL SELECT 'host', lower(trim(host)), count(*) FROM host_addresses
       GROUP BY lower(trim(host)) HAVING count(*) > 1""",
)
def uniqueness_violations(spark, sf_dir):
    hosts = fixture(spark, sf_dir, "host_addresses").select(F.lower(F.trim("host")).alias("host"))
    checks = [
        ("user, organization", fixture(spark, sf_dir, "memberships"), ["user_id", "org_id"]),
        ("name, kind", fixture(spark, sf_dir, "connections"), ["name", "kind"]),
        ("idempotency key", fixture(spark, sf_dir, "trigger_requests"), ["idempotency_key"]),
        ("run, sequence, checksum", fixture(spark, sf_dir, "delivery_keys"), ["run", "sequence", "sha"]),
        ("host", hosts, ["host"]),
    ]
    found = [access.uniqueness_violations(rows, rule, keys) for rule, rows, keys in checks]
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result


@query(
    "identifier_backfill",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN md5(c_name) ELSE
         concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-8', substr(h, 14, 3), '-',
                substr('89ab', CAST((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1 AS INTEGER), 1),
                substr(h, 18, 3), '-', substr(h, 21, 12)) END AS tenant_uuid
       FROM (SELECT *, sha256(concat('organization|', c_custkey)) AS h FROM customer) c""",
)
def identifier_backfill(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.md5("c_name")).alias("tenant_uuid")
    )
    return access.fill_identifiers(rows, "tenant_uuid", ["c_custkey"], "organization")
