"""Queries that write: objects of the raw store, and tables with a log of their loads."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from millrace.operators import migration, rawstore, records
from millrace.operators.scaling import few_values
from millrace.plans.fixtures import fixture
from millrace.plans.ingestion import ingest, store_and_load
from millrace.plans.ingestion_queries import _LOADED, _RAW, MAPPING, TYPES, _loop
from millrace.plans.migration_pass import migrate, repointed
from millrace.plans.migration_queries import _INSPECTED
from millrace.plans.registry import query
from millrace.plans.scan_queries import RECORDS_PATH
from millrace.session import scratch_path
from millrace.sources import landed, ledger, objects, tables

BUCKET = "pile"

# Addressed deliveries as the checking engine sees them; two tenants in 27 don't exist.
_ADDRESSED = """
WITH addressed AS (
  SELECT d.arrival, d.payload, d.sha, CASE WHEN o.tenant_uuid IS NULL THEN NULL ELSE concat(o.tenant_uuid, '/', d.lkey) END AS key
  FROM delivery_keys d LEFT JOIN organizations o ON o.org_id = d.org_id)
"""


def _addressed(spark, sf_dir):
    deliveries = rawstore.address_payloads(fixture(spark, sf_dir, "deliveries"))
    return rawstore.tenant_uris(deliveries, fixture(spark, sf_dir, "organizations"), BUCKET)


def _store(spark, label):
    store = objects.FolderStore(scratch_path(spark, label))
    store.provision(BUCKET)
    return store


@query(
    "store_payloads",
    _ADDRESSED
    + """SELECT key, CAST(octet_length(encode(payload)) AS BIGINT) AS size_bytes, sha256(payload) AS body_sha256
         FROM (SELECT key, any_value(payload) AS payload FROM addressed WHERE key IS NOT NULL GROUP BY key) t""",
)
def store_payloads(spark, sf_dir):
    """All deliveries stored twice over; what then lies in the store, read back."""
    store, rows = _store(spark, "store-payloads"), _addressed(spark, sf_dir)
    for _ in range(2):
        objects.store_payloads(rows, store)
    there = objects.list_objects(spark, store, BUCKET)
    claims = there.select(F.concat(F.lit(f"s3://{BUCKET}/"), "key").alias("storage_uri"), "key", "size_bytes")
    read = objects.check_objects(claims, store, ["key", "size_bytes"], read=True)
    return read.where("outcome = 'there'").select("key", "size_bytes", F.col("actual").alias("body_sha256"))


@query(
    "store_outcomes",
    _ADDRESSED
    + """SELECT 1 AS pass, outcome, count(*) AS rows FROM (
           SELECT CASE WHEN key IS NULL THEN 'refused' WHEN row_number() OVER (PARTITION BY key ORDER BY arrival) = 1 THEN 'created'
                       ELSE 'reused' END AS outcome FROM addressed) t GROUP BY outcome
         UNION ALL SELECT 2, CASE WHEN key IS NULL THEN 'refused' ELSE 'reused' END, count(*) FROM addressed GROUP BY 2""",
)
def store_outcomes(spark, sf_dir):
    store, rows = _store(spark, "store-outcomes"), _addressed(spark, sf_dir)
    passes = [objects.store_payloads(rows, store).withColumn("pass", F.lit(k)) for k in (1, 2)]
    return passes[0].unionByName(passes[1]).groupBy("pass", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "store_size_conflicts",
    _ADDRESSED
    + """SELECT arrival, concat('s3://pile/', key) AS storage_uri, 'RawPayloadIntegrityError' AS category,
                CAST(octet_length(encode(payload)) AS BIGINT) AS stored_size
         FROM addressed WHERE key IS NOT NULL AND arrival % 6 = 1""",
)
def store_size_conflicts(spark, sf_dir):
    """Payloads that come again cut or grown, under the address of what is stored."""
    store, rows = _store(spark, "store-conflicts"), _addressed(spark, sf_dir)
    objects.store_payloads(rows, store)
    again = rows.where("arrival % 6 IN (1, 2)").withColumn("payload", F.when(F.col("arrival") % 6 == 1, F.concat("payload", F.lit("+"))).otherwise(F.col("payload")))
    found = objects.store_payloads(again, store, columns=["arrival"])
    return found.where("outcome = 'conflict'").select("arrival", "storage_uri", "category", "stored_size")


@query(
    "vanished_objects",
    _ADDRESSED
    + """SELECT DISTINCT key, 'RawPayloadIntegrityError' AS category FROM addressed WHERE key IS NOT NULL AND key NOT IN (
           SELECT key FROM addressed WHERE key IS NOT NULL AND arrival % 3 <> 1)""",
)
def vanished_objects(spark, sf_dir):
    """Claimed objects that the store's listing doesn't hold, confirmed by asking for each."""
    store, rows = _store(spark, "vanished"), _addressed(spark, sf_dir).where("storage_uri IS NOT NULL")
    objects.store_payloads(rows.where("arrival % 3 <> 1"), store)
    claimed = rows.select("key", "storage_uri").distinct()
    gone = rawstore.vanished_objects(claimed, objects.list_objects(spark, store, BUCKET)).select("key", "storage_uri")
    return objects.check_objects(gone, store, ["key"]).where("outcome = 'vanished'").select("key", "category")


@query(
    "absent_store",
    """SELECT d.org_id, 'absent' AS outcome, 'ConfigurationError' AS category, count(*) AS rows FROM deliveries d
       JOIN organizations o ON o.org_id = d.org_id WHERE d.org_id % 3 = 0 GROUP BY d.org_id""",
)
def absent_store(spark, sf_dir):
    """A bucket per tenant, of which a third was never provisioned: nothing is created by writing."""
    store = objects.FolderStore(scratch_path(spark, "absent"))
    for org in few_values(fixture(spark, sf_dir, "organizations").where("org_id % 3 <> 0"), "org_id", 1000):
        store.provision(f"org-{org}")
    rows = _addressed(spark, sf_dir).where("key IS NOT NULL")
    own = rows.withColumn("storage_uri", F.concat(F.lit("s3://org-"), "org_id", F.lit("/"), "key"))
    found = objects.store_payloads(own, store, columns=["org_id"])
    return found.where("outcome = 'absent'").groupBy("org_id", "outcome", "category").agg(F.count(F.lit(1)).alias("rows"))


# --- landed pages -----------------------------------------------------------------------


def _landed(spark, sf_dir, label):
    """The folder of all pages, landed as files by tasks."""
    store = objects.FolderStore(scratch_path(spark, label))
    store.provision("landed")
    address = F.format_string("s3://landed/run=%d/page-%d.json", "run", "page").alias("storage_uri")
    objects.store_payloads(fixture(spark, sf_dir, "page_bodies").select(address, "body"), store, "body")
    return f"file://{store.root}/landed"


_SCANNED = """
SELECT run, page, CAST(page AS VARCHAR) AS cursor_used, 'application/json' AS content_type,
       CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes, sha256(body) AS checksum_sha256,
       CAST(CASE WHEN variant IN (47, 48, 49) THEN NULL WHEN variant = 45 THEN 0
            ELSE json_array_length(CASE WHEN variant = 46 THEN body ELSE body->'data'->'items' END) END AS BIGINT) AS n
FROM page_bodies"""


def _scanned(pages):
    facts = records.page_facts(pages, RECORDS_PATH)
    return facts.select("run", "page", F.col("page").cast("string").alias("cursor_used"), "content_type", "size_bytes", "checksum_sha256", "n")


@query("landed_scan", _SCANNED)
def landed_scan(spark, sf_dir):
    """Pages as files, read back through Spark's file scan."""
    return _scanned(landed.read_landed(spark, _landed(spark, sf_dir, "landed")))


@query("landed_scan_by_provider", _SCANNED + " WHERE page >= 2")
def landed_scan_by_provider(spark, sf_dir):
    """The same through a provider of pages, from the second page on."""
    spark.dataSource.register(landed.paged_source("landed_pages"))
    pages = spark.read.format("landed_pages").option("path", _landed(spark, sf_dir, "provided")).option("start", 2)
    return _scanned(pages.load())


# --- passes over the store --------------------------------------------------------------


def _stocked(spark, sf_dir, label, planted=None):
    """A store with the objects of the records, and others ``planted`` at keys of their own."""
    store, rows = _store(spark, label), fixture(spark, sf_dir, "storage_objects").select("key", "body")
    rows = rows if planted is None else rows.unionByName(planted)
    objects.store_payloads(rows.select(F.concat(F.lit(f"s3://{BUCKET}/"), "key").alias("storage_uri"), "body"), store, "body")
    return store


@query(
    "migration_resumed",
    _INSPECTED
    + """SELECT 1 AS attempt, 'cancelled' AS status, record_id, finding, finding = 'ready' AS migrated,
                CASE WHEN finding = 'ready' THEN concat(tenant_uuid, '/', lk) END AS key, CASE WHEN finding = 'ready' THEN checksum_sha256 END AS body_sha256
         FROM (SELECT *, row_number() OVER (ORDER BY record_id) - 1 AS rn, count(*) OVER () AS n FROM inspected) t WHERE rn < ceil(n / 4)
         UNION ALL
         SELECT 2, 'partially_failed', record_id, finding, finding = 'ready',
                CASE WHEN finding = 'ready' THEN concat(tenant_uuid, '/', lk) END, CASE WHEN finding = 'ready' THEN checksum_sha256 END FROM inspected""",
)
def migration_resumed(spark, sf_dir):
    """A pass in four ranges, cancelled after the first and taken up again; moved objects are read back."""
    store, path = _stocked(spark, sf_dir, "migration"), scratch_path(spark, "migration-pass")
    records = fixture(spark, sf_dir, "storage_records").drop("payload")
    quarter = -(-records.count() // 4)
    attempts = []
    for number, stop in ((1, True), (2, False)):
        done = migrate(records, store, BUCKET, path, cancelled=lambda: stop, range_records=quarter)  # noqa: B023
        read = objects.check_objects(done.findings.where("migrated"), store, ["record_id"], read=True)
        there = read.select("record_id", F.substring_index("storage_uri", f"s3://{BUCKET}/", -1).alias("key"), F.col("actual").alias("body_sha256"))
        found = done.findings.select("record_id", "finding", "migrated").join(there, "record_id", "left")
        attempts.append(found.select(F.lit(number).alias("attempt"), F.lit(done.status).alias("status"), *found.columns))
    return attempts[0].unionByName(attempts[1])


@query(
    "migration_conflict_ends",
    _INSPECTED
    + """, first AS (SELECT min(record_id) AS met FROM inspected WHERE finding = 'ready' AND record_id % 7 = 2 AND record_id > 100)
         SELECT record_id, 'failed' AS status, 'RawPayloadIntegrityError' AS category, finding,
                CASE WHEN finding = 'ready' AND record_id < met THEN concat('s3://pile/', tenant_uuid, '/', lk) ELSE storage_uri END AS storage_uri
         FROM inspected, first WHERE record_id < met
         UNION ALL SELECT record_id, 'failed', 'RawPayloadIntegrityError', NULL, storage_uri FROM inspected, first WHERE record_id >= met""",
)
def migration_conflict_ends(spark, sf_dir):
    """Tenant keys that hold other bytes already: the pass ends at the first of them, and what lies behind keeps its address."""
    records = fixture(spark, sf_dir, "storage_records")
    taken = migration.classify_generation(records.where("record_id % 7 = 2 AND record_id > 100 AND record_id % 5 <> 0"), BUCKET)
    planted = taken.select(F.concat_ws("/", "tenant_uuid", "expected_key").alias("key"), F.concat("payload", F.lit("?")).alias("body"))
    store, thin = _stocked(spark, sf_dir, "migration-conflict", planted), records.drop("payload")
    done = migrate(thin, store, BUCKET, scratch_path(spark, "migration-ended"))
    after = repointed(thin, done.findings).select("record_id", "storage_uri")
    return after.join(done.findings.select("record_id", "finding"), "record_id", "left").withColumns({"status": F.lit(done.status), "category": F.lit(done.category)})


@query(
    "verify_changed",
    _ADDRESSED
    + """, stored AS (SELECT DISTINCT key, arrival % 3 = 1 AS late FROM addressed WHERE key IS NOT NULL),
           firsts AS (SELECT key, CASE WHEN bool_and(late) THEN 2 ELSE 1 END AS pass FROM stored GROUP BY key)
         SELECT CAST(f.pass AS BIGINT) AS pass, f.key, 'there' AS outcome, a.sha AS actual
         FROM firsts f JOIN (SELECT DISTINCT key, sha FROM addressed) a ON a.key = f.key""",
)
def verify_changed(spark, sf_dir):
    """Three passes over a store that grows between the first two: each object is read by one of them."""
    store, rows, path = _store(spark, "verified"), _addressed(spark, sf_dir).where("storage_uri IS NOT NULL"), scratch_path(spark, "ledger")
    objects.store_payloads(rows.where("arrival % 3 <> 1"), store)
    ledger.verify_changed(spark, store, BUCKET, path, 1)
    objects.store_payloads(rows, store)
    for number in (2, 3):
        ledger.verify_changed(spark, store, BUCKET, path, number)
    return tables.read_table(spark, path).select("pass", "key", "outcome", "actual")


# --- tables -----------------------------------------------------------------------------

_ROWS = "run bigint, page bigint, o_orderkey bigint, cents bigint, remark string"


def _orders(spark, sf_dir):
    return fixture(spark, sf_dir, "order_pages").select("run", "page", "o_orderkey", "cents")


@query(
    "load_replay",
    """SELECT run, page, o_orderkey, cents, CAST(NULL AS VARCHAR) AS remark FROM order_pages""",
)
def load_replay(spark, sf_dir):
    """Loads of which each comes twice, the second time with other rows under the same batch."""
    path, rows = scratch_path(spark, "replayed"), _orders(spark, sf_dir)
    tables.create_table(spark, path, _ROWS)
    for part in range(3):
        tables.append(rows.where(F.col("page") % 3 == part), path, f"pages-{part}")
        tables.append(rows.where("page = 1"), path, f"pages-{part}")
    return tables.read_table(spark, path)


@query(
    "load_history",
    """SELECT CAST(page % 3 + 1 AS BIGINT) AS version, concat('pages-', page % 3) AS batch, count(*) AS rows FROM order_pages GROUP BY page % 3""",
)
def load_history(spark, sf_dir):
    path, rows = scratch_path(spark, "history"), _orders(spark, sf_dir)
    tables.create_table(spark, path, _ROWS)
    for part in range(3):
        tables.append(rows.where(F.col("page") % 3 == part), path, f"pages-{part}")
        tables.append(rows.limit(0), path, f"none-{part}")
    return tables.history(spark, path)


@query(
    "load_concurrent",
    """SELECT run, count(*) AS rows, CAST(sum(cents) AS BIGINT) AS cents FROM order_pages GROUP BY run""",
)
def load_concurrent(spark, sf_dir):
    """Writers at one time, two for each batch: every batch is there once."""
    path, rows = scratch_path(spark, "concurrent"), _orders(spark, sf_dir)
    tables.create_table(spark, path, _ROWS)
    with ThreadPoolExecutor(4) as writers:
        list(writers.map(lambda k: tables.append(rows.where(F.col("page") % 4 == k // 2), path, f"pages-{k // 2}"), range(8)))
    return tables.read_table(spark, path).groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.sum("cents").alias("cents"))


@query(
    "run_stored_and_loaded",
    _loop("troubled_pages")
    + f""", raw AS ({_RAW}), rows AS ({_LOADED})
       SELECT 'object' AS kind, run, CAST(count(*) AS BIGINT) AS n, CAST(sum(size_bytes) AS BIGINT) AS amount FROM raw GROUP BY run
       UNION ALL SELECT 'row', run, count(*), CAST(sum(cents) AS BIGINT) FROM rows GROUP BY run""",
)
def run_stored_and_loaded(spark, sf_dir):
    """Whole runs, written twice as after a crash: objects and rows are there once."""
    store, path = _store(spark, "run-store"), scratch_path(spark, "run-table")
    store.provision("raw")
    tables.create_table(spark, path, "run bigint, page bigint, order_id bigint, customer_id bigint, cents bigint, note string")
    landed = fixture(spark, sf_dir, "troubled_pages").drop("variant")
    result = ingest(landed, fixture(spark, sf_dir, "landed_runs"), RECORDS_PATH, MAPPING, TYPES)
    for _ in range(2):
        outcomes, _added = store_and_load(result, store, path, "runs-1")
    there = objects.check_objects(outcomes.select("storage_uri", "run").distinct(), store, ["run"], read=True).where("outcome = 'there'")
    stored = there.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("stored_size").alias("amount"))
    rows = tables.read_table(spark, path).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("amount"))
    return stored.select(F.lit("object").alias("kind"), "run", "n", "amount").unionByName(rows.select(F.lit("row").alias("kind"), "run", "n", "amount"))
