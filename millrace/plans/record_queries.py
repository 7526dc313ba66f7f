"""Queries over record mapping."""

from pyspark.sql import functions as F

from millrace.functions.paths import lookup, variant_kind
from millrace.operators import mapping
from millrace.operators.scaling import computed_once
from millrace.plans.fixtures import fixture
from millrace.plans.registry import query

# --- fixed values ---
MAPPING = {"id": "id", "user_id": "user.id", "kind": "user.type", "amount": "value", "k": "props.k"}
TYPES = {"id": "bigint", "user_id": "bigint", "kind": "string", "amount": "bigint", "k": "bigint"}
PATHS = ["id", "user.id", "user.type", "value", "tags.0", "user.id.deeper", "props.k"]


def _records(spark, sf_dir):
    texts = fixture(spark, sf_dir, "mapping_records").withColumnRenamed("record", "text")
    return computed_once(texts, record=F.try_parse_json("text")).drop("text")


@query(
    "path_lookup",
    """SELECT event_id, p.path, json_type(record, p.jp) IS NOT NULL AS found,
              coalesce(json_type(record, p.jp) = 'NULL', false) AS explicit_null, record->>p.jp AS value
       FROM mapping_records, (VALUES ('id', '$.id'), ('user.id', '$.user.id'), ('user.type', '$.user.type'),
            ('value', '$.value'), ('tags.0', '$.tags."0"'), ('user.id.deeper', '$.user.id.deeper'),
            ('props.k', '$.props.k')) p(path, jp)""",
)
def path_lookup(spark, sf_dir):
    found = F.array(
        *[F.struct(F.lit(p).alias("path"), lookup(F.col("record"), p).alias("v")) for p in PATHS]
    )
    return _records(spark, sf_dir).select("event_id", F.inline(found)).select(
        "event_id",
        "path",
        F.col("v").isNotNull().alias("found"),
        F.coalesce(F.is_variant_null("v"), F.lit(False)).alias("explicit_null"),
        F.col("v").cast("string").alias("value"),
    )


@query(
    "map_permissive",
    """SELECT run, page, pos, event_id, CAST(record->>'$.id' AS BIGINT) AS id,
              CAST(record->>'$.user.id' AS BIGINT) AS user_id, record->>'$.user.type' AS kind,
              CAST(record->>'$.value' AS BIGINT) AS amount, CAST(record->>'$.props.k' AS BIGINT) AS k
       FROM mapping_records WHERE json_type(record) = 'OBJECT'""",
)
def map_permissive(spark, sf_dir):
    rows = _records(spark, sf_dir)
    good = rows.where(mapping.mapping_problem(F.col("record"), MAPPING, strict=False).isNull())
    return mapping.map_records(good, MAPPING, TYPES)


_FAILURES = """
SELECT run, page, count(*) AS bad_records, min(pos) AS first_pos, min_by(problem, pos) AS first_problem
FROM (SELECT run, page, pos, CASE {rules} END AS problem FROM mapping_records) t
WHERE problem IS NOT NULL GROUP BY run, page
"""
_NOT_OBJECT = "WHEN json_type(record) <> 'OBJECT' THEN 'not an object'"


@query(
    "map_strict",
    _FAILURES.format(
        rules=_NOT_OBJECT
        + """ WHEN json_type(record, '$.id') IS NULL THEN 'missing id for id'
              WHEN json_type(record, '$.user.id') IS NULL THEN 'missing user.id for user_id'
              WHEN json_type(record, '$.user.type') IS NULL THEN 'missing user.type for kind'
              WHEN json_type(record, '$.value') IS NULL THEN 'missing value for amount'
              WHEN json_type(record, '$.props.k') IS NULL THEN 'missing props.k for k'"""
    ),
)
def map_strict(spark, sf_dir):
    return mapping.mapping_failures(_records(spark, sf_dir), MAPPING, strict=True)


@query("map_non_object", _FAILURES.format(rules=_NOT_OBJECT))
def map_non_object(spark, sf_dir):
    return mapping.mapping_failures(_records(spark, sf_dir), MAPPING, strict=False)


@query(
    "null_vs_missing",
    """SELECT event_id, CASE WHEN json_type(record, '$.value') IS NULL THEN 'missing'
              WHEN json_type(record, '$.value') = 'NULL' THEN 'null' ELSE 'present' END AS state
       FROM mapping_records""",
)
def null_vs_missing(spark, sf_dir):
    value = lookup(F.col("record"), "value")
    state = F.when(value.isNull(), "missing").when(F.is_variant_null(value), "null")
    return _records(spark, sf_dir).select("event_id", state.otherwise("present").alias("state"))


@query(
    "record_kinds",
    """SELECT CASE json_type(record) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'list'
              WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' END AS kind, count(*) AS n
       FROM mapping_records GROUP BY 1""",
)
def record_kinds(spark, sf_dir):
    return (
        _records(spark, sf_dir)
        .groupBy(variant_kind(F.col("record")).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "mapping_missing",
    "SELECT c_custkey AS config_id, 'MappingError' AS category FROM customer WHERE c_custkey % 7 IN (0, 3)",
)
def mapping_missing(spark, sf_dir):
    key = F.col("config_id")
    configs = fixture(spark, sf_dir, "config_overrides").select(
        "config_id",
        F.when(key % 7 == 0, F.create_map().cast("map<string,string>"))
        .when(key % 7 != 3, F.create_map(F.lit("id"), F.lit("id")))
        .alias("mapping"),
    )
    return mapping.unmapped(configs).select("config_id", "category")
