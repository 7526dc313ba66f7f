"""Bodies, records, paths and mapping."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import paths
from millrace.operators import config, mapping, records

PATH = "data.items"


def facts(spark, body):
    data = bytes(body) if isinstance(body, (bytes, bytearray)) else body.encode()
    page = spark.createDataFrame([(1, 1, bytearray(data))], "run bigint, page bigint, body binary")
    return records.page_facts(page, PATH).first()


@pytest.mark.parametrize(
    "body, problem",
    [
        ("not json", "invalid JSON"),
        ("", "invalid JSON"),
        (b"\xff\xfe{", "invalid JSON"),
        ("3", "not an object or list"),
        ("null", "not an object or list"),
        ('{"unexpected":"shape"}', "records field missing"),
        ('{"data":[1]}', "records field missing"),
        ('{"data":{"items":"no"}}', "records field not a list"),
        ('{"data":{"items":null}}', "records field not a list"),
    ],
)
def test_malformed_bodies(spark, body, problem):
    page = facts(spark, body)
    assert (page.problem, page.error) == (problem, "MalformedResponseError")


@pytest.mark.parametrize(
    "body, n",
    [
        ('{"data":{"items":[{"id":1},{"id":2}]}}', 2),
        ('[{"id":1}]', 1),
        ("[]", 0),
        ('{"data":{"items":[]}}', 0),
        ('{"data":1,"data":{"items":[1,2,3]}}', 3),
        ("﻿[1,2]", 2),
    ],
)
def test_good_bodies(spark, body, n):
    page = facts(spark, body)
    assert (page.n, page.problem, page.size_bytes) == (n, None, len(body.encode()))


def test_extracted_records_keep_order_and_nulls(spark):
    page = spark.createDataFrame([(1, 1, '{"data":{"items":[{"id":2},null,{"id":1}]}}')], "run int, page int, body string")
    found = records.extract_records(page, PATH).select("pos", F.to_json("record").alias("j")).orderBy("pos")
    assert [(r.pos, r.j) for r in found.collect()] == [(0, '{"id":2}'), (1, "null"), (2, '{"id":1}')]


@pytest.mark.parametrize(
    "doc, path, found, value",
    [
        ({"a": 1}, "a", True, "1"),
        ({"a": {"b": {"c": 42}}}, "a.b.c", True, "42"),
        ({"a": 1}, "b", False, None),
        ({"a": {"b": 1}}, "a.c", False, None),
        ({"a": None}, "a", True, None),
        ({"a": None}, "a.b", False, None),
        ({"a": [1, 2, 3]}, "a.0", False, None),
        ({"a": {"0": "x"}}, "a.0", True, "x"),
        ({"": {"": 5}}, ".", True, "5"),
        ({"a?b": {"c": 1}}, "a?b.c", True, "1"),
        ({"it's": {'"q"': 2}}, "it's.\"q\"", True, "2"),
        ({"a'\"b": 3}, "a'\"b", True, "3"),
        ("text", "a", False, None),
    ],
)
def test_lookup(spark, doc, path, found, value):
    row = (
        spark.createDataFrame([(json.dumps(doc),)], "j string")
        .select(F.try_parse_json("j").alias("v"))
        .select(
            paths.is_found(F.col("v"), path).alias("found"),
            paths.lookup(F.col("v"), path).cast("string").alias("value"),
        )
        .first()
    )
    assert (row.found, row.value) == (found, value)


def mapped(spark, doc, columns, strict=False):
    df = spark.createDataFrame([(1, 1, 0, json.dumps(doc))], "run int, page int, pos int, j string")
    df = df.select("run", "page", "pos", F.try_parse_json("j").alias("record"))
    problem = df.select(mapping.mapping_problem(F.col("record"), columns, strict).alias("p")).first().p
    values = mapping.map_records(df, columns).select(*[F.to_json(c).alias(c) for c in columns]).first()
    return problem, values.asDict()


def test_mapping_keeps_null_and_missing_apart(spark):
    columns = {"policy_id": "policy.id", "cancelled_at": "cancelled_at", "gone": "gone"}
    problem, values = mapped(spark, {"policy": {"id": "P1"}, "cancelled_at": None}, columns)
    assert problem is None
    assert values == {"policy_id": '"P1"', "cancelled_at": "null", "gone": None}


def test_strict_mapping_refuses_missing_but_not_null(spark):
    assert mapped(spark, {"a": None}, {"x": "a"}, strict=True)[0] is None
    assert mapped(spark, {"b": 1}, {"x": "a"}, strict=True)[0] == "missing a for x"


@pytest.mark.parametrize("doc", [["not", "an", "object"], None, 3, "s"])
def test_only_objects_are_mapped(spark, doc):
    assert mapped(spark, doc, {"x": "a"})[0] == "not an object"


@pytest.mark.parametrize(
    "setting, problem",
    [
        ({}, None),
        ({"base_url": ""}, "base_url"),
        ({"path": None}, "path"),
        ({"method": "post"}, None),
        ({"method": "DELETE"}, "method"),
        ({"max_pages": True}, "max_pages"),
        ({"max_pages": 0}, "max_pages"),
        ({"max_pages": 2.0}, "max_pages"),
        ({"max_pages": None}, "max_pages"),
        ({"start_page": "1"}, "start_page"),
        ({"timeout_seconds": 0.5}, None),
        ({"timeout_seconds": False}, "timeout_seconds"),
        ({"timeout_seconds": 0}, "timeout_seconds"),
        ({"max_response_bytes": 10}, None),
        ({"max_response_bytes": 1.5}, "max_response_bytes"),
        ({"max_response_bytes": 0, "method": "PUT"}, "method"),
    ],
)
def test_source_settings(spark, setting, problem):
    text = json.dumps({"base_url": "https://x.test", "path": "/p", **setting})
    df = spark.createDataFrame([(text,)], "config string")
    assert config.audit_configs(df).first().problem == problem


def test_second_response_counts_only_after_refused_credentials(spark, rows):
    log = [
        (1, 1, 401, True), (1, 2, 200, True), (2, 1, 403, False), (2, 2, 200, False),
        (3, 1, 500, True), (3, 2, 200, True), (4, 1, 401, True), (5, 1, 401, True), (5, 2, None, True),
    ]
    df = spark.createDataFrame(log, "page int, try int, status int, has_provider boolean")
    chosen = records.classify_responses(records.effective_responses(df, ["page"]))
    assert rows(chosen, "page", "status", "category", "retryable") == [
        (1, 200, None, None),
        (2, 403, "FetchFailed", False),
        (3, 500, "FetchFailed", True),
        (4, 401, "FetchFailed", False),
        (5, None, "FetchFailed", True),
    ]


def test_only_registered_connectors_are_known(spark, rows):
    df = spark.createDataFrame(
        [(1, "source", "rest_api"), (2, "source", "sqlserver"), (3, "destination", "ftp")],
        "connection_id int, kind string, connector_type string",
    )
    assert rows(config.resolve_connectors(df), "connection_id", "known", "available", "category") == [
        (1, True, None, None), (2, False, "rest_api", "UnexpectedError"), (3, False, "sqlserver", "UnexpectedError"),
    ]
