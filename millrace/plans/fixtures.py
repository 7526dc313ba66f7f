"""Inputs of the registered queries, derived from the given tables by plain SQL.

Each text runs unchanged in Spark and in the checking engine: ``@orders`` stands
for a given table, a bare fixture name for another fixture. The spellings the
engines do not share are written ``$JOIN(x|k)`` for ordered string aggregation,
``$SHA(x)`` for a SHA-256 in hex and ``$EACH(a, b)`` for one row per value.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FIXTURES: dict[str, str] = {}

# --- landed pages -----------------------------------------------------------
FIXTURES["page_log"] = """
SELECT o_custkey % 75 AS run,
       CAST(floor(o_orderkey / 500) AS BIGINT) + 1 AS page,
       count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) AS n,
       max(CASE WHEN o_orderkey % 997 = 3 THEN 'FetchFailed'
                WHEN o_orderkey % 1009 = 5 THEN 'MappingError'
                WHEN o_orderkey % 1013 = 7 THEN 'LoadFailed' END) AS error
FROM @orders
GROUP BY o_custkey % 75, CAST(floor(o_orderkey / 500) AS BIGINT) + 1
"""
FIXTURES["run_config"] = """
SELECT run,
       CAST(1 + run % 2 AS BIGINT) AS start_page,
       CAST(CASE WHEN run % 4 > 0 THEN run % 4 END AS BIGINT) AS page_size,
       CAST(CASE run % 5 WHEN 0 THEN 500 WHEN 1 THEN 3 WHEN 2 THEN 10 WHEN 3 THEN 1 ELSE 6 END
            AS BIGINT) AS max_pages,
       CASE WHEN run % 13 = 1 THEN '4' WHEN run % 13 = 2 THEN ''
            WHEN run % 31 = 5 THEN 'abc' END AS cursor,
       run % 3 = 0 AS retain_empty
FROM (SELECT DISTINCT o_custkey % 75 AS run FROM @orders) r
"""
FIXTURES["order_pages"] = """
SELECT CAST(floor(floor(o_orderkey / 100) / 12) AS BIGINT) AS run,
       CAST(floor(o_orderkey / 100) AS BIGINT) % 12 + 1 AS page,
       CAST(floor(o_orderkey / 100) AS BIGINT) % 50 AS variant,
       o_orderkey, o_custkey, o_orderstatus,
       CAST(round(o_totalprice * 100) AS BIGINT) AS cents
FROM @orders
"""
FIXTURES["order_items"] = """
SELECT run, page, variant, o_orderkey,
       concat('{"o_orderkey":', o_orderkey, ',"cust":{"id":', o_custkey, '},"cents":', cents,
              CASE WHEN o_orderkey % 7 = 0 THEN ',"note":null'
                   WHEN o_orderkey % 7 = 1 THEN '' ELSE concat(',"note":"n', o_orderkey % 10, '"') END,
              ',"status":"', o_orderstatus, '"}') AS item
FROM order_pages
"""
FIXTURES["page_items"] = """
SELECT run, page, variant,
       $JOIN(item|o_orderkey) AS items,
       coalesce($JOIN(CASE WHEN o_orderkey % 100 < 60 THEN item END|o_orderkey), '') AS some_items
FROM order_items
GROUP BY run, page, variant
"""
FIXTURES["page_bodies"] = """
SELECT run, page, variant,
       CASE WHEN variant = 47 THEN concat('{"data":{"items":[', items)
            WHEN variant = 48 THEN concat('{"payload":[', items, ']}')
            WHEN variant = 49 THEN '{"data":{"items":"not-a-list"}}'
            WHEN variant = 46 THEN concat('[', items, ']')
            WHEN variant = 45 THEN '{"data":{"items":[]}}'
            WHEN variant >= 40 THEN concat('{"data":{"items":[', some_items, ']}}')
            ELSE concat('{"data":{"items":[', items, ']}}') END AS body
FROM page_items
"""
FIXTURES["landed_runs"] = """
SELECT run, run % 5 AS config_id, CAST(1 AS BIGINT) AS start_page,
       CAST(CASE WHEN run % 3 <> 1 THEN 100 END AS BIGINT) AS page_size,
       CAST(CASE WHEN run % 4 = 3 THEN 5 ELSE 500 END AS BIGINT) AS max_pages,
       CASE WHEN run % 4 = 2 THEN '4' WHEN run % 7 = 5 THEN '11' WHEN run % 7 = 3 THEN '10' END AS cursor,
       run % 2 = 0 AS retain_empty,
       CAST(CASE WHEN run % 4 = 2 THEN 3 WHEN run % 7 = 5 THEN 10 WHEN run % 7 = 3 THEN 9 ELSE 0 END AS BIGINT) AS pages_extracted,
       CAST(CASE WHEN run % 4 = 2 THEN 300 WHEN run % 7 = 5 THEN 940 WHEN run % 7 = 3 THEN 900 ELSE 0 END AS BIGINT) AS records_extracted,
       CAST(CASE WHEN run % 4 = 2 THEN 300 WHEN run % 7 = 5 THEN 940 WHEN run % 7 = 3 THEN 900 ELSE 0 END AS BIGINT) AS records_loaded,
       CAST(CASE WHEN run % 4 = 2 THEN 4 WHEN run % 7 = 5 THEN 10 WHEN run % 7 = 3 THEN 9 ELSE 0 END AS BIGINT) AS raw_payload_count,
       CASE WHEN run % 6 < 5 THEN concat('tenant-', run % 5) END AS tenant_uuid
FROM (SELECT DISTINCT run FROM order_pages) r
"""
# Pages as they arrive, with what went wrong outside of their bodies, and values that fit no column.
FIXTURES["troubled_pages"] = """
SELECT run, page, variant,
       CASE WHEN (run * 12 + page) % 29 = 9 THEN replace(body, '"cents":', '"cents":"n/a","_":') ELSE body END AS body,
       CASE WHEN (run * 12 + page) % 31 = 17 THEN 'FetchFailed' END AS fetch_error,
       CASE WHEN (run * 12 + page) % 37 = 21 THEN 'LoadFailed' END AS load_error
FROM page_bodies
"""
# Pages that land again, unchanged or in another version, and pages that never land, some beside a repeated one.
FIXTURES["relanded_pages"] = """
SELECT run, page, 0 AS arrival, variant, body FROM page_bodies WHERE (run * 12 + page) % 41 <> 6
UNION ALL
SELECT run, page, 1, variant, body FROM page_bodies WHERE (run * 12 + page) % 23 = 4 OR (run * 12 + page) % 41 IN (5, 7)
UNION ALL
SELECT run, page, 2, 47, concat('{"data":', page) FROM page_bodies WHERE (run * 12 + page) % 19 = 3
UNION ALL
SELECT run, page, 3, variant, body FROM page_bodies WHERE (run * 12 + page) % 23 = 4
"""
# Settings of pipelines: source configurations with what a pipeline overrides, and mappings as column:path;…
FIXTURES["pipeline_settings"] = """
SELECT config_id, base, override, mapping, types, config_id = 2 AS strict
FROM (SELECT config_id,
        CASE config_id WHEN 4 THEN '{"base_url":"https://a.example.test","records_key":"payload"}'
                       WHEN 1 THEN '{"records_path":"wrong","page":1}' ELSE '{"records_path":"data.items","records_key":"rows"}' END AS base,
        CASE config_id WHEN 1 THEN '{"records_path":"data.items"}' WHEN 4 THEN '{"records_path":""}' ELSE '{}' END AS override,
        CASE config_id WHEN 0 THEN 'order_id:o_orderkey;customer_id:cust.id;cents:cents;note:note'
                       WHEN 1 THEN 'number:o_orderkey;state:status' WHEN 2 THEN 'order_id:o_orderkey;state:status'
                       WHEN 3 THEN '' ELSE 'key:o_orderkey;client:cust.id' END AS mapping,
        CASE config_id WHEN 0 THEN 'order_id:bigint;cents:bigint;note:string' WHEN 4 THEN 'client:bigint' ELSE '' END AS types
      FROM (SELECT DISTINCT config_id FROM landed_runs) c) s
"""
# Pages of these pipelines; on some a field that a strict mapping asks for has another name.
FIXTURES["mixed_pages"] = """
SELECT run, page, variant, CASE WHEN (run * 12 + page) % 17 = 5 THEN replace(body, '"status"', '"state"') ELSE body END AS body,
       fetch_error, load_error
FROM troubled_pages
"""
FIXTURES["response_log"] = """
SELECT CAST(floor(event_id / 2) AS BIGINT) % 97 AS run,
       CAST(floor(event_id / 2) AS BIGINT) AS page,
       event_id % 2 + 1 AS try,
       CAST(floor(event_id / 2) AS BIGINT) % 3 <> 0 AS has_provider,
       CAST(CASE WHEN event_id % 41 = 7 THEN NULL
            WHEN event_id % 43 = 9 THEN 302
            WHEN event_id % 47 = 11 THEN 403
            WHEN event_type = 'signup' THEN 401
            WHEN event_type = 'purchase' THEN 429
            WHEN event_type = 'error' AND event_id % 4 = 0 THEN 503
            WHEN event_type = 'error' AND event_id % 4 = 1 THEN 404
            WHEN event_type = 'error' AND event_id % 4 = 2 THEN 600
            WHEN event_type = 'error' THEN 500
            ELSE 200 END AS INT) AS status
FROM @events
"""
FIXTURES["source_configs"] = """
SELECT p_partkey AS connection_id,
       concat('{',
         CASE WHEN p_partkey % 17 = 0 THEN '"base_url":"",' WHEN p_partkey % 17 = 1 THEN ''
              ELSE '"base_url":"https://api.example.test",' END,
         CASE WHEN p_partkey % 19 = 0 THEN '"path":null' WHEN p_partkey % 19 = 1 THEN '"path":[]'
              ELSE concat('"path":"/v1/', p_size, '"') END,
         CASE p_partkey % 7 WHEN 0 THEN ',"method":"post"' WHEN 1 THEN ',"method":"PUT"'
              WHEN 2 THEN ',"method":"Get"' ELSE '' END,
         CASE p_partkey % 11 WHEN 0 THEN ',"max_pages":true' WHEN 1 THEN ',"max_pages":0'
              WHEN 2 THEN ',"max_pages":"9"' WHEN 3 THEN ',"max_pages":2.5'
              WHEN 4 THEN concat(',"max_pages":', p_size) ELSE '' END,
         CASE p_partkey % 13 WHEN 0 THEN ',"start_page":null' WHEN 1 THEN ',"start_page":3'
              WHEN 2 THEN ',"start_page":-1' ELSE '' END,
         CASE p_partkey % 23 WHEN 0 THEN ',"timeout_seconds":0.5' WHEN 1 THEN ',"timeout_seconds":0'
              WHEN 2 THEN ',"timeout_seconds":false' WHEN 3 THEN ',"timeout_seconds":"30"' ELSE '' END,
         CASE p_partkey % 29 WHEN 0 THEN ',"max_response_bytes":1024'
              WHEN 1 THEN ',"max_response_bytes":1.5' WHEN 2 THEN ',"max_response_bytes":-4' ELSE '' END,
         CASE p_partkey % 3 WHEN 0 THEN ',"records_path":"data.items"' WHEN 1 THEN ',"records_path":""'
              ELSE '' END,
         CASE p_partkey % 4 WHEN 0 THEN ',"records_key":"rows"' WHEN 1 THEN ',"records_key":""' ELSE '' END,
         '}') AS config,
       p_size, p_brand
FROM @part
"""
FIXTURES["config_overrides"] = """
SELECT c_custkey AS config_id, c_custkey % 2000 AS connection_id,
       concat('{"tag":"t', c_custkey % 5, '"',
         CASE c_custkey % 4 WHEN 0 THEN ',"path":"/override"' WHEN 1 THEN ',"path":null' ELSE '' END,
         CASE c_custkey % 3 WHEN 0 THEN concat(',"max_pages":', c_custkey % 9) ELSE '' END,
         '}') AS extraction_config
FROM @customer
"""
FIXTURES["connections"] = """
SELECT p_partkey AS connection_id, p_name AS name,
       CASE WHEN p_partkey % 2 = 0 THEN 'source' ELSE 'destination' END AS kind,
       CASE p_partkey % 6 WHEN 0 THEN 'rest_api' WHEN 1 THEN 'sqlserver' WHEN 2 THEN 'rest_api'
            WHEN 3 THEN 'sqlserver' WHEN 4 THEN 'ftp' ELSE 'rest_api' END AS connector_type
FROM @part
"""

# --- records to map -----------------------------------------------------------
FIXTURES["mapping_records"] = """
SELECT CAST(floor(event_id / 1600) AS BIGINT) AS run,
       CAST(floor(event_id / 100) AS BIGINT) % 16 + 1 AS page,
       event_id % 100 AS pos, event_id,
       CASE WHEN event_id % 701 = 11 THEN '[1,2]' WHEN event_id % 703 = 9 THEN 'null'
            WHEN event_id % 709 = 3 THEN '"text"'
       ELSE concat('{"id":', event_id, ',"user":{"id":', user_id,
              CASE WHEN event_id % 1201 = 77 THEN '' ELSE concat(',"type":"', event_type, '"') END,
              '},"tags":[1,2]',
              CASE event_id % 3 WHEN 0 THEN concat(',"value":', CAST(round(value * 100) AS BIGINT))
                                WHEN 1 THEN ',"value":null' ELSE '' END,
              ',"props":', props, '}') END AS record
FROM @events
"""

# --- raw payloads and stored objects ---------------------------------------------
FIXTURES["raw_payloads"] = """
SELECT doc_id AS arrival, doc_id % 20 AS run, doc_id % 20 % 6 AS config_id,
       CAST(floor(doc_id / 20) AS BIGINT) % 10 + 1 AS sequence,
       text AS payload, source AS source_path, n_chars AS item_count
FROM @documents
"""
FIXTURES["organizations"] = """
SELECT CAST(n_nationkey AS BIGINT) AS org_id, n_name AS name, lower(n_name) AS schema_name,
       concat(substr(md5(n_name), 1, 8), '-', substr(md5(n_name), 9, 4), '-', substr(md5(n_name), 13, 4),
              '-', substr(md5(n_name), 17, 4), '-', substr(md5(n_name), 21, 12)) AS tenant_uuid
FROM @nation
"""

# --- execution history ------------------------------------------------------------
FIXTURES["runs"] = """
SELECT o_orderkey AS run_id, o_custkey AS config_id, o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'succeeded' ELSE 'pending' END AS status,
       CASE WHEN o_orderstatus = 'F' THEN
         CASE o_orderpriority WHEN '1-URGENT' THEN 'PageLimitExceededError' WHEN '2-HIGH' THEN 'FetchFailed'
              WHEN '3-MEDIUM' THEN 'LoadFailed' WHEN '5-LOW' THEN 'MappingError' ELSE 'KeyError' END
       END AS error_category,
       CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 400 <> 0 THEN o_orderkey - 5 END AS continued_from,
       CAST(o_orderkey % 6 + 1 AS STRING) AS last_successful_cursor,
       o_orderkey % 6 AS pages_extracted, o_orderkey % 6 * 10 AS records_extracted,
       o_orderkey % 6 * 10 AS records_loaded, o_orderkey % 6 AS raw_payload_count
FROM @orders
"""
FIXTURES["claim_events"] = """
SELECT event_id AS seq, CAST(floor(event_id / 8) AS BIGINT) AS run,
       CASE event_type WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail' ELSE 'claim' END AS kind,
       CASE WHEN event_type IN ('purchase', 'error') OR event_id % 11 = 0 THEN NULL
            ELSE concat('task-', user_id % 2) END AS task
FROM @events
"""
FIXTURES["attempt_log"] = """
SELECT CAST(floor(event_id / 7) AS BIGINT) AS run, CAST(event_id % 7 + 1 AS BIGINT) AS attempt, ts AS started_at,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN NULL
            WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'MappingError'
            WHEN event_type = 'purchase' THEN 'LoadFailed' ELSE 'FetchFailed' END AS category,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN NULL
            WHEN event_type = 'error' AND event_id % 3 = 0 THEN false
            WHEN event_id % 17 = 0 THEN false ELSE true END AS retryable
FROM @events
"""
FIXTURES["status_changes"] = """
SELECT event_id AS seq, user_id AS run, ts AS changed_at,
       CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'running'
            WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status
FROM @events
"""
FIXTURES["trigger_requests"] = """
SELECT event_id AS request_id, event_id % 9 AS config_id,
       event_id % 9 <> 8 OR event_id % 2 = 0 AS is_active,
       CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 10 = 1 THEN ''
            ELSE concat(event_type, '-', user_id, '-', event_id % 3) END AS idempotency_key,
       CASE WHEN event_id % 13 = 0 THEN event_id END AS continue_from
FROM @events
"""
FIXTURES["run_claim_times"] = """
SELECT event_id AS request_id, event_id + user_id % 60 * 40 AS claimed_order
FROM @events WHERE user_id % 4 <> 0
"""
FIXTURES["continuable_source"] = """
SELECT run_id, run_id % 9 AS config_id, status, error_category, last_successful_cursor,
       pages_extracted, records_extracted, records_loaded, raw_payload_count
FROM runs
"""

# --- migration jobs, people and audit ------------------------------------------------
FIXTURES["jobs"] = """
SELECT event_id AS job_id, user_id % 25 AS org_id, ts AS created_at, ts AS updated_at,
       CASE event_id % 9 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'succeeded'
            WHEN 3 THEN 'partially_failed' WHEN 4 THEN 'failed' WHEN 5 THEN 'cancelled'
            WHEN 6 THEN 'running' ELSE 'succeeded' END AS status,
       event_id % 4 <> 0 AS dry_run, event_id % 12 = 5 AS cancel_requested, event_id % 97 = 5 AS raised,
       event_id % 3 AS missing_objects, CAST(floor(event_id / 3) AS BIGINT) % 2 AS checksum_conflicts,
       event_id % 50 AS records_inspected, event_id % 7 AS already_migrated,
       event_id % 5 AS legacy_unprefixed, event_id % 6 AS schema_prefixed,
       event_id % 11 AS ready_for_migration, event_id % 8 AS records_migrated,
       event_id % 13 AS records_skipped,
       CASE WHEN event_id % 97 = 5 THEN concat('error ', event_type) END AS error_message
FROM @events
"""
FIXTURES["memberships"] = """
SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS org_id, c_custkey % 50 = 0 AS is_staff,
       CASE c_custkey % 4 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'engineer' ELSE 'analyst' END AS role
FROM @customer
UNION ALL
SELECT c_custkey, (c_nationkey + 7) % 25, c_custkey % 50 = 0,
       CASE c_custkey % 5 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin' WHEN 2 THEN 'engineer'
            WHEN 3 THEN 'analyst' ELSE 'guest' END
FROM @customer WHERE c_custkey % 3 = 0
"""

# --- text, URLs and addresses --------------------------------------------------------
FIXTURES["error_texts"] = """
SELECT doc_id,
       CASE doc_id % 9
         WHEN 0 THEN concat('Authorization: Bearer abc', doc_id, ' rest ', text)
         WHEN 1 THEN concat('sent bearer   tok', doc_id, ', then ', text)
         WHEN 2 THEN concat('{"API-Key" : "k', doc_id, '", "x": 1} ', text)
         WHEN 3 THEN concat('password=p', doc_id, ';apikey=', doc_id, ' ', text)
         WHEN 4 THEN concat('AUTHORIZATION=', doc_id, ' secret', ' ', text)
         ELSE text END AS message
FROM @documents
"""
FIXTURES["page_urls"] = "SELECT page_id, url FROM @pages"
FIXTURES["urls"] = """
SELECT page_id,
       CASE page_id % 11
         WHEN 0 THEN replace(url, '://', '://user:pw@')
         WHEN 1 THEN replace(url, '.example', '.EXAMPLE')
         WHEN 2 THEN replace(url, 'https://', 'ftp://')
         WHEN 3 THEN substr(url, strpos_url + 3)
         WHEN 4 THEN replace(url, '/en/', ':8443/en/')
         WHEN 5 THEN substr(url, strpos_url + 1)
         WHEN 6 THEN concat(substr(url, 1, strpos_url + 2), '/x')
         ELSE url END AS url
FROM (SELECT page_id, url, instr(url, '://') AS strpos_url FROM @pages) p
"""
FIXTURES["host_addresses"] = """
SELECT page_id, concat('h', page_id % 40, '.example.test') AS host,
       CASE page_id % 16
         WHEN 0 THEN concat('10.', page_id % 256, '.0.1') WHEN 1 THEN '127.0.0.1'
         WHEN 2 THEN '169.254.169.254' WHEN 3 THEN concat('224.0.0.', page_id % 256)
         WHEN 4 THEN '0.0.0.0' WHEN 5 THEN concat('203.0.113.', page_id % 256)
         WHEN 6 THEN concat('192.168.', page_id % 256, '.9') WHEN 7 THEN '192.0.0.9'
         WHEN 8 THEN '192.0.0.8' WHEN 9 THEN concat('172.', 16 + page_id % 20, '.3.4')
         WHEN 10 THEN '255.255.255.255' WHEN 11 THEN concat('198.', 17 + page_id % 4, '.1.1')
         ELSE concat(20 + page_id % 90, '.', page_id % 200, '.7.', page_id % 250) END AS address
FROM @pages
"""
FIXTURES["host_addresses_v6"] = """
SELECT page_id, CASE page_id % 10
         WHEN 0 THEN '::1' WHEN 1 THEN concat('fe80::', page_id % 999) WHEN 2 THEN concat('ff02::', page_id % 999)
         WHEN 3 THEN '::' WHEN 4 THEN concat('fd00:1::', page_id % 999) WHEN 5 THEN concat('2001:db8::', page_id % 999)
         WHEN 6 THEN concat('::ffff:10.0.0.', page_id % 250) WHEN 7 THEN '::ffff:127.0.0.1'
         WHEN 8 THEN concat('2606:4700::', page_id % 999) ELSE concat('8.8.8.', page_id % 250) END AS address
FROM @pages
"""
FIXTURES["network_rules"] = """
SELECT CAST(s_suppkey AS BIGINT) AS priority,
       CASE WHEN s_suppkey % 17 = 0 THEN concat(s_suppkey % 200, '.1.0.0/8')
            WHEN s_suppkey % 19 = 0 THEN concat(s_suppkey % 200, '.0.0.0/33')
            WHEN s_suppkey % 6 = 0 THEN concat(s_suppkey % 224, '.0.0.0/8')
            WHEN s_suppkey % 6 = 1 THEN concat(s_suppkey % 224, '.', s_suppkey % 256, '.0.0/16')
            WHEN s_suppkey % 6 = 2 THEN concat('192.168.', s_suppkey % 256, '.0/24')
            WHEN s_suppkey % 6 = 3 THEN concat('10.', s_suppkey % 256, '.0.1/32')
            WHEN s_suppkey % 6 = 4 THEN concat(2 * (s_suppkey % 112), '.0.0.0/7')
            ELSE concat(20 + s_suppkey % 90, '.', s_suppkey % 200, '.4.0/22') END AS cidr,
       CASE s_suppkey % 4 WHEN 0 THEN 'private' WHEN 1 THEN 'partner' WHEN 2 THEN 'reserved' END AS category
FROM @supplier
"""
FIXTURES["host_policy"] = """
SELECT concat(' H', r, '.Example.test ') AS host,
       CASE r % 4 WHEN 0 THEN 'deployment_private' WHEN 1 THEN 'tenant_private'
            WHEN 2 THEN 'unsafe' ELSE 'insecure_http' END AS list
FROM (SELECT DISTINCT page_id % 40 AS r FROM @pages) t
WHERE r % 3 <> 0
"""
FIXTURES["load_requests"] = """
SELECT p_partkey AS load_id, CASE WHEN p_partkey % 31 = 0 THEN 'upsert' ELSE 'append' END AS mode,
       CASE WHEN p_partkey % 29 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) END AS n_records,
       concat('{"host":"db"',
         CASE p_partkey % 13 WHEN 0 THEN ',"schema_name":"9bad"' WHEN 1 THEN ',"schema_name":"sales"'
              WHEN 2 THEN ',"schema_name":7' ELSE '' END,
         CASE WHEN p_partkey % 17 = 3 THEN '' ELSE concat(',"table_name":"',
           CASE p_partkey % 7 WHEN 0 THEN 'orders' WHEN 1 THEN 'parts' WHEN 2 THEN 'drop table'
                WHEN 3 THEN 'ghost' ELSE 'events' END, '"') END,
         CASE p_partkey % 11 WHEN 0 THEN ',"batch_size":0' WHEN 1 THEN ',"batch_size":true'
              WHEN 2 THEN ',"batch_size":2.5' WHEN 3 THEN ',"batch_size":50' ELSE '' END,
         '}') AS config,
       CASE p_partkey % 5 WHEN 0 THEN 'id,amount' WHEN 1 THEN 'id,zeta,alpha' WHEN 2 THEN 'id' ELSE 'id,kind' END
         AS column_list
FROM @part
"""
FIXTURES["destination_columns"] = """
SELECT DISTINCT CASE p_size % 2 WHEN 0 THEN 'dbo' ELSE 'sales' END AS schema_name,
       CASE p_size % 3 WHEN 0 THEN 'orders' WHEN 1 THEN 'parts' ELSE 'events' END AS table_name,
       CASE p_size % 4 WHEN 0 THEN 'id' WHEN 1 THEN 'amount' WHEN 2 THEN 'kind' ELSE 'alpha' END AS column_name
FROM @part
"""
FIXTURES["load_errors"] = """
SELECT event_id AS load_id,
       CASE event_type WHEN 'error' THEN 'operational' WHEN 'purchase' THEN 'integrity'
            WHEN 'signup' THEN 'other' END AS failure
FROM @events
"""
FIXTURES["storage_base"] = """
SELECT d.doc_id AS record_id, d.doc_id % 25 AS org_id, d.doc_id % 20 AS run, d.doc_id % 6 AS config_id,
       CAST(floor(d.doc_id / 20) AS BIGINT) + 1 AS sequence, d.text AS payload,
       o.tenant_uuid, o.schema_name
FROM @documents d JOIN organizations o ON o.org_id = d.doc_id % 25
"""

FIXTURES["deliveries"] = """
SELECT arrival + again * 1000000000 AS arrival, run, config_id, sequence, payload,
       CASE again WHEN 0 THEN source_path ELSE 'again' END AS source_path, item_count + again AS item_count,
       arrival % 27 AS org_id
FROM (SELECT *, $EACH(0, 1) AS again FROM raw_payloads) r
WHERE again = 0 OR arrival % 4 = 0
"""
FIXTURES["delivery_keys"] = """
SELECT d.*, $SHA(payload) AS sha,
       concat(config_id, '/', run, '/', lpad(CAST(sequence AS STRING), 6, '0'), '-', $SHA(payload), '.raw') AS lkey
FROM deliveries d
"""
FIXTURES["stored_objects"] = """
SELECT lkey AS key, max(octets) + max(CASE WHEN arrival % 50 = 7 THEN 1 ELSE 0 END) AS size_bytes
FROM (SELECT arrival, lkey, CAST(bit_length(payload) / 8 AS BIGINT) AS octets
      FROM delivery_keys WHERE arrival % 3 = 1) b
GROUP BY lkey
"""
FIXTURES["storage_records"] = """
SELECT record_id, org_id, run, config_id, sequence, payload, tenant_uuid, schema_name, sha AS checksum_sha256,
       CASE record_id % 5 WHEN 0 THEN concat('s3://pile/', tenant_uuid, '/', lkey)
            WHEN 1 THEN concat('s3://pile/', schema_name, '/', lkey)
            WHEN 3 THEN CASE record_id % 4 WHEN 0 THEN concat('s3://other/', lkey)
                             WHEN 1 THEN concat('http://pile/', lkey) WHEN 2 THEN 's3://pile/'
                             ELSE concat('s3://pile/', schema_name, '/x', lkey) END
            ELSE concat('s3://pile/', lkey) END AS storage_uri
FROM (SELECT b.*, $SHA(payload) AS sha,
             concat(config_id, '/', run, '/',
                    CASE WHEN sequence < 1000000 THEN lpad(CAST(sequence AS STRING), 6, '0')
                         ELSE CAST(sequence AS STRING) END, '-', $SHA(payload), '.raw') AS lkey
      FROM storage_base b) t
"""
FIXTURES["storage_objects"] = """
SELECT substr(storage_uri, 11) AS key, 'application/json' AS content_type,
       CASE WHEN record_id % 35 = 1 THEN concat(payload, '!') ELSE payload END AS body
FROM storage_records WHERE record_id % 5 IN (0, 1, 2)
"""

_TABLE = re.compile(r"@([a-z]+)")
_JOIN = re.compile(r"\$JOIN\((.*?)\|(\w+)\)", re.S)
_EACH = re.compile(r"\$EACH\(([^)]*)\)")
_SHA = re.compile(r"\$SHA\((\w+)\)")


def _needed(text: str) -> list[str]:
    """Fixtures mentioned in ``text``, dependencies first."""
    found: list[str] = []

    def visit(body: str) -> None:
        for name in FIXTURES:
            if re.search(rf"(?<![@\w]){name}(?!\w)", body) and name not in found:
                visit(FIXTURES[name])
                if name not in found:
                    found.append(name)

    visit(text)
    return found


def _with_clause(names: list[str]) -> str:
    parts = [f"{name} AS ({FIXTURES[name].strip()})" for name in names]
    return "WITH " + ",\n".join(parts)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named fixture as a DataFrame over the parquet tables in ``sf_dir``."""
    names = [*_needed(FIXTURES[name]), name]
    text = f"{_with_clause(names)}\nSELECT * FROM {name}"
    text = _JOIN.sub(r"listagg(\1, ',') WITHIN GROUP (ORDER BY \2)", text)
    text = _EACH.sub(r"explode(array(\1))", text)
    text = _SHA.sub(r"sha2(\1, 256)", text)
    return spark.sql(_TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str) -> str:
    """A checking query: ``body`` preceded by the fixtures it names.

    ``body`` may start with its own ``WITH`` or ``WITH RECURSIVE``.
    """
    names = _needed(body)
    body = body.strip()
    if names:
        own = re.match(r"WITH (RECURSIVE )?", body)
        head = _with_clause(names)
        if own:
            head, body = head + ",", body[own.end() :]
            if own[1]:
                head = head.replace("WITH ", "WITH RECURSIVE ", 1)
        body = f"{head}\n{body}"
    body = _JOIN.sub(r"string_agg(\1, ',' ORDER BY \2)", body)
    body = _EACH.sub(r"unnest([\1])", body)
    body = _SHA.sub(r"sha256(\1)", body)
    return _TABLE.sub(r"\1", body)
