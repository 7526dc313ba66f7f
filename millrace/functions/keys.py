"""Storage keys and URIs of raw payloads as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI_SCHEME = "s3://"
KEY_SUFFIX = ".raw"


def logical_key(config_id: Column, run: Column, sequence: Column, checksum: Column) -> Column:
    """Content-addressed key; sequences wider than six digits are not cut."""
    return F.format_string(
        f"%s/%s/%06d-%s{KEY_SUFFIX}",
        config_id.cast("string"),
        run.cast("string"),
        sequence.cast("bigint"),
        checksum,
    )


def tenant_key(tenant_uuid: Column, key: Column) -> Column:
    return F.concat(tenant_uuid, F.lit("/"), key)


def object_uri(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"{URI_SCHEME}{bucket}/"), key)


def uri_bucket(uri: Column) -> Column:
    """Bucket of a URI, NULL when the URI lacks scheme, bucket or key."""
    return F.nullif(F.regexp_extract(uri, r"(?s)^s3://([^/]+)/.+$", 1), F.lit(""))


def uri_key(uri: Column) -> Column:
    return F.nullif(F.regexp_extract(uri, r"(?s)^s3://[^/]+/(.+)$", 1), F.lit(""))


def uri_problem(uri: Column, bucket: str) -> Column:
    """Why a URI may not be read at all, NULL when its shape and bucket are fine."""
    return F.when(uri_bucket(uri).isNull(), "not a raw payload URI").when(
        uri_bucket(uri) != bucket, "other bucket"
    )


def key_tenant(key: Column) -> Column:
    return F.substring_index(key, "/", 1)


def key_checksum(key: Column) -> Column:
    """Checksum carried by a content-addressed key, NULL for any other shape.

    The file name up to its suffix is cut at the first dash; what follows must
    have the length of a SHA-256 in hex.
    """
    name = F.substring_index(key, "/", -1)
    stem = F.when(name.endswith(KEY_SUFFIX), F.left(name, F.length(name) - len(KEY_SUFFIX)))
    dash = F.instr(stem, "-")
    checksum = F.when(dash > 0, F.substr(stem, dash + 1))
    return F.when(F.length(checksum) == 64, checksum)
