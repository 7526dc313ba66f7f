"""URL parts as column expressions, split the way lenient URL parsers do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import OMITTED_REDIRECT

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_BRACKET_HOST = r"^\[([0-9A-Fa-f:.]+(?:%[^\]]*)?|[vV][0-9A-Fa-f]+\..+)\](?::.*)?$"


@dataclass(frozen=True)
class UrlParts:
    """Scheme and host in lower case; empty parts are empty strings.

    ``broken`` marks a URL whose brackets do not enclose an address. ``port``
    is NULL when absent; ``bad_port`` marks one that is no port number.
    """

    scheme: Column
    username: Column
    password: Column
    host: Column
    port: Column
    bad_port: Column
    path: Column
    broken: Column


def split_url(url: Column) -> UrlParts:
    clean = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(clean, _SCHEME, 1))
    rest = F.regexp_replace(clean, _SCHEME, "")
    netloc = F.regexp_extract(rest, r"^//([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^(?://[^/?#]*)?([^?#]*)", 1)
    userinfo = F.regexp_extract(netloc, r"^(.*)@", 1)
    address = F.regexp_replace(netloc, r"^.*@", "")
    bracketed = address.startswith("[")
    in_brackets = F.regexp_extract(address, r"^\[([^\]]*)", 1)
    raw_host = F.when(bracketed, in_brackets).otherwise(F.substring_index(address, ":", 1))
    zone = F.regexp_extract(raw_host, r"(%.*)$", 1)
    raw_port = F.when(bracketed, F.regexp_extract(address, r"\]:(.*)$", 1)).otherwise(
        F.regexp_extract(address, r"^[^:]*:(.*)$", 1)
    )
    number = F.when(raw_port.rlike(r"^[0-9]+$"), raw_port.try_cast("int"))
    has_bracket = netloc.contains("[") | netloc.contains("]")
    return UrlParts(
        scheme=scheme,
        username=F.substring_index(userinfo, ":", 1),
        password=F.regexp_extract(userinfo, r"^[^:]*:(.*)$", 1),
        host=F.concat(F.lower(F.substring_index(raw_host, "%", 1)), zone),
        port=number,
        bad_port=(raw_port != "") & ~F.coalesce(number <= 65535, F.lit(False)),
        path=path,
        broken=has_bracket & ~address.rlike(_BRACKET_HOST),
    )


def sanitize_redirect(location: Column) -> Column:
    """A redirect target reduced to scheme, host, port and path.

    Query, fragment and credentials are dropped; a target without host becomes
    a placeholder. NULL where the port is not a port number: such a target
    cannot be rendered and fails its run as unexpected.
    """
    parts = split_url(location)
    netloc = F.concat(
        parts.host, F.when(parts.port > 0, F.concat(F.lit(":"), parts.port.cast("string"))).otherwise("")
    )
    return (
        F.when(parts.broken | (parts.host == ""), OMITTED_REDIRECT)
        .when(parts.bad_port, F.lit(None).cast("string"))
        .when(parts.scheme != "", F.concat(parts.scheme, F.lit("://"), netloc, parts.path))
        .otherwise(netloc)
    )


def admission_problem(url: Column, http_allowed: Column) -> Column:
    """First rule a URL breaks before any address is looked at, NULL when admitted."""
    parts = split_url(url)
    return (
        F.when(parts.broken, "unparsable")
        .when(~parts.scheme.isin("http", "https"), "scheme")
        .when((parts.username != "") | (parts.password != ""), "credentials")
        .when(parts.host == "", "no host")
        .when((parts.scheme == "http") & ~http_allowed, "plain http")
    )
