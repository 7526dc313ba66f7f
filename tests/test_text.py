"""Redaction, URLs and addresses against Python's own libraries."""

import ipaddress
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from millrace.functions.addresses import address_category, ipv4_category
from millrace.functions.text import redact, sanitize
from millrace.functions.urls import sanitize_redirect, split_url
from millrace.operators import outbound


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Authorization: Bearer abc123 failed", "Authorization: [redacted] failed"),
        ("authorization=xyz", "authorization=[redacted]"),
        ("sent bearer tok", "sent bearer [redacted]"),
        ("password=hunter2 user=x", "password=[redacted] user=x"),
        ('{"api_key": "k1", "a": 1}', '{"api_key": "[redacted] "a": 1}'),
        ("API-KEY : v and apikey=w", "API-KEY : [redacted] and apikey=[redacted]"),
        ("token = abc rest", "token = [redacted] rest"),
        ("pa\u017f\u017fword=x", "pa\u017f\u017fword=[redacted]"),
        ("toKen=x", "toKen=[redacted]"),
        ("token\x1c=\x1dabc\x1ernext", "token\x1c=\x1d[redacted]\x1ernext"),
        ("nothing to hide", "nothing to hide"),
        ("a token alone", "a token alone"),
        (None, None),
    ],
)
def test_redaction(spark, text, want):
    assert apply(spark, redact, text) == [want]


def test_redaction_is_stable_and_leaves_no_secret(spark):
    once = apply(spark, redact, "secret=s3 Authorization: Bearer b1 token:'t9'")
    assert not any(s in once[0] for s in ("s3", "b1", "t9"))


def test_truncation_counts_characters_after_redaction(spark):
    long, exact = apply(spark, sanitize, "é" * 5000, "x" * 1000)
    assert long == "é" * 1000 + "... [truncated]" and exact == "x" * 1000
    assert "topsecret" not in apply(spark, sanitize, "y" * 990 + " token=topsecret")[0]


URLS = [
    "https://a.test/p?q=1#f", "HTTP://User:Pw@Host.TEST:8080/x", "https://a.test:0/x", "https://a.test:/x",
    "//host/path", "host/path", "mailto:x@y", "http://[::1]:80/x", "http://[::1", "http://a]b/", "/only/path", "",
    "  https://lead.test/x", "ht\ntps://tab.test/\ty", "https://a@b@c.test/", "http://:pw@h.test", "http://@h.test",
    "https:///nohost", "http://h.test?x=http://other", "1http://x.test/", "https://fe80.test%25zone/",
]


def python_redirect(location):
    try:
        parts = urlsplit(location)
    except ValueError:
        return "<redirect-target-omitted>"
    if not parts.hostname:
        return "<redirect-target-omitted>"
    try:
        port = parts.port
    except ValueError:
        return None
    netloc = f"{parts.hostname}:{port}" if port else parts.hostname
    return f"{parts.scheme}://{netloc}{parts.path}" if parts.scheme else netloc


def test_redirect_targets_match_the_standard_library(spark):
    bad_ports = ["http://h.test:99999/x", "http://h.test:abc/x", "http://h.test:8a/"]
    urls = URLS + bad_ports
    assert apply(spark, sanitize_redirect, *urls) == [python_redirect(u) for u in urls]


def test_url_parts_match_the_standard_library(spark):
    good = [u for u in URLS if u not in ("http://[::1", "http://a]b/")]
    for name, want in (
        ("scheme", lambda p: p.scheme), ("host", lambda p: p.hostname or ""), ("path", lambda p: p.path),
        ("username", lambda p: p.username or ""), ("password", lambda p: p.password or ""),
    ):
        got = apply(spark, lambda u, n=name: getattr(split_url(u), n), *good)
        assert got == [want(urlsplit(u)) for u in good], name


def test_admission_rules_come_in_order(spark, rows):
    urls = ["ftp://u:p@h/", "http://u@h.test/", "https://", "http://open.test/", "http://Shut.test/", "https://x.test/"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    policy = spark.createDataFrame([(" Open.TEST", "insecure_http"), ("shut.test", "tenant_private")], "host string, list string")
    assert rows(outbound.admit_urls(df, policy, "i"), "i", "problem") == [
        (0, "scheme"), (1, "credentials"), (2, "no host"), (3, None), (4, "plain http"), (5, None),
    ]
    assert outbound.admit_urls(df, policy, "i", allow_http=True).where("i = 4").first().problem is None


def python_category(text):
    ip = ipaddress.ip_address(text)
    tests = ("loopback", "link_local", "multicast", "unspecified", "private")
    return next((t.replace("_", "-") for t in tests if getattr(ip, f"is_{t}")), None)


def test_ipv4_categories_match_the_standard_library(spark):
    rng = random.Random(5)
    some = [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(3000)]
    nets = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
            "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]
    for net in map(ipaddress.ip_network, nets):
        first, last = int(net.network_address), int(net.broadcast_address)
        some += [str(ipaddress.IPv4Address(n)) for n in (first - 1, first, first + 1, last - 1, last, last + 1) if 0 <= n < 1 << 32]
    some += [f"192.0.0.{i}" for i in range(8, 12)] + [f"192.0.0.17{i}" for i in range(3)]
    got = apply(spark, ipv4_category, *some)
    assert [(a, c) for a, c in zip(some, got) if c != python_category(a)] == []


def test_mixed_addresses(spark):
    texts = ["::1", "fe80::1%eth0", "ff02::1", "::", "fd00::1", "2606:4700::1", "::ffff:10.0.0.1", "8.8.8.8", "10.0.0.1",
             "256.1.1.1", "nonsense", "1:2:3", "1.2.3", None]
    want = ["loopback", "link-local", "multicast", "unspecified", "private", None, "private", None, "private",
            "invalid", "invalid", "invalid", "invalid", "invalid"]
    assert apply(spark, address_category, *texts) == want


def test_allowlists_and_the_all_addresses_rule(spark, rows):
    df = spark.createDataFrame(
        [(1, "in.test", "10.0.0.1"), (2, "in.test", "127.0.0.1"), (3, "any.test", "127.0.0.1"), (4, "out.test", "8.8.8.8"),
         (5, "out.test", "10.0.0.9"), (6, "ok.test", "10.0.0.3"), (7, "ok.test", "9.9.9.9")],
        "i int, host string, address string",
    )
    policy = spark.createDataFrame(
        [("IN.test ", "tenant_private"), ("any.test", "unsafe"), ("ok.test", "deployment_private")], "host string, list string"
    )
    decided = outbound.decide_addresses(df, policy, "i", address_category)
    assert rows(decided.where("NOT allowed"), "i", "category") == [(2, "loopback"), (5, "private")]
    hosts = spark.createDataFrame([("in.test",), ("any.test",), ("out.test",), ("ok.test",), ("none.test",)], "host string")
    assert rows(outbound.host_verdicts(hosts, decided, "i"), "host", "blocked", "category") == [
        ("any.test", False, None), ("in.test", True, "loopback"), ("none.test", True, "unresolved"),
        ("ok.test", False, None), ("out.test", True, "private"),
    ]


def test_ipv6_against_the_standard_library(spark):

    draw = random.Random(3)
    texts = ["::", "::1", "1::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:127.0.0.1", "fe80::1%eth0", "fe80::1%", "1::2::3", ":::", "1:2:3:4:5:6:7",
             "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "12345::", "g::", "64:ff9b:1::1", "2001:db8::1", "2001:1::1", "2001:3::1",
             "2002::1", "ff02::1", "fc00::1", "::1.2.3.4", "1::1.2.3.4.5", "::01.2.3.4", ":1", "1:", "2606:4700::1111"]
    texts += [":".join(draw.choice(["", "0", "1", "ff", "fe80", "2001", "db8", "ffff"]) for _ in range(draw.randint(2, 9))) for _ in range(600)]

    def want(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return "invalid"
        tests = [("loopback", ip.is_loopback), ("link-local", ip.is_link_local), ("multicast", ip.is_multicast), ("unspecified", ip.is_unspecified), ("private", ip.is_private)]
        return next((name for name, hit in tests if hit), None)

    texts = [t for t in texts if ":" in t]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select("a", address_category(F.col("a")).alias("c")).collect()
    assert [(r.a, r.c, want(r.a)) for r in rows if r.c != want(r.a)] == []


def test_leading_zeros_are_no_address(spark):
    rows = spark.createDataFrame([("008.8.8.8",), ("8.8.8.08",), ("0.8.8.8",), ("8.8.8.8",)], "a string")
    assert [r.c for r in rows.select(address_category(F.col("a")).alias("c")).collect()] == ["invalid", "invalid", "private", None]
