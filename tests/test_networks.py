"""Categories of addresses by rules in a table."""

import ipaddress
import random

from millrace.operators import networks

RULES = "cidr string, priority bigint, category string"


def test_rules_equal_a_walk_over_all_of_them(spark):
    draw = random.Random(3)
    rules, nets = [], []
    for k in range(300):
        if k % 2:
            bits = draw.choice([0, 1, 7, 8, 16, 20, 31, 32])
            net = ipaddress.ip_network((draw.choice([10 << 24, 192 << 24]) + draw.getrandbits(18), bits), strict=False)
        else:
            bits = draw.choice([0, 3, 16, 33, 64, 127, 128])
            net = ipaddress.ip_network(((0x2001 << 112) + (draw.getrandbits(4) << 64) + draw.getrandbits(3), bits), strict=False)
        rules.append((str(net), draw.randint(0, 40), draw.choice([None, "a", "b"])))
        nets.append(net)
    asked = [str(ipaddress.IPv4Address(draw.choice([10 << 24, 192 << 24, 8 << 24]) + draw.getrandbits(18))) for _ in range(300)]
    asked += [str(ipaddress.IPv6Address((0x2001 << 112) + (draw.getrandbits(4) << 64) + draw.getrandbits(3))) for _ in range(300)]
    asked += ["::ffff:10.0.0.7", "::ffff:a00:7", "fe80::1%eth0", "::", *asked[:50]]

    def walk(text):
        address = ipaddress.ip_address(text.split("%")[0])
        address = getattr(address, "ipv4_mapped", None) or address
        fits = [
            (p, -n.prefixlen, c or "", c) for n, (_, p, c) in zip(nets, rules, strict=True) if n.version == address.version and address in n
        ]
        best = min(fits, key=lambda x: x[:3], default=(None, 0, "", None))
        return best[3], best[0]

    got = networks.categories_by_rules(
        spark.createDataFrame(list(enumerate(asked)), "row int, address string"), spark.createDataFrame(rules, RULES)
    ).collect()
    assert sorted((r["row"], r["address"], r["category"], r["priority"]) for r in got) == [(k, a, *walk(a)) for k, a in enumerate(asked)]


def test_what_is_no_address_and_rules_that_name_no_network(spark):
    rules = [("10.0.0.1/8", 1, "x"), ("10.0.0.0", 1, "x"), ("10.0.0.0/33", 1, "x"), ("10.0.0.0/08", 1, "x"), ("ten/8", 1, "x"), (None, 1, "x")]
    rules += [("::ffff:10.0.0.0/104", 2, "mapped"), ("::ffff:0:0/90", 1, "x"), ("1::/129", 1, "x"), ("10.0.0.0/8/8", 1, "x")]
    table = spark.createDataFrame(rules, RULES)
    found = {r["cidr"]: r["problem"] for r in networks.read_rules(table).collect()}
    assert found == {
        "10.0.0.1/8": "host bits", "10.0.0.0": "length", "10.0.0.0/33": "length", "10.0.0.0/08": "length", "ten/8": "address", None: "address",
        "::ffff:10.0.0.0/104": None, "::ffff:0:0/90": "host bits", "1::/129": "length", "10.0.0.0/8/8": "length",
    }
    asked = spark.createDataFrame([("10.1.2.3",), ("10.01.2.3",), ("",), (None,), ("11.0.0.1",)], "address string")
    got = {r["address"]: (r["category"], r["priority"]) for r in networks.categories_by_rules(asked, table).collect()}
    assert got == {"10.1.2.3": ("mapped", 2), "10.01.2.3": ("invalid", None), "": ("invalid", None), None: ("invalid", None), "11.0.0.1": (None, None)}
    nothing = networks.categories_by_rules(asked, table.limit(0)).collect()
    assert {r["category"] for r in nothing} == {"invalid", None}
    assert networks.categories_by_rules(asked.limit(0), table).collect() == []
