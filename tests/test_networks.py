"""Longest-prefix match against the standard library, on nested networks and ranges of both kinds."""

import ipaddress
import random

from emberlog.operators import networks
from emberlog.plans import questions
from emberlog.sources import geo


def brute(ip, nets):
    try:
        a = ipaddress.ip_address(ip)
    except ValueError:
        return None
    hits = [(n.prefixlen, label) for n, label in nets if n.version == a.version and a in n]
    most = max((p for p, _ in hits), default=None)
    return min((label for p, label in hits if p == most), default=None)


def test_nested_networks_equal_the_library(spark):
    rng = random.Random(3)
    nets = [(ipaddress.ip_network((rng.getrandbits(32), rng.choice([0, 3, 8, 9, 16, 24, 31, 32])), strict=False), f"a{i}") for i in range(60)]
    nets += [(ipaddress.ip_network((rng.getrandbits(8) << 120 | rng.getrandbits(120), rng.choice([1, 7, 32, 48, 64, 65, 96, 128])), strict=False), f"b{i}") for i in range(60)]
    nets += [(ipaddress.ip_network(n.supernet(prefixlen_diff=min(4, n.prefixlen))), f"c{i}") for i, (n, _) in enumerate(nets)]
    ips = [str(n[rng.randrange(min(n.num_addresses, 1 << 62))]) for n, _ in nets for _ in range(3)] + [str(ipaddress.ip_address(rng.getrandbits(32))) for _ in range(100)] + ["", "x", "1.2.3", "::ffff:1.2.3.4", "010.1.1.1"]
    df = spark.createDataFrame([(i, ip) for i, ip in enumerate([*ips, *ips[:20], None])], "id int, ip string").repartition(3)
    table = networks.networks(spark.createDataFrame([(str(n), label) for n, label in nets] + [("junk", "j"), (None, "j")], "net string, label string"), "net", "label")
    got = {r.id: r.label for r in networks.lookup(df, "ip", table).collect()}
    assert len(got) == len(ips) + 21
    for i, ip in enumerate([*ips, *ips[:20]]):
        if ip.startswith("::ffff:"):  # an IPv4 address in the form of IPv6
            assert got[i] == brute("1.2.3.4", nets)
        else:
            assert got[i] == brute(ip, nets), ip


def test_ranges_are_covered_exactly():
    rng = random.Random(4)
    for _ in range(300):
        a = rng.randrange(2000)
        b = a + rng.randrange(300)
        found = list(networks.cover(a, b))
        assert [x for base, n in found for x in range(base, base + (1 << (128 - n)))] == list(range(a, b + 1))
    assert list(networks.cover(0, (1 << 128) - 1)) == [(0, 0)]


def test_countries_of_both_kinds(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("start,end,country\n8.8.0.0,8.8.255.255,US\n8.8.8.0,8.8.8.255,CO\n2a00::,2a00:ffff:ffff:ffff:ffff:ffff:ffff:ffff,FR\n2a00:1::,2a00:1:ffff:ffff:ffff:ffff:ffff:ffff,DE\n")
    nets = geo.geo_networks(spark, str(path))
    rows = [("8.8.8.8",), ("8.8.1.1",), ("8.8.1.1",), ("2a00:1::5",), ("2a00:2::5",), ("9.9.9.9",), ("10.0.0.1",), (None,)]
    kind, got = questions.answer("which countries are the destinations", spark.createDataFrame(rows, "dst_ip string"), ranges=nets)
    assert kind == "countries" and {(r.country, r.events, r.ips) for r in got.collect()} == {("US", 2, 1), ("CO", 1, 1), ("FR", 1, 1), ("DE", 1, 1), (None, 1, 1)}
    (tmp_path / "cidr.csv").write_text("8.8.0.0/16,US\n2a00::/16,FR\n")
    assert {r.label for r in networks.lookup(spark.createDataFrame(rows, "ip string"), "ip", geo.geo_networks(spark, str(tmp_path / "cidr.csv"))).collect()} == {"US", "FR", None}
    assert networks.lookup(spark.createDataFrame(rows, "ip string"), "ip", nets.limit(0)).filter("label IS NOT NULL").count() == 0
