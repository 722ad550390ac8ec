"""IPv6 addresses and nested prefixes against Python's ipaddress."""

from __future__ import annotations

import ipaddress
import random

from pyspark.sql import functions as F

from quietcount.functions import identity


def forms(rng, n):
    a = ipaddress.IPv6Address(n)
    return rng.choice([str(a), a.exploded, a.exploded.upper(), str(a).upper()])


def test_digits_of_addresses(spark):
    rng = random.Random(2)
    texts = [forms(rng, rng.getrandbits(128) & rng.choice([(1 << 128) - 1, ~((1 << 64) - 1), (0xFFFF << 112) | 0xFFFF, (1 << 16) - 1])) for _ in range(400)]
    texts += ["::", "::1", "1::", "::ffff:10.1.2.3", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8"]
    bad = ["1:2", "1::2::3", ":::", "12345::", "g::", "1:2:3:4:5:6:7:8:9", ":1:2:3:4:5:6:7:8", "10.0.0.1", "", None, "1:2:3:4:5:6:7:8::"]
    got = {r.ip: r.d for r in spark.createDataFrame([(t,) for t in texts + bad], "ip string").select("ip", identity.hex_address().alias("d")).collect()}
    assert {t: got[t] for t in texts} == {t: format(int(ipaddress.IPv6Address(t)), "032x") for t in texts}
    assert all(got[t] is None for t in bad)


def test_the_longest_prefix_counts(spark):
    rng = random.Random(3)
    base = int(ipaddress.IPv6Address("2001:db8::"))
    nets = {ipaddress.ip_network((base | (rng.getrandbits(32) << 64), bits), strict=False) for bits in (20, 32, 33, 35, 38, 45, 47, 48, 50, 61, 63, 64, 127, 128) for _ in range(12)}
    table = [(str(n.network_address), n.prefixlen, *rng.choice([(f"c{i}", None), (None, f"c{i}"), (f"c{i}", "zz")])) for i, n in enumerate(sorted(nets))]
    country = {n: f"C{i}" for i, n in enumerate(sorted(nets))}
    inside = [n.network_address + rng.randrange(min(n.num_addresses, 1 << 62)) for n in nets for _ in range(4)]
    ips = [str(a) for a in inside] + [forms(rng, base | rng.getrandbits(90)) for _ in range(100)] + ["2a00::1", "10.0.0.1", "bad:ip", None] * 5
    rows = spark.createDataFrame(list(enumerate(ips)), "event_id long, ip string")
    prefixes = spark.createDataFrame(table, "network string, bits int, country string, registered_country string")
    got = {r.event_id: r.country_code for r in identity.with_country6(rows, prefixes).collect()}
    assert len(got) == len(ips)
    for i, ip in enumerate(ips):
        try:
            held = [n for n in nets if ipaddress.IPv6Address(ip) in n]
        except ValueError:
            held = []
        assert got[i] == (country[max(held, key=lambda n: n.prefixlen)] if held else None), ip
    first = identity.with_country6(rows.withColumn("country_code", F.when(F.col("event_id") == 0, "XX")), prefixes)
    assert first.where("event_id = 0").first().country_code == "XX"
    assert identity.with_country6(rows.limit(3), prefixes.limit(0)).where("country_code IS NOT NULL").isEmpty()
