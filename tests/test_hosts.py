"""Literal hosts in all spellings against the standard library's address parser."""

import ipaddress
import random

from pyspark.sql import functions as F

from ramparts.functions import urls


def classes(spark, hosts):
    rows = spark.createDataFrame([(h, f"http://{h}/x") for h in hosts], "host string, url string")
    return dict(rows.select("host", urls.host_class(F.col("url"))).collect())


def expected(address):
    nets = [("loopback", ["127.0.0.0/8"]), ("private", ["0.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]),
            ("link-local", ["169.254.0.0/16"]), ("carrier-nat", ["100.64.0.0/10"])]
    if address.version == 6:
        if address.ipv4_mapped:
            return expected(address.ipv4_mapped)
        nets = [("loopback", ["::/128", "::1/128"]), ("private", ["fc00::/7"]), ("link-local", ["fe80::/10"])]
    return next((name for name, ranges in nets if any(address in ipaddress.ip_network(r) for r in ranges)), "public")


def test_spellings(spark):
    want = {"2130706433": "loopback", "0x7f.1": "loopback", "0177.0.0.1": "loopback", "127.1": "loopback", "[::ffff:7f00:1]": "loopback", "[::ffff:127.0.0.1]": "loopback",
            "0": "private", "0xa000001": "private", "10.0xffff": "private", "192.168.257": "private", "169.254.43518": "link-local", "1.1.1.1.": "public", "0x8080808": "public",
            "300.1.1.1": "invalid", "1.2.3.4.5": "invalid", "08.1.1.1": "invalid", "4294967296": "invalid", "1.2.3.256": "invalid", "0xg.1": "invalid", "1..1": "invalid",
            "[1:2:3]": "invalid", "[::1::]": "invalid", "[12345::]": "invalid", "[::1.2.3.300]": "invalid", "a.example": "public", "1.example": "public", "x.0x1f.net": "public"}
    assert classes(spark, want) == want


def test_random_addresses(spark):
    pick, want = random.Random(3), {}
    for _ in range(400):
        four = ipaddress.IPv4Address(pick.choice([pick.getrandbits(32), 0x7F000000 | pick.getrandbits(24), 0xA9FE0000 | pick.getrandbits(16), 0x64400000 | pick.getrandbits(22)]))
        n = int(four)
        low, mid = n & 0xFFFFFF, n & 0xFFFF
        spelling = pick.choice([str(four), str(n), hex(n), oct(n).replace("0o", "0"), f"{n >> 24}.{low}", f"{hex(n >> 24)}.{(n >> 16) & 255}.{mid}"])
        want[spelling] = expected(four)
        six = ipaddress.IPv6Address(pick.choice([pick.getrandbits(128), pick.getrandbits(16), 0xFFFF00000000 | n, (0xFD << 120) | pick.getrandbits(30), (0xFE80 << 112) | pick.getrandbits(40)]))
        want[f"[{pick.choice([six.compressed, six.exploded])}]"] = expected(six)
    assert classes(spark, want) == want
