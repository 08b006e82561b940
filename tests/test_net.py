"""Addresses of both families and host names against Python's own parser."""

import ipaddress
import random

from pyspark.sql import functions as F

from fleetlens.functions import net


def parsed(text):
    """Family and value; a dotted address written long is a dotted one."""
    try:
        at = ipaddress.ip_address("zone" if "%" in text else text)
    except ValueError:
        return None
    if at.version == 6 and at.ipv4_mapped:
        at = at.ipv4_mapped
    return at.version, int(at)


def expected(cidr, ip):
    """A mapped network of at least 96 bits is a dotted one; families never meet."""
    address, _, bits = cidr.partition("/")
    try:
        whole, n = ipaddress.ip_address(address), int(bits)
    except ValueError:
        return None
    if not 0 <= n <= whole.max_prefixlen or parsed(ip) is None:
        return None
    version, value = whole.version, int(whole)
    if version == 6 and whole.ipv4_mapped and n >= 96:
        version, value, n = 4, int(whole.ipv4_mapped), n - 96
    size = 32 if version == 4 else 128
    family, at = parsed(ip)
    return family == version and at >> (size - n) == value >> (size - n)


def texts(rng):
    value = rng.choice([rng.getrandbits(128), rng.getrandbits(64), 0xFD << 120 | rng.getrandbits(20), 0xFFFF << 32 | rng.getrandbits(32), rng.getrandbits(12), 0])
    at = ipaddress.IPv6Address(value)
    return rng.choice([at.compressed, at.exploded, at.compressed.upper(), str(ipaddress.IPv4Address(value & 0xFFFFFFFF)),
                       f"::ffff:{ipaddress.IPv4Address(value & 0xFFFFFFFF)}", f"fd00::{ipaddress.IPv4Address(value & 0xFFFFFFFF)}"])


def test_containment(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(3000):
        ip = texts(rng)
        if rng.random() < 0.5:  # a network that is likely to hold it
            other = rng.choice([ip, ipaddress.ip_address(ip).exploded])
        else:
            other = texts(rng)
        rows.append((f"{other}/{rng.choice([0, 1, 7, 8, 16, 24, 31, 32, 33, 63, 64, 65, 95, 96, 97, 104, 120, 127, 128, 129])}", ip))
    for ip in ("::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1.2.3.4", "bad", "", None, "fd00::1%eth0", "1:2:3:4:5:6:7:8:9", "::1.2.3.256"):
        rows += [(net_, ip) for net_ in ("::/0", "0.0.0.0/0", "::ffff:0:0/96", "::ffff:0.0.0.0/95", "1:2::/32", "1:2::/-1", "x/3", "1.2.3.0/24")]
    df = spark.createDataFrame(rows, "cidr string, ip string")
    got = net.with_inside(df, "inside", "cidr", "ip").collect()
    for r in got:
        assert r["inside"] == (None if r["ip"] is None else expected(r["cidr"], r["ip"])), r
    assert {r["inside"] for r in got} == {True, False, None}


def test_hostnames(spark):
    good = ["a", "A1", "a-b", "a.b.c", "x" * 63, "1.2", "a--b"]
    bad = ["", "-a", "a-", "a.-b", "a..b", ".a", "a.", "x" * 64, "a_b", "a b", "a\n", "ä", None]
    df = spark.createDataFrame([(x,) for x in good + bad], "name string")
    assert [r[0] for r in df.select(net.is_hostname(F.col("name"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_longer_addresses_are_written_out_once(spark):
    """Where ``::`` may stand, at both ends and before a dotted tail; validity comes with the value, not from a second pattern."""
    texts = ["::", ":::", "1::", "::1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "1:2:3:4::5:6:7:8",
             "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5::1.2.3.4", "1:2:3:4:5:6::1.2.3.4", "::1.2.3.4", "::ffff:1.2.3.4", "::1.2.3.256", "a:1.2.3.4:b",
             "1::2::3", "1::2:", ":1::2", "8000::8000:0:0:0", "12345::", "g::", "::1\n", "1.2.3.4::", "1.2.3.4", ".::", "1:2:3:4:5:6:7:8:9", ""]
    facts = spark.createDataFrame([(t,) for t in texts], "ip string").withColumns(net.address_facts(F.col("ip")))
    for r in facts.collect():
        at = parsed(r["ip"])
        assert r["_ip_ok"] == (at is not None) == (r["_ip_at"] is not None), r["ip"]
        if at:
            hi, lo = (r["_ip_at"][x] % (1 << 64) for x in ("hi", "lo"))
            assert (r["_ip_at"]["family"], hi >> 32 if at[0] == 4 else hi << 64 | lo) == at, r["ip"]
    networks = spark.createDataFrame([("::1/64",), ("::1/129",), ("::1//64",), ("::1/64/64",), ("::1",), ("1.2.3.4/032",), (None,)], "n string")
    found = networks.withColumns(net.network_facts(F.col("n")))
    assert [r["_net_ok"] for r in found.collect()] == [True, False, False, False, False, True, False]
    assert net._V6 not in facts._jdf.queryExecution().optimizedPlan().toString()
