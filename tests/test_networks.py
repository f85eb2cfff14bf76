"""Ranges and addresses as Python's ipaddress has them."""

import ipaddress
import random

from pyspark.sql import functions as F

from spoor.operators import catalogue, networks


def _random_address(rng):
    if rng.random() < 0.4:
        return str(ipaddress.IPv4Address(rng.choice([0x0A000000, 0xC0A80000]) + rng.getrandbits(rng.choice([4, 16]))))
    groups = [rng.choice(["0", "0", "0", "db8", "0ABC", "1", "2001"]) for _ in range(8)]
    text = ":".join(groups)
    return str(ipaddress.IPv6Address(text)) if rng.random() < 0.7 else text


ODD = ["", " ", None, "*", "1.2.3", "01.2.3.4", "1.2.3.4.5", "::", "::1", "1::", ":1", "1:", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8::", "::ffff:1.2.3.4", "::1.2.3", "1.2.3.4::", "fe80::1%eth0", "g::1", "12345::1", "FE80::A", " 10.0.0.1 "]


def _address(text):
    try:
        return ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None


def test_addresses_and_ranges(spark):
    rng = random.Random(5)
    texts = ODD + [_random_address(rng) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", networks.address_bits(F.col("t")).alias("bits")).collect()
    for t, bits in got:
        a = _address(t)
        assert bits == (None if a is None else format(int(a), f"0{a.max_prefixlen}b")), t

    ranges = [f"{t}/{rng.choice([0, 7, 8, 16, 31, 32, 33, 47, 64, 127, 128, 129])}" for t in texts if t] + ["10.1.2.3", "10.0.0.0/255.0.0.0", "10.0.0.0/0.0.255.255", "10.0.0.0/255.0.255.0", "10.0.0.0/-1", "10.0.0.0/", "10.0.0.0/8/8", "1.2.3.4/08"]
    known = []
    for i, t in enumerate(ranges):
        try:
            n = ipaddress.ip_network(t.strip(), strict=False)
            if not (n.version == 6 and ("%" in t or n.network_address.ipv4_mapped)):  # those have more than one usual form
                known.append((i, n))
        except ValueError:
            known.append((i, None))
    df = spark.createDataFrame(list(enumerate(ranges)), "position int, cidr string").withColumn("name", F.col("position").cast("string"))
    made = {r.position: r.network for r in networks.parse_networks(df).collect()}
    assert {i: str(n) for i, n in known if n is not None} == {i: t for i, t in made.items() if i in dict(known)}

    wide = {i for i, n in known if n is not None and n.prefixlen >= 8}
    found = {r.address: int(r.name) for r in networks.match_networks(spark.createDataFrame([(t,) for t in texts], "address string"), df.where(F.col("position").isin(list(wide)))).collect()}
    expected = {}
    for t in texts:
        a = _address(t)
        inside = [i for i, n in known if i in wide and a is not None and n.version == a.version and int(a) >> (a.max_prefixlen - n.prefixlen) == int(n.network_address) >> (a.max_prefixlen - n.prefixlen)]
        if inside:
            expected[t] = min(inside)
    assert found == expected and len(found) > 100


def test_scan_has_both_ends(spark):
    at = lambda **x: {k: str(v) for k, v in x.items()}
    rows = [
        ("I", 1, "windows.netscan", at(foreignaddr="10.0.0.9", foreignport=0, localaddr="0.0.0.0", localport=50, state="")),
        ("I", 2, "windows.netstat", at(foreignaddr="2001:db8::5", foreignport=443, localaddr="10.0.0.1", localport=51, state="CLOSED")),
        ("I", 3, "windows.netscan", at(foreignaddr="*", localaddr="bad")),
        ("I", 4, "windows.pslist", at(foreignaddr="10.0.0.9")),
        ("J", 5, "windows.netscan", None),
    ]
    ends = networks.endpoints(spark.createDataFrame(rows, "investigation_id string, id long, plugin string, attributes map<string,string>"), F.col("attributes"))
    nets = spark.createDataFrame([(0, "six", "2001:db8::/32"), (1, "ten", "10.0.0.0/8"), (2, "all", "0.0.0.0/0"), (3, "bad", "x/8")], "position int, name string, cidr string")
    found = networks.scan_networks(ends, nets)
    assert sorted((r.id, r.name, r.detail) for r in found.collect()) == [
        (1, "ten", "remote address 10.0.0.9 port 50 state n/a via windows.netscan"),
        (2, "six", "remote address 2001:db8::5 port 443 state CLOSED via windows.netstat"),
        (2, "ten", "local address 10.0.0.1 port 443 state CLOSED via windows.netstat"),
    ]
    assert sorted(tuple(r) for r in networks.summarize_scan(found).select("address", "n_rows", "roles", "n_details").collect()) == [("10.0.0.1", 1, "local", 1), ("10.0.0.9", 1, "remote", 1), ("2001:db8::5", 1, "remote", 1)]
    assert [tuple(r) for r in networks.scan_totals(ends).collect()] == [("I", 3, 4, "windows.netscan,windows.netstat")]
    assert networks.scan_networks(ends.limit(0), nets).count() == 0


def test_networks_in_text(spark):
    asked = spark.createDataFrame([(1, "is 10.1.2.3 in 10.1.0.0/16, 2001:db8::/32 or 999.1.1.1/8?"), (2, None), (3, "")], "q long, question string")
    assert [(r.q, r.position, r.cidr) for r in catalogue.networks_in_text(asked).orderBy("q", "position").collect()] == [(1, 0, "10.1.0.0/16"), (1, 1, "2001:db8::/32"), (1, 2, "10.1.2.3")]
