"""Literal addresses against the standard library."""

import ipaddress
import random

import pytest

from provlake.functions import rules
from provlake.operators import urls


def values(spark, names, column):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    return [r.x for r in df.select("i", column(df.name).alias("x")).orderBy("i").collect()]


def spelled(rng, n):
    """One of the ways to write an address."""
    groups = [f"{n >> 16 * k & 0xFFFF:x}" for k in range(7, -1, -1)]
    long = [g.rjust(4, "0") for g in groups]
    return rng.choice([str(ipaddress.IPv6Address(n)), ":".join(groups), ":".join(long), f"{':'.join(long[:6])}:{ipaddress.IPv4Address(n & 0xFFFFFFFF)}"])


def test_keys_of_all_forms(spark):
    rng = random.Random(4)
    some = [rng.choice([rng.getrandbits(128), rng.getrandbits(16), rng.getrandbits(128) & ~(((1 << 64) - 1) << rng.randrange(0, 64)), 0xFFFF << 32 | rng.getrandbits(32), 0]) for _ in range(400)]
    four = [rng.getrandbits(32) for _ in range(100)]
    names = [f"[{spelled(rng, n)}]" for n in some] + [str(ipaddress.IPv4Address(n)) for n in four]
    assert values(spark, names, urls.address_key) == [f"{n:032x}" for n in some] + [f"{(0xFFFF << 32) + n:032x}" for n in four]


@pytest.mark.parametrize("bad", ["[1:2:3]", "[:::]", "[1::2::3]", "[12345::]", "[1:2:3:4:5:6:7:8:9]", "[::1.2.3]", "[::1.2.3.256]", "[1:2:3:4:5:6:7:8::]", "[g::1]", "[]", "[:1]", "[1:]", "[::1", "1.2.3", "256.1.1.1", "host.org", "", "[1:2:3:4:5:6:7:1.2.3.4]"])
def test_no_address_has_no_key(spark, bad):
    assert values(spark, [bad], urls.address_key) == [None]


@pytest.mark.parametrize("n", [1, 2, 7, 10_000])
def test_networks(spark, n):
    rng = random.Random(n)
    nets = [ipaddress.ip_network((rng.getrandbits(32), rng.randrange(8, 33)), strict=False) if rng.random() < 0.5 else ipaddress.ip_network((rng.getrandbits(128), rng.randrange(8, 129)), strict=False) for _ in range(n)]
    found = urls.address_intervals(map(str, nets))
    assert all(a <= b for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))
    asked = [ipaddress.ip_address(int(x.network_address) + rng.randrange(x.num_addresses)) if x.version == 4 else ipaddress.IPv6Address(int(x.network_address) + rng.randrange(x.num_addresses)) for x in rng.sample(nets, min(n, 40))]
    asked += [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(60)] + [ipaddress.IPv6Address(rng.getrandbits(128)) for _ in range(60)]
    got = values(spark, [str(x) if x.version == 4 else f"[{x}]" for x in asked], lambda c: urls.in_intervals(urls.address_key(c), found))
    number = lambda a: int(a) + (0xFFFF << 32 if a.version == 4 else 0)
    assert got == [any(number(net.network_address) <= number(x) <= number(net.broadcast_address) for net in nets) for x in asked]


def test_safety_of_literal_addresses(spark):
    nets = [ipaddress.ip_network(x) for x in (*rules.BLOCKED_V4, *rules.BLOCKED_V6)]
    rng = random.Random(9)
    every = [ipaddress.ip_address(int(n[k])) if n.version == 4 else n[k] for n in nets for k in (0, -1)]
    near = [type(n[0])(int(n[-1]) + 1) for n in nets if int(n[-1]) + 1 < 1 << n.max_prefixlen]
    asked = every + near + [ipaddress.IPv4Address(rng.getrandbits(32)) for _ in range(50)]
    hosts = [str(x) if x.version == 4 else f"[{x.exploded}]" for x in asked]
    assert values(spark, [f"http://{h}:80/x" for h in hosts], lambda c: urls.url_safety(c)["safe"]) == [not any(x in n for n in nets if n.version == x.version) for x in asked]
    others = {"http://[::ffff:127.0.0.1]/": "internal_address", "http://[0:0:0:0:0:0:0:1]/": "internal_address", "http://[fe80::1%eth0]/": "internal_address", "http://[nonsense]/": "bad_address", "http://u:p@[::1]:8080/": "internal_address", "http://[2001:db8::1]/": "safe", "http://example.org/": "safe"}
    assert values(spark, list(others), lambda c: urls.url_safety(c)["reason"]) == list(others.values())


@pytest.mark.parametrize("name", ["b02_url_safety", "b02_ipv6_safety"])
def test_queries_on_large_keys(spark, tmp_path, name):
    """Keys whose products pass 64 bits, against SQL with its key as a HUGEINT."""
    import duckdb

    from provlake.plans import catalog

    rows = [(k, n) for k in (1, 150_000, 600_000, 542_000, 36_000_000, 10**12) for n in range(1, 8)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT l_orderkey::HUGEINT AS l_orderkey, l_linenumber FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = {(r.l_orderkey, r.l_linenumber): (r.url, r.safe) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    assert got == {(k, n): (u, s) for k, n, u, s in con.execute(f"SELECT l_orderkey, l_linenumber, url, safe FROM ({catalog.ORACLE_SQL[name]})").fetchall()}
