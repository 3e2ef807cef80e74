"""IP verdicts must equal Python's ipaddress (private/loopback/link-local/reserved)."""

import ipaddress

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triage.functions.netaddr import with_private_ip
from triage.plans.oracle import py_private

EDGE = ["", "*", "0", "::", "0.0.0.0", "8.8.8.8", "10.1.2.3", "100.64.0.1", "192.0.0.9", "192.0.0.170",
        "01.2.3.4", "1.2.3", "256.1.1.1", "255.255.255.255", "224.0.0.1", "240.0.0.1", "::1",
        "fe80::1%eth0", "::ffff:8.8.8.8", "2001:db8::1", "2001::1", "2001:1::1", "2001:1::3", "2002::1",
        "2a00:1450::200e", "ff02::1", "fec0::1", "fc00::1", "1::2::3", ":1:2", "gggg::1", "not-an-ip",
        "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "::1.2.3.4", "64:ff9b:1::1", "100::1"]


def _check(spark, addrs):
    df = spark.createDataFrame([(a,) for a in addrs], "a string")
    got = {r.a: r.p for r in with_private_ip(df, "a", "p").collect()}
    for a in addrs:
        assert got[a] == py_private(a), a


def test_edge_addresses(spark):
    _check(spark, EDGE)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.ip_addresses().map(str), st.integers(0, 2**32 - 1).map(lambda n: str(ipaddress.IPv4Address(n)))),
                min_size=50, max_size=200, unique=True))
def test_random_addresses(spark, addrs):
    _check(spark, addrs)
