"""URL host extraction, host-suffix rules and IP classification.

Everything is a Column expression: hosts, IPv4 literals as one number, IPv6
literals as two, tested by ranges and by equal prefixes in one projection.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: IPv4 networks Python's ipaddress (3.13) reports as private;
# loopback (127/8), link-local (169.254/16) and reserved (240/4) fall inside
# them. The two exception hosts are not private.
PRIVATE_V4 = [
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
]
PRIVATE_V4_EXCEPTIONS = ["192.0.0.9/32", "192.0.0.10/32"]

# The same for IPv6 (private, loopback, link-local and reserved together);
# addresses that map IPv4 lie in the reserved ::/8.
INTERNAL_V6 = [
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3",
    "e000::/4", "f000::/5", "f800::/6", "fe00::/9", "fc00::/7", "fe80::/10", "2001::/23", "2001:db8::/32", "2002::/16",
]
INTERNAL_V6_EXCEPTIONS = ["2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28"]

NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
OCTET = r"(0|[1-9][0-9]{0,2})"
IPV4 = rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"


def _host_of(url: Column) -> Column:
    netloc = F.regexp_extract(url, NETLOC, 1)
    hostinfo = F.regexp_extract(netloc, r"([^@]*)$", 1)
    host = F.when(hostinfo.contains("["), F.regexp_extract(hostinfo, r"\[([^\]]*)", 1)) \
        .otherwise(F.regexp_extract(hostinfo, r"^([^:]*)", 1))
    return F.nullif(F.lower(host), F.lit(""))


def hostname(url: Column) -> Column:
    """Lower-case host of a URL; a scheme-less value is read as
    ``http://<value>``; no host → NULL. Mirrors ``urlparse().hostname``."""
    u = F.ltrim(url)
    direct = _host_of(u)
    retry = F.when(~u.contains("://") & ~u.startswith("//"), _host_of(F.concat(F.lit("http://"), u)))
    return F.coalesce(direct, retry)


def strict_hostname(url: Column) -> Column:
    """Host without the scheme-less retry (``is_internal_endpoint`` form)."""
    return _host_of(F.ltrim(url))


def matches_suffixes(host: Column, suffixes: list[str]) -> Column:
    """A suffix with a leading '.' matches by ``endswith``; any other
    entry must equal the host (".x.org" does not match "x.org").
    Pass a column reference: ``host`` is used once per suffix."""
    clean = [s.strip().lower() for s in suffixes if s.strip()]
    h = F.lower(F.trim(host))
    cond = F.lit(False)
    for s in clean:
        cond = cond | (h.endswith(s) if s.startswith(".") else (h == s))
    return F.coalesce(F.when(h != "", cond), F.lit(False))


def ipv4_value(host: Column) -> Column:
    """The IPv4 address as a number, or NULL when the host is not a dotted
    quad Python would accept (four decimal octets, no leading zeros)."""
    parts = F.split(host, r"\.")
    octets = [F.get(parts, i).cast("bigint") for i in range(4)]
    ok = host.rlike(IPV4)
    for o in octets:
        ok = ok & (o <= 255)
    value = octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3]
    return F.when(ok, value)


def in_ranges(value: Column, cidrs: list[str]) -> Column:
    """An OR of range tests (stays in generated code, unlike a lambda)."""
    cond = F.lit(False)
    for c in cidrs:
        n = ipaddress.ip_network(c)
        cond = cond | value.between(int(n.network_address), int(n.broadcast_address))
    return cond


def _v6_groups(host: Column) -> Column:
    """The eight groups of an IPv6 literal (a zone left out), or NULL."""
    address = F.regexp_extract(host, r"^([^%]*)(?:%[^%]+)?$", 1)
    tail = ipv4_value(F.regexp_extract(address, r"([^:]*)$", 1))  # a.b.c.d in place of the last two groups
    quad = F.concat(F.regexp_extract(address, r"^(.*:)[^:]*$", 1), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(F.lit(0xFFFF))))
    text = F.when(address.contains("."), quad).otherwise(address)

    def expand(x):
        halves = F.split(x, "::", -1)
        groups = lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(F.split(h, ":", -1))
        left = groups(F.get(halves, 0))
        right = F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>"))
        n = F.size(left) + F.size(right)
        filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), right)
        ok = ((F.size(halves) == 1) & (n == 8)) | ((F.size(halves) == 2) & (n <= 7))
        return F.when(ok & F.forall(filled, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")), filled)

    return F.when(host.contains(":"), F.get(F.transform(F.array(text), expand), 0))


def ipv6_value(host: Column) -> Column:
    """An IPv6 literal as its upper and lower 64 bits, or NULL."""
    def word(groups, first):
        return F.aggregate(F.slice(groups, first, 4), F.lit(0).cast("bigint"),
                           lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))
    return F.get(F.transform(F.array(_v6_groups(host)), lambda g: F.when(g.isNotNull(), F.struct(word(g, 1).alias("hi"), word(g, 5).alias("lo")))), 0)


def _in_prefixes(v6: Column, cidrs: list[str]) -> Column:
    """An OR of prefix tests on the two words."""
    cond = F.lit(False)
    for c in cidrs:
        n = ipaddress.ip_network(c)
        hi, lo = int(n.network_address) >> 64, int(n.network_address) & (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        if n.prefixlen <= 64:
            shift = 64 - n.prefixlen
            cond = cond | (F.shiftrightunsigned(v6["hi"], shift) == F.lit(hi >> shift).cast("bigint"))
        else:
            shift = 128 - n.prefixlen
            cond = cond | ((v6["hi"] == F.lit(signed(hi)).cast("bigint")) & (
                F.shiftrightunsigned(v6["lo"], shift) == F.lit(signed(lo) if not shift else lo >> shift).cast("bigint")))
    return cond


def internal_from_parts(host: Column, v4: Column, v6: Column, internal_suffixes: list[str],
                        allow_private_ips: bool = True) -> Column:
    """C26 from a staged host column and its staged IPv4 and IPv6 values (all
    plain column references, so the tests do not re-parse the host)."""
    by_name = matches_suffixes(host, internal_suffixes)
    if not allow_private_ips:
        return F.coalesce(host.isNotNull() & by_name, F.lit(False))
    by_ip = F.when(v4.isNotNull(), in_ranges(v4, PRIVATE_V4) & ~in_ranges(v4, PRIVATE_V4_EXCEPTIONS)) \
        .when(v6.isNotNull(), _in_prefixes(v6, INTERNAL_V6) & ~_in_prefixes(v6, INTERNAL_V6_EXCEPTIONS))
    return F.coalesce(host.isNotNull() & (by_name | F.coalesce(by_ip, F.lit(False))), F.lit(False))


def is_internal(url: Column, internal_suffixes: list[str], allow_private_ips: bool = True) -> Column:
    """C26 as one Column, also inside lambdas. The host and its address are
    bound once through one-element arrays."""
    parsed = F.transform(F.array(strict_hostname(url)), lambda h: F.struct(h.alias("h"), ipv4_value(h).alias("v4"), ipv6_value(h).alias("v6")))
    return F.get(F.transform(parsed, lambda p: internal_from_parts(p["h"], p["v4"], p["v6"], internal_suffixes, allow_private_ips)), 0)


def with_internal_flag(df: DataFrame, url: str, out: str, internal_suffixes: list[str],
                       allow_private_ips: bool = True) -> DataFrame:
    """C26 as a column ``out``, in one projection: host and addresses are
    staged as columns, then tested."""
    staged = df.withColumn("_h", strict_hostname(F.col(url))).withColumns({"_v4": ipv4_value(F.col("_h")), "_v6": ipv6_value(F.col("_h"))})
    flag = internal_from_parts(F.col("_h"), F.col("_v4"), F.col("_v6"), internal_suffixes, allow_private_ips)
    return staged.withColumn(out, flag).drop("_h", "_v4", "_v6")


def host_suffixes(host: Column) -> Column:
    """Every candidate key a host can match in a suffix table: the host
    itself and each '.'-led tail (a.b.c → a.b.c, .b.c, .c). The list length
    is the number of labels, so an equi-join on it replaces a theta join."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                        lambda i: F.concat(F.lit("."), F.array_join(F.slice(labels, i + 1, n), ".")))
    return F.array_distinct(F.concat(F.array(host), F.when(n > 1, tails).otherwise(F.array().cast("array<string>"))))
