"""Addresses, networks, hardware addresses and host names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.collections import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_HEX = r"[0-9A-Fa-f]{1,4}"


def _v6_pattern() -> str:
    """Full, compressed and dotted-tail forms, one alternative per position of ``::``."""
    forms = [rf"(?:{_HEX}:){{7}}{_HEX}", rf"(?:{_HEX}:){{6}}{_V4}"]
    for head in range(0, 8):
        lead = rf"(?:{_HEX}(?::{_HEX}){{{head - 1}}})" if head else ""
        tail = 7 - head
        rest = rf"(?:{_HEX}(?::{_HEX}){{0,{tail - 1}}})?" if tail else ""
        forms.append(rf"{lead}::{rest}")
        if head <= 5:
            groups = 5 - head
            forms.append(rf"{lead}::(?:{_HEX}:){{0,{groups}}}{_V4}")
    return "(?:" + "|".join(forms) + ")"


_V6 = _v6_pattern()
_EIGHT = rf"\A(?:{_HEX}:){{7}}{_HEX}\z"
_V4_CIDR = rf"\A{_V4}/0*(?:3[0-2]|[12]?[0-9])\z"
_V6_BITS = r"\A0*(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])\z"
_LABEL_LETTERS = "a-zA-Z0-9-"
_LABEL_LENGTH = 63


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(rf"\A{_V4}\z"), F.lit(False))


def is_ipv6(ip: Column) -> Column:
    return F.coalesce(ip.contains(":") & ip.rlike(rf"\A{_V6}\z"), F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def ip_family(ip: Column) -> Column:
    return F.when(is_ipv4(ip), 4).when(is_ipv6(ip), 6)


def is_cidr(cidr: Column) -> Column:
    v4 = cidr.rlike(_V4_CIDR)
    v6 = cidr.contains(":") & cidr.rlike(rf"\A{_V6}/0*(?:12[0-8]|1[01][0-9]|[1-9]?[0-9])\z")
    return F.coalesce(v4 | v6, F.lit(False))


def _dotted_value(ip: Column) -> Column:
    value = F.lit(0).cast("bigint")
    for i in range(1, 5):
        value = value * 256 + F.substring_index(F.substring_index(ip, ".", i), ".", -1).try_cast("bigint")
    return value


def ipv4_to_long(ip: Column) -> Column:
    """Dotted text to its 32-bit value; null when it is not a dotted address."""
    return F.when(is_ipv4(ip), _dotted_value(ip))


def cidr_prefix(cidr: Column) -> Column:
    return F.when(is_cidr(cidr), F.substring_index(cidr, "/", -1).try_cast("int"))


def cidr_address(cidr: Column) -> Column:
    """The address as written before the slash.  It is not masked."""
    return F.when(F.locate("/", cidr) > 1, F.substring_index(cidr, "/", 1)).otherwise(cidr)


def cidr_netmask(cidr: Column) -> Column:
    """Dotted mask; ``255.255.255.0`` when the text is no dotted network."""
    bits = F.when(is_ipv4(F.substring_index(cidr, "/", 1)), cidr_prefix(cidr))

    def octet(i: int) -> Column:
        ones = F.greatest(F.lit(0), F.least(F.lit(8), bits - 8 * i))
        return (F.lit(256) - F.pow(F.lit(2), F.lit(8) - ones)).cast("int").cast("string")

    return F.when(bits.isNull(), F.lit("255.255.255.0")).otherwise(
        F.concat_ws(".", *[octet(i) for i in range(4)]))


def _eight_groups(ip: Column) -> Column:
    """Longer-family text with its dotted tail as two groups and ``::`` written out; eight groups if, and only if, it is valid."""
    tail = F.substring_index(ip, ":", -1)
    plain = F.when(~tail.contains("."), ip).otherwise(let(ipv4_to_long(tail), lambda dotted: F.concat(
        F.substring(ip, F.lit(1), F.length(ip) - F.length(tail)), F.hex(F.shiftright(dotted, 16)), F.lit(":"),
        F.hex(dotted.bitwiseAND(0xFFFF)))))

    def written_out(text: Column) -> Column:
        at, colons = F.locate("::", text), F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
        open_end = text.startswith("::") | text.endswith("::")
        # an open end takes a zero of its own; between groups ``::`` stands for one zero at least
        zeros = F.when(colons < 8, F.concat(F.lit(":"), F.repeat(F.lit("0:"), 8 - colons))).when(
            (colons == 8) & open_end, ":").otherwise("::")
        left, right = F.left(text, at - 1), F.substring(text, at + 2, F.length(text))
        zero = F.lit("0")
        return F.when(at == 0, text).otherwise(F.concat(
            F.when(left == "", zero).otherwise(left), zeros, F.when(right == "", zero).otherwise(right)))

    return let(plain, written_out)


def _six_halves(ip: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of both 64-bit halves of longer-family text; null where the text is not valid."""
    def halves(groups: Column) -> Column:
        word = [F.conv(F.concat(*[F.lpad(F.get(groups, i + j), 4, "0") for j in range(4)]), 16, -10).cast("bigint") for i in (0, 4)]
        return F.struct(word[0].alias("hi"), word[1].alias("lo"))

    return let(_eight_groups(ip), lambda full: F.when(full.rlike(_EIGHT), let(let(F.split(full, ":"), halves), body)))


def _is_mapped(at: Column) -> Column:
    """Does longer-family text carry a dotted address?"""
    return (at["hi"] == 0) & (F.shiftrightunsigned(at["lo"], 32) == 0xFFFF)


def _at(family: int, hi: Column, lo: Column, *bits: Column) -> Column:
    return F.struct(F.lit(family).alias("family"), hi.alias("hi"), lo.alias("lo"), *[b.alias("bits") for b in bits])


def network_facts(cidr: Column, prefix: str = "_net") -> dict[str, Column]:
    """Validity of a network, and its family, value and length, to be computed once per network row."""
    none = F.lit(0).cast("bigint")
    address, length = F.substring_index(cidr, "/", 1), F.substring_index(cidr, "/", -1)
    bits = length.try_cast("int")
    wide = _six_halves(address, lambda w: F.when(
        _is_mapped(w) & (bits >= 96), _at(4, F.shiftleft(w["lo"], 32), none, bits - 96)).otherwise(_at(6, w["hi"], w["lo"], bits)))
    # dotted ones, the common case, stay in generated code
    at = F.when(cidr.rlike(_V4_CIDR), _at(4, F.shiftleft(_dotted_value(address), 32), none, bits)).when(
        cidr.contains(":") & (F.length(address) + F.length(length) + 1 == F.length(cidr)) & length.rlike(_V6_BITS), wide)
    return {f"{prefix}_ok": at.isNotNull(), f"{prefix}_at": at}


def address_facts(ip: Column, prefix: str = "_ip") -> dict[str, Column]:
    """Validity of an address, and its family and value, to be computed once per address row.

    A dotted address written in the longer form belongs to the dotted family.
    """
    none = F.lit(0).cast("bigint")
    wide = _six_halves(ip, lambda w: F.when(_is_mapped(w), _at(4, F.shiftleft(w["lo"], 32), none)).otherwise(
        _at(6, w["hi"], w["lo"])))
    at = F.when(is_ipv4(ip), _at(4, F.shiftleft(_dotted_value(ip), 32), none)).when(ip.contains(":"), wide)
    return {f"{prefix}_ok": at.isNotNull(), f"{prefix}_at": at}


def inside(net: str = "_net", ip: str = "_ip") -> Column:
    """Is the address in the network, from the columns of the two fact functions?

    False across families, null when either is invalid.
    """
    n, a = F.col(f"{net}_at"), F.col(f"{ip}_at")

    def alike(half: str, first: Column) -> Column:
        """Are the first bits of this half equal?  A shift by all 64 bits would be none."""
        apart = n[half].bitwiseXOR(a[half])
        return (first <= 0) | (F.call_function("shiftrightunsigned", apart, F.lit(64) - F.least(first, F.lit(64))) == 0)

    same = (n["family"] == a["family"]) & alike("hi", n["bits"]) & alike("lo", n["bits"] - 64)
    return F.when(n.isNotNull() & a.isNotNull(), same)


def with_inside(df: DataFrame, name: str, cidr: str, ip: str) -> DataFrame:
    """Add one containment column."""
    facts = df.withColumns({**network_facts(F.col(cidr)), **address_facts(F.col(ip))})
    return facts.withColumn(name, inside()).drop("_net_ok", "_net_at", "_ip_ok", "_ip_at")


def mac_colons(mac: Column) -> Column:
    return F.translate(F.lower(mac), "-", ":")


def is_hostname(name: Column) -> Column:
    """Labels between dots: letters, digits and hyphens, no hyphen at either end, 63 characters at most."""
    def label(x: Column) -> Column:
        return (F.length(x).between(1, _LABEL_LENGTH) & ~x.rlike(f"[^{_LABEL_LETTERS}]") & ~x.startswith("-") & ~x.endswith("-"))

    return F.coalesce(F.forall(F.split(name, r"\."), label), F.lit(False))
