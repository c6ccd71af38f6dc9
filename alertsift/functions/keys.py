"""Column expressions for labels, protocols, addresses and the direction-free flow key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def label_of(source_file: Column) -> Column:
    """Class label from a capture name: benign prefix, then the ordered substring rules."""
    out = F.when(source_file.startswith(S.BENIGN_PREFIX), S.BENIGN)
    for text, label in S.LABEL_RULES:
        out = out.when(source_file.contains(text), label)
    return out.otherwise(S.UNKNOWN_ATTACK)


def is_attack(label: Column) -> Column:
    return (label != S.BENIGN).cast("int")


def number(col: Column) -> Column:
    """Numeric value of any column; text that is no number becomes null."""
    return col.try_cast("double")


def protocol_of(tcp: Column, udp: Column) -> Column:
    """IANA number from the two transport flags: 6, else 17, else 0."""
    return F.when(number(tcp) == 1, 6).when(number(udp) == 1, 17).otherwise(0)


def protocol_of_flags(tcp: Column, udp: Column, icmp_type: Column | None = None) -> Column:
    """Variant in which a later positive flag wins: tcp < udp < icmp; null if none is set."""
    out = F.lit(None).cast("int")
    out = F.when(number(tcp) > 0, 6).otherwise(out)
    out = F.when(number(udp) > 0, 17).otherwise(out)
    if icmp_type is not None:
        out = F.when(icmp_type.isNotNull(), 1).otherwise(out)
    return out


def missing_address(ip: Column) -> Column:
    return ip.isNull() | (ip == "") | (ip == "nan")


def positive_port(port: Column) -> Column:
    return F.coalesce(number(port), F.lit(0.0)) > 0


def invalid_reason(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """Why an address pair has no key, in order of precedence; null for a valid one."""
    return (
        F.when(missing_address(src_ip) | missing_address(dst_ip), "missing_endpoint")
        .when(~positive_port(src_port) | ~positive_port(dst_port), "zero_port")
        .when(~F.coalesce(protocol.isin(6, 17), F.lit(False)), "unsupported_protocol")
    )


def canonical_key(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """``lo||hi||protocol`` with the two ``ip:port`` ends sorted as text; null when invalid."""
    a = F.concat_ws(":", src_ip, number(src_port).cast("long").cast("string"))
    b = F.concat_ws(":", dst_ip, number(dst_port).cast("long").cast("string"))
    key = F.concat_ws("||", F.least(a, b), F.greatest(a, b), number(protocol).cast("long").cast("string"))
    return F.when(invalid_reason(src_ip, src_port, dst_ip, dst_port, protocol).isNull(), key)


def hash_order(key: Column, seed: int = S.SEED) -> Column:
    """Reproducible random order: md5 of seed and row key, as hexadecimal text."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
