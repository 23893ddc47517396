"""Signature headers: ``t=<epoch seconds>,v1=<hex HMAC-SHA256 of "<t>." and the body>``."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hmac(message: Column, secret: str) -> Column:
    """HMAC-SHA256 as hex: two nested hashes over pads of the key."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signature_status(header: Column, body: Column, received_at: Column, secrets: Sequence[str], tolerance_seconds: int = 300) -> Column:
    """ok, missing_header, malformed, out_of_range or no_match.

    Every comma-separated part must have an equals sign and exactly one `t` must be an integer. v1 values that
    are no hex are skipped; without any other the header is malformed. The time may differ by the
    tolerance either way. One v1 that fits one secret is enough. The body is binary, as received.
    """
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.substring(p, F.instr(p, "=") + 1, 1 << 20)

    def judge(parts: Column) -> Column:
        times = F.transform(F.filter(parts, lambda p: key(p) == "t"), value)
        signatures = F.filter(F.transform(F.filter(parts, lambda p: key(p) == "v1"), lambda p: F.lower(value(p))), lambda s: F.rlike(s, F.lit("^([0-9a-f]{2})*$")))
        first = F.get(times, F.lit(0))
        time = F.when((F.size(times) == 1) & F.rlike(first, F.lit(r"^[+-]?[0-9]+$")), first).try_cast("long")
        well = ~F.exists(parts, lambda p: F.instr(p, "=") == 0)
        return _let(F.struct(F.when(well, time).alias("time"), signatures.alias("v1")), fits)

    def fits(read: Column) -> Column:
        time, signatures = read["time"], read["v1"]
        message = F.concat(F.encode(F.concat(time.cast("string"), F.lit(".")), "utf-8"), body)
        known = F.lit(False)
        for secret in filter(None, secrets):
            known = known | F.array_contains(signatures, _hmac(message, secret))
        # Whole microseconds: a part of a second beyond the tolerance is out of range too.
        off = F.abs(F.unix_micros(received_at) - time * 1_000_000) > tolerance_seconds * 1_000_000
        return (
            F.when(time.isNull() | (F.size(signatures) == 0), "malformed")
            .when(F.coalesce(off, F.lit(True)), "out_of_range")
            .when(F.coalesce(known, F.lit(False)), "ok")
            .otherwise("no_match")
        )

    return F.when(F.coalesce(header, F.lit("")) == "", "missing_header").otherwise(_let(F.transform(F.split(header, ","), lambda p: F.trim(p)), judge))
