"""Digests and keyed fingerprints from built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def _pads(key: bytes) -> tuple[bytes, bytes]:
    if len(key) > BLOCK:
        key = hashlib.sha256(key).digest()
    padded = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a text; the key is always the caller's."""
    inner_pad, outer_pad = _pads(key)
    inner = F.unhex(F.sha2(F.concat(F.lit(inner_pad), F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(F.lit(outer_pad), inner), 256)


def hmac_sha256_sql(text: str, key: bytes) -> str:
    """The same fingerprint as a SQL expression for result checks."""
    inner_pad, outer_pad = _pads(key)
    inner = f"unhex(sha256(unhex('{inner_pad.hex()}') || encode({text})))"
    return f"sha256(unhex('{outer_pad.hex()}') || {inner})"


def bucket(token: Column, dims: int) -> Column:
    """First 32 bits of the md5 digest, modulo the number of dimensions."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dims).cast("int")
