"""Pseudonyms: a keyed hash of the account id, computed by built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def account_reference(column: str, salt: str) -> Column:
    """'REF-' and the first 20 hex digits of HMAC-SHA256(salt, id). The salt stands in the plan: keep plans private."""
    if len(salt) < 16:
        raise ValueError("identifier_salt must contain at least 16 characters")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.col(column).cast("string").cast("binary")), 256))
    return F.concat(F.lit("REF-"), F.substring(F.sha2(F.concat(outer, first), 256), 1, 20))
