"""Digests and block ciphers over byte columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGESTS = (256, 384, 512)


def range_digest(data: Column, ranges: Sequence[tuple[Column, Column]], bits: int = 256) -> Column:
    """Hexadecimal digest over the (start, length) ranges of ``data``, one behind another."""
    if bits not in DIGESTS:
        raise ValueError(f"no digest of {bits} bits")
    return F.sha2(F.concat(*[F.substring(data, start + 1, length) for start, length in ranges]), bits)


def decrypt_cbc(data: Column, key: Column) -> Column:
    """Chained blocks behind a 16-byte start vector, padding removed; null if they are malformed."""
    return F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def decrypt_ecb(data: Column, key: Column) -> Column:
    return F.try_aes_decrypt(data, key, F.lit("ECB"), F.lit("PKCS"))
