"""Repeatable pseudo-random numbers from MD5, identical on every engine that has MD5."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

HASH_RANGE = 2**32


def _as_column(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def digest(*parts) -> Column:
    """MD5 hex text of the parts joined by ``|``; str, int or Column parts."""
    return F.md5(F.concat_ws("|", *[_as_column(p).cast("string") for p in parts]))


def hash_int(*parts) -> Column:
    """Integer in [0, 2**32) from the first eight hex digits."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Double in [0, 1)."""
    return hash_int(*parts) / F.lit(float(HASH_RANGE))


def local_hash_int(*parts) -> int:
    """The same number on the driver, for choices about features or trees (never about rows)."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
