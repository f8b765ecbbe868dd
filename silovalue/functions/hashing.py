"""Seeded hashing of row ids: reproducible splits, folds and shuffles without a random stream."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TEST_SHARE = 0.3


def row_hash(seed: int, *ids: str | Column) -> Column:
    """Hex md5 of ``seed:id[:id…]``; the same string on every engine."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_below(seed: int, share: float, *ids: str | Column) -> Column:
    """True for about ``share`` of the rows, decided per row id."""
    return row_hash(seed, *ids) < F.lit(f"{int(share * 16**8):08x}")


def fold(seed: int, k: int, *ids: str | Column) -> Column:
    """Cross-fitting fold 0 … k-1 from the leading hash digits."""
    return F.conv(F.substring(row_hash(seed, *ids), 1, 8), 16, 10).cast("bigint") % k
