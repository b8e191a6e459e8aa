"""Helpers for keys that hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1 / HOT_SHARE of all rows; at most HOT_SHARE keys can be, which bounds what is broadcast (16 MB of
#: 64-byte keys). At 10^12 rows a key that is not hot brings at most 4 million rows to one task.
HOT_SHARE = 262_144
#: Keys with fewer rows than this never count as hot.
HOT_LEAST = 50_000


def hot_threshold(rows: int, share: int = HOT_SHARE, least: int = HOT_LEAST) -> int:
    return max(least, rows // share)


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows to a table that is unique on ``keys``; rows of hot keys meet a broadcast part.

    ``hot`` holds the hot keys, at most HOT_SHARE rows (see hot_threshold), so both broadcasts are bounded.
    ``how`` is inner or left. Null keys match nothing.
    """
    hot = F.broadcast(hot.select(*keys).distinct())
    hot_rows = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    cold = left.join(hot, keys, "left_anti").join(right.join(hot, keys, "left_anti"), keys, how)
    return hot_rows.unionByName(cold)


def salt(c: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(parts))
