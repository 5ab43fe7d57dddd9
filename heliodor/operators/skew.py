"""Joins whose keys may be very unequal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are treated as hot are at most this many, as each has more than total / HOT rows.
HOT = 50_000


def hot_size(total: int) -> int:
    """The number of rows from which a key is hot: at most HOT keys of a table with `total` rows have more."""
    return max(HOT, total // HOT)


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """`rows` joined with `classes`, which has one row for each key and in `count` the number of its rows.

    The rows of a hot key stay where they are, as its class is broadcast: HOT rows at most, whatever the table's size. All others are
    joined by a shuffle, in which no key has more than total / HOT rows. Null keys match nothing; `count` is dropped.
    """
    many = F.col(count) > hot_size(total)
    hot = F.broadcast(classes.where(many).drop(count))
    rest = rows.join(F.broadcast(classes.where(many).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(classes.where(~many).drop(count), keys))
