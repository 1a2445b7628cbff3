"""What the operators share: the cluster's shared folder, Arrow batches and joins that stand hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.sources.workspace import ROWS_A_FILE, map_rows, shared_dir, written

__all__ = ["ROWS_A_FILE", "hot_split_join", "hot_spread_join", "map_rows", "shared_dir", "written"]

#: A key counts as hot when it has over one in HOT_SHARE of all rows; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000


def hot_split_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """left joined to right, where right has one row a key and weight counts the key's rows in left.

    Keys with over 1/HOT_SHARE of all rows, at most HOT_SHARE by that definition, are joined by broadcast
    and never meet in one task; all others are shuffled. left and right are read twice: pass written tables.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot = right.filter(is_hot)
    cold_left = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold_left.join(right.filter(~is_hot), key, how))


def hot_spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, spread: list[str]) -> DataFrame:
    """left with the columns of right's row of the same key, like hot_split_join, but reads left once.

    key is binary. Rows of hot keys get right's row by broadcast; in the shuffle that serves the others they are dealt
    by the columns spread, under a key of eight bytes, which no digest is.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    told = F.struct(*[c for c in right.columns if c != key])
    hot, cold = right.filter(is_hot).select(key, told.alias("__hot")), right.filter(~is_hot).select(F.col(key).alias("__key"), told.alias("__cold"))
    at = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.unhex(F.hex(F.xxhash64(*spread))))
    marked = left.join(F.broadcast(hot), key, "left").withColumn("__at", at)
    joined = marked.join(cold.hint("shuffle_hash"), F.col("__at") == F.col("__key"), "left")
    return joined.select(*left.columns, F.coalesce("__hot", "__cold").alias("__told")).select(*left.columns, "__told.*")
