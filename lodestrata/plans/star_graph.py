"""A property graph over the star schema's tables, so that graph operators run on relational data of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids are the table's key plus an offset, wide apart.
OFFSETS = {"region": 0, "nation": 1_000, "supplier": 10**12, "customer": 2 * 10**12, "part": 3 * 10**12, "orders": 4 * 10**12}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, kind: str, label: str, key: str, name: str) -> DataFrame:
    return df.select(
        (F.col(key).cast("long") + OFFSETS[kind]).alias("id"), F.lit(label).alias("label"), F.col(name).cast("string").alias("name"),
        F.concat(F.lit(f"star::{kind}::"), F.col(name).cast("string")).alias("qualified_name"), F.lit(f"{kind}/rows.py").alias("file_path"),
    )


def nodes(spark: SparkSession, sf_dir: str, orders: bool = False) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    out = _node(t("region"), "region", "Folder", "r_regionkey", "r_name")
    out = out.unionByName(_node(t("nation"), "nation", "File", "n_nationkey", "n_name"))
    out = out.unionByName(_node(t("supplier"), "supplier", "Class", "s_suppkey", "s_name"))
    out = out.unionByName(_node(t("customer"), "customer", "Function", "c_custkey", "c_name"))
    out = out.unionByName(_node(t("part"), "part", "Method", "p_partkey", "p_name"))
    return out.unionByName(_node(t("orders"), "orders", "Variable", "o_orderkey", "o_orderkey")) if orders else out


def _edge(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str], order: str) -> DataFrame:
    return df.select(
        (F.col(source[1]).cast("long") + OFFSETS[source[0]]).alias("source_id"), (F.col(target[1]).cast("long") + OFFSETS[target[0]]).alias("target_id"),
        F.lit(kind).alias("edge_type"), F.lit(None).cast("double").alias("confidence"), F.col(order).cast("long").alias("ord"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer, supplier; customer -> order; supplier -> part with the dearest discount as confidence."""
    t = lambda name: table(spark, sf_dir, name)
    out = _edge(t("nation"), "CONTAINS_FOLDER", ("region", "n_regionkey"), ("nation", "n_nationkey"), "n_nationkey")
    out = out.unionByName(_edge(t("customer"), "CONTAINS_FILE", ("nation", "c_nationkey"), ("customer", "c_custkey"), "c_custkey"))
    out = out.unionByName(_edge(t("supplier"), "CONTAINS_FILE", ("nation", "s_nationkey"), ("supplier", "s_suppkey"), "s_suppkey"))
    out = out.unionByName(_edge(t("orders"), "HANDLES", ("customer", "o_custkey"), ("orders", "o_orderkey"), "o_orderkey"))
    sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_discount").alias("d"), F.min("l_orderkey").alias("o"))
    calls = sold.select(
        (F.col("l_suppkey") + OFFSETS["supplier"]).alias("source_id"), (F.col("l_partkey") + OFFSETS["part"]).alias("target_id"),
        F.lit("CALLS").alias("edge_type"), (F.col("d") * 10).alias("confidence"), F.col("o").alias("ord"),
    )
    return out.unionByName(calls)


def _node_sql(kind: str, label: str, key: str, name: str) -> str:
    return f"SELECT {key}::BIGINT + {OFFSETS[kind]} AS id, '{label}' AS label, {name}::VARCHAR AS name, 'star::{kind}::' || {name} AS qualified_name, '{kind}/rows.py' AS file_path FROM {kind}"


NODES_SQL = " UNION ALL ".join(
    _node_sql(*x)
    for x in (
        ("region", "Folder", "r_regionkey", "r_name"), ("nation", "File", "n_nationkey", "n_name"), ("supplier", "Class", "s_suppkey", "s_name"),
        ("customer", "Function", "c_custkey", "c_name"), ("part", "Method", "p_partkey", "p_name"),
    )
)
EDGES_SQL = f"""
SELECT n_regionkey::BIGINT + {OFFSETS['region']} AS source_id, n_nationkey::BIGINT + {OFFSETS['nation']} AS target_id, 'CONTAINS_FOLDER' AS edge_type, NULL::DOUBLE AS confidence, n_nationkey::BIGINT AS ord FROM nation
UNION ALL SELECT c_nationkey::BIGINT + {OFFSETS['nation']}, c_custkey + {OFFSETS['customer']}, 'CONTAINS_FILE', NULL, c_custkey FROM customer
UNION ALL SELECT s_nationkey::BIGINT + {OFFSETS['nation']}, s_suppkey + {OFFSETS['supplier']}, 'CONTAINS_FILE', NULL, s_suppkey FROM supplier
UNION ALL SELECT o_custkey + {OFFSETS['customer']}, o_orderkey + {OFFSETS['orders']}, 'HANDLES', NULL, o_orderkey FROM orders
UNION ALL SELECT l_suppkey + {OFFSETS['supplier']}, l_partkey + {OFFSETS['part']}, 'CALLS', max(l_discount) * 10, min(l_orderkey) FROM lineitem GROUP BY l_suppkey, l_partkey
"""
