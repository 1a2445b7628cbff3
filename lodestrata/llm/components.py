"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import shared_dir, written


def _stars(links: DataFrame) -> DataFrame:
    """links (node, peer), both ways round, to (node, peer, least): least of the node and all its peers."""
    least = links.groupBy("node").agg(F.min("peer").alias("least"))
    return links.join(least, "node").select("node", "peer", F.least("node", "least").alias("least"))


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "peer"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids to (node, component) for every node that has an edge: the least id reachable.

    Each round halves the distance to a star at least, so rounds grow with the logarithm of the longest path, and
    is written to the shared folder, in as many files as its links need. Aggregation combines on the map side, and
    AQE splits the join of a node with very many peers.
    """
    folder, turn, mark = shared_dir(edges.sparkSession), 0, None
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("peer")).distinct()
    links = written(links, folder, "links0", edges.count())
    while mark != (new := _mark(links)):
        mark, turn = new, turn + 1
        both = links.union(links.select("peer", "node"))
        large = _stars(both).filter("peer > node").select(F.col("peer").alias("node"), F.col("least").alias("peer")).distinct()
        small = _stars(large).select(F.explode(F.array("node", "peer")).alias("node"), F.col("least").alias("peer")).filter("node <> peer").distinct()
        links = written(small, folder, f"links{turn}", mark[0])
    roots = links.select(F.col("peer").alias("node")).distinct()
    found = links.groupBy("node").agg(F.min("peer").alias("component")).union(roots.join(links.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
    return written(found, folder, "components", 2 * mark[0])
