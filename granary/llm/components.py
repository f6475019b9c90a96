"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stored

#: A node with more than this share of all edges is a hub. Ends of edges are twice as many as edges, so there are at most
#: twice 1 / HUB_SHARE hubs, whatever the number of edges.
HUB_SHARE = 1 / 2000


def _with_least(rows: DataFrame, least: DataFrame, most: float) -> DataFrame:
    """rows (u, v) with the m of their u in least (u, m, n). Hubs, of which there are few by arithmetic, are broadcast; so no key of the
    join by shuffle has over `most` rows."""
    hubs = least.where(F.col("n") > most).select("u", F.col("m").alias("hub_m"))
    marked = rows.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("hub_m is null").select("u", "v").join(least.where(F.col("n") <= most).select("u", "m"), "u")
    return marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m")).union(rest)


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node of edges (a, b); loops and repeated edges do no harm, and no
    edges give no rows.

    Each round writes its edges and each node's least neighbour to the shared folder; there are about as many rounds as the
    logarithm of a component's width, and it goes on until a round changes nothing. A node of many edges is only ever
    aggregated with partial sums or met by a broadcast.
    """
    with scratch(edges.sparkSession):
        now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        nodes = now.select("u").union(now.select("v")).distinct()
        state, last = _state(now), None
        while state[0] and state != last:
            most = max(1.0, HUB_SHARE * state[0])
            # Large star: every greater neighbour of a node is put below the node's least neighbour.
            both = now.union(now.select("v", "u").toDF("u", "v"))
            least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
            large = stored(_with_least(both.where("v > u"), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            # Small star: a node and its lesser neighbours are put below the least of them.
            least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
            small = _with_least(large, least, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = stored(small.union(least.select("u", "m")).distinct(), "edges")
            state, last = _state(now), state
        return stored(nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("label")), "components", keep=True)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
