"""Connected components of a graph of links, by star contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake.llm.common import written


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one parent at most and no parent has a parent."""
    child, parent = F.lit(1).alias("child"), F.lit(0).alias("child")
    roles = edges.select(F.col("a").alias("node"), child).unionAll(
        edges.select(F.col("b").alias("node"), parent)
    )
    bad = roles.groupBy("node").agg(F.sum("child").alias("up"), F.min("child").alias("only_up"))
    return bad.where("up > 1 OR (up = 1 AND only_up = 0)").agg(F.count("*")).first()[0] == 0


def connected(links: DataFrame) -> DataFrame:
    """The smallest node that each linked node can reach: ``node``, ``component``.

    ``links`` has two node columns, in any direction, repeated or not. Rounds
    alternate two steps until the graph is a set of stars: each node's larger
    neighbours move to its smallest neighbour, then its smaller ones do. No
    step gathers a node's neighbours, so a hub may have any number; each round
    is a table in the shared folder. Nodes without a link are not in the result.
    """
    a, b = (F.col(c) for c in links.columns)
    edges = written(
        links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "links",
    )
    while not _is_stars(edges):
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(low, "b").select("a", F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .where("b != m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b")))
        )
        edges = written(small.distinct(), "links")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
