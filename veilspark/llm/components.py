"""Connected components of a table of links, by alternating stars.

Each round is a few shuffles of the links and halves the depth of what is left, so
the number of rounds grows with the logarithm of the longest chain. Nothing is
collected: a node with very many neighbours is only ever reduced by ``min``, which
counts in each task first, and joined back to its own links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) with a > b, after one large-star and one small-star step."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    large = (
        both.join(least, "a")
        .filter("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter("a > b")
        .distinct()
    )
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), "m")
    small = least.select("a", "m").union(hung)
    return small.select("a", F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; roots are the smallest nodes.

    ``links`` has columns a and b of one orderable type. Nulls and loops are left
    out, repeated links count once, and an empty table has no components.
    """
    links = links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    links = stored(links.distinct(), "links")
    digest = F.struct(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    )
    state = links.agg(digest).first()
    while True:
        links = stored(_stars(links), "links")
        now = links.agg(digest).first()
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        roots.select("node", F.col("node").alias("root"))
    )
