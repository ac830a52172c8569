"""Connected components of links between rows."""
from pyspark.sql import DataFrame, functions as F

from caseloom.llm.tables import narrow, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of `links` (a, b); nodes share a root if and only if links connect them.

    Each round every node points to the least of itself and its neighbours, by a hash, and links are redrawn
    between the nodes pointed to, until none is left; a round keeps a third of the nodes or so. Each
    round is a written table. Nothing is collected; a node with very many links only meets partial sums.
    Links of a node to itself, null ends and repeated links change nothing."""
    links = written(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    steps: list[DataFrame] = []
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        least = ends.groupBy("node").agg(F.min(F.struct(F.xxhash64("other"), F.col("other").alias("to"))).alias("least"))
        own = F.struct(F.xxhash64("node"), F.col("node").alias("to"))
        step = written(least.select("node", F.least("least", own)["to"].alias("to")))
        steps.append(step)
        side = lambda end: narrow(step.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")))
        moved = links.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        links = written(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    at = steps[0].select("node", F.col("to").alias("root"))
    for step in steps[1:]:
        later = narrow(step.select(F.col("node").alias("root"), "to"))
        at = at.join(later, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return written(at)
