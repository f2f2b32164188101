"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relweave.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, comp)`` for every node of ``links`` (``a, b``): the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the label of that label,
    so chains halve from round to round. Labels live in a written table; a group of any size is
    only ever reduced by partial minimums.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = scratch.save(both)
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("comp", "near").alias("up"), F.col("comp").alias("old"))
        over = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = scratch.save(step.join(over, step.up == over.via, "left").select("node", F.least("up", F.coalesce("far", "up")).alias("comp"), "old"))
        changed = new.filter("comp <> old").limit(1).count()
        scratch.delete(labels)
        labels = new.select("node", "comp")
        labels.scratch_path = new.scratch_path
        if not changed:
            scratch.delete(both)
            return labels
