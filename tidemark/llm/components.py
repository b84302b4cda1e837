"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of ``edges`` (u, v: long).

    Each round takes the least label among neighbours, then the label of the label, and hooks the
    node's former label to it too, so whole trees move at once and long chains shrink by a factor a
    round, whatever their numbering. Ends when nothing moves, after any number of rounds. Labels are
    written out each round; only a count reaches the driver.
    """
    both = materialize(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(),
        "cc-edges", waves=2,
    )
    labels = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-0", waves=2)
    for k in count(1):
        far = labels.select(F.col("node").alias("v"), F.col("label").alias("near"))
        least = both.join(far.hint("merge"), "v").groupBy("u").agg(F.min("near").alias("near"))
        hooked = (
            labels.join(least.withColumnRenamed("u", "node").hint("merge"), "node")
            .select("node", "label", F.least("label", "near").alias("next"))
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        new = F.least("next", "up")
        own = F.struct("node", new.alias("label"), F.col("label").alias("old"))
        root = F.struct(F.col("label").alias("node"), new.alias("label"), F.lit(None).cast("long").alias("old"))
        step = hooked.join(jump.hint("merge"), "next").select(F.explode(F.array(own, root)).alias("e")).groupBy("e.node")
        step = step.agg(F.min("e.label").alias("label"), F.max("e.old").alias("old"))
        step = materialize(step.select("node", "label", (F.col("label") < F.col("old")).alias("moved")), f"cc-{k}", waves=2)
        discard(labels)
        labels = step.select("node", "label")
        if not step.where("moved").limit(1).count():
            return labels
