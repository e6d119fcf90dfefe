"""Connected components of a graph given as edges, by least labels and pointer jumping.

Defined results: an edge of a node to itself, an edge with a null end, and repeated edges change nothing; no edges give no
nodes; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the ends of ``edges`` (u, v); the label is the least node of the component.

    Each round every node takes the least label among its neighbours' and then its label's label; the rounds are few
    because chains halve.  What is shuffled is proportional to the edges, and hubs only gather a least value.
    """
    both = edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct()
    both = checkpointed(both)
    labels = checkpointed(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("offer"))
        # Kept before the second join, so that both its sides are plain tables and Spark can split the rows of a label that has many nodes.
        lower = checkpointed(labels.join(offered, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label")))
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = lower.join(jump, "label", "left_outer").select("node", "old", F.least("label", "further").alias("label"))
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return checkpointed(labels)
