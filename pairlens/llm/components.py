"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: Parts of the rows whose label is one and the same.
SALTS = 16


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each node's component; edges has the columns a and b.

    Each round takes the least label among the neighbours, then the label's own label, so chains
    shorten by more than half a round. A label that a large share of the nodes has is looked up in
    ``SALTS`` places. Tables between rounds lie in the shared folder.
    """
    both = settle(edges.select("a", "b").union(edges.select("b", "a")))
    # a node of a star has its hub's label after one round
    label = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    every = F.explode(F.array(*(F.lit(k) for k in range(SALTS)))).alias("at_salt")
    while True:
        seen = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        near = label.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        near = settle(near.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")))
        # only labels that have moved themselves lead further
        jump = near.filter("new <> node").select(F.col("node").alias("at"), F.col("new").alias("beyond"), every)
        step = near.join(jump, (F.col("new") == F.col("at")) & (F.col("salt") == F.col("at_salt")), "left")
        step = settle(step.select("node", "label", F.least("new", F.coalesce("beyond", "new")).alias("new")))
        moved = step.filter("label <> new").limit(1).count()
        label = step.select("node", F.col("new").alias("label"))
        if not moved:
            return label
