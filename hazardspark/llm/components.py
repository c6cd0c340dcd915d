"""Connected components of a link table, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardspark.llm.common import materialize

#: A node with more links than HUB, and than a part of 1 / HUBS of all, is met in SALTS tasks.
HUB, HUBS, SALTS = 100_000, 200, 64


def connected(links: DataFrame) -> DataFrame:
    """node and label (the smallest node of its component) of each node in ``links`` (a, b).

    Each turn takes the least label among neighbours, then the label of the label; the
    aggregations combine before the shuffle. Labels are joined to links by the far end:
    the links of a hub are dealt over ``SALTS`` tasks, each with a copy of its label (there
    are at most ``HUBS`` hubs). The turns are written to the shared folder, which cuts
    the lineage.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    degree = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("n"))
    degree = materialize(degree.select("node", F.least("node", "m").alias("label"), "n"), "labels")
    labels = degree.select("node", "label")
    total = degree.agg(F.sum("n")).first()[0] or 0
    hubs = [r.node for r in degree.where(F.col("n") > max(HUB, total // HUBS)).select("node").collect()]  # at most HUBS
    hub = lambda node: F.col(node).isin(hubs) if hubs else F.lit(False)
    dealt = edges.withColumn("salt", F.when(hub("b"), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    while True:
        salted = labels.select(F.col("node").alias("b"), "label", F.explode(F.when(hub("node"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
        near = dealt.join(salted, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        next_ = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        next_ = materialize(next_.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = next_.select("node", "label")
        if next_.where("old <> label").isEmpty():
            return labels
