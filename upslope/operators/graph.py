"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upslope.scratch import drop_tables, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, component).

    Each round first lowers every node's label to the smallest label among its
    neighbours (an aggregation with map-side combine, so a hub costs one row per
    task) and then jumps to the label of that label, which halves long chains.
    Every round's labels are written to the shared folder, so a lost executor
    costs one round; the labels before are removed then.  Rows with a null end are ignored; self loops keep their
    node as its own component; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = materialize(e.union(e.select("b", "a")).distinct(), "cc-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    state = materialize(labels.select("node", F.least("node", "m").alias("component")), "cc-labels")
    for _ in range(max_rounds):
        labels = state.select("node", "component")
        near = (
            both.join(labels, both.b == labels.node)
            .groupBy("a")
            .agg(F.min("component").alias("m"))
        )
        lowered = labels.join(near, labels.node == near.a).select(
            "node", "component", F.least("component", "m").alias("low")
        )
        up = labels.select(F.col("node").alias("p"), F.col("component").alias("p_label"))
        jumped = lowered.join(up, lowered.low == up.p, "left").select(
            "node",
            F.least("low", F.coalesce("p_label", "low")).alias("component"),
            (F.least("low", F.coalesce("p_label", "low")) < F.col("component")).alias("moved"),
        )
        before, state = state, materialize(jumped, "cc-labels")
        drop_tables(before)
        if state.where("moved").limit(1).count() == 0:
            drop_tables(both)
            return state.select("node", "component")
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
