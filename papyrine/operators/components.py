"""Connected components of a bipartite membership graph.

Input rows (node, key) say that a node carries a key; nodes that share a key belong
together.  Links are never expanded into pairs: a key with n members costs n rows, so a
key that holds a third of all rows costs no more than any other third of the input.

Each round computes the smallest label per key (a map-side combined ``min``), hands it back
to the members and takes the smallest label per node; then labels jump to the label of
their label, which halves the remaining depth.  Rounds stop when no label changed.  Every
round is written to the shared checkpoint folder, so lost executors cost one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut


def components(membership: DataFrame, node: str = "node", key: str = "key", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable over shared keys.

    Rows with a null node or key are ignored.  Repeated rows change nothing.  An empty input
    gives an empty result.
    """
    m = membership.select(F.col(node).alias("node"), F.col(key).alias("key")).where("node is not null and key is not null").distinct()
    m = cut(m)
    labels = cut(m.groupBy("node").agg(F.min("node").alias("component")))
    for _ in range(max_rounds):
        per_key = m.join(labels, "node").groupBy("key").agg(F.min("component").alias("best"))
        offered = m.join(per_key, "key").groupBy("node").agg(F.min("best").alias("best"))
        hooked = labels.join(offered, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "best").alias("component"))
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = hooked.join(roots, "component", "left").select("node", "old", F.least("component", F.coalesce("root", "component")).alias("component"))
        jumped = cut(jumped)
        changed = jumped.where("component <> old").limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
