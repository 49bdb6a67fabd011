"""Connected components of an edge table by repeated contraction, entirely as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.workspace import Workspace


def connected_components(ws: Workspace, edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``, undirected, repeats and self-loops allowed; an empty
    table gives an empty result. Each round points every node at its smallest neighbour, follows
    those pointers to their ends by doubling, and keeps only edges between different ends. At least
    half of the nodes that still have edges vanish per round, and the pointers of a chain of any
    length collapse in logarithmically many joins. Hot nodes: minima combine before the shuffle,
    and the joins are inner or left joins against unique keys, which AQE can split.
    """
    current = ws.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{label}-edges0")
    labels: DataFrame | None = None
    round_no = 0
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        parents = ws.save(parents.select("node", F.least("node", "up").alias("up")), f"{label}-p{round_no}-0")
        jump = 0
        while True:
            above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = parents.join(above, "up").select("node", F.col("up").alias("old"), F.col("top").alias("up"))
            jump += 1
            saved = ws.save(jumped, f"{label}-p{round_no}-{jump}")
            moved = not saved.where("old <> up").isEmpty()
            ws.drop(f"{label}-p{round_no}-{jump - 1}")
            parents = saved.select("node", "up")
            if not moved:
                break
        ends = lambda column: parents.select(F.col("node").alias(column), F.col("up").alias(f"{column}_top"))
        kept = current.join(ends("a"), "a").join(ends("b"), "b").where("a_top <> b_top")
        kept = kept.select(F.greatest("a_top", "b_top").alias("a"), F.least("a_top", "b_top").alias("b")).distinct()
        current = ws.save(kept, f"{label}-edges{round_no + 1}")
        if labels is None:
            composed = parents.select("node", F.col("up").alias("component"))
        else:
            tops = parents.select(F.col("node").alias("component"), "up")
            composed = labels.join(tops, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        labels = ws.save(composed, f"{label}-labels{round_no}")
        ws.drop(f"{label}-edges{round_no}", f"{label}-p{round_no}-{jump}", *([f"{label}-labels{round_no - 1}"] if round_no else []))
        round_no += 1
    return labels if labels is not None else current.select(F.col("a").alias("node"), F.col("b").alias("component"))
