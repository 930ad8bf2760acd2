"""Connected components: tasks unite the edges they hold, rounds of random contraction the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.blocks import lean
from sessionlake.llm.common import arrow_type
from sessionlake.session import freeze

#: Edges that one task unites.
TASK = 250_000


def _unite(kind: pa.DataType, loops: bool, task: int) -> Callable:
    """Every node of a task's edges with the smallest node that these connect it with."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: dict = {}

        def root(i):
            while (up := lead.setdefault(i, i)) != i:
                lead[i] = i = lead[up]
            return i

        def stars() -> pa.RecordBatch:
            found = [(i, root(i)) for i in lead]
            found = [f for f in found if loops or f[0] != f[1]]
            lead.clear()
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k in (0, 1)], ["node", "top"])

        for batch in source:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    lead[max(x, y)] = min(x, y)
            # Bounds the memory; the edges of so few tasks as fit one never get here.
            if len(lead) > 2 * task:
                yield stars()
        if lead:
            yield stars()

    return batches


def components(edges: DataFrame, task: int = TASK) -> DataFrame:
    """``node`` and ``component``, the smallest node it is connected with, for all nodes with an edge to another.

    ``edges`` has two columns of one type that can be ordered. Tasks first replace the edges they
    hold by stars, fewer than the nodes. While over ``task`` edges are left, every node is merged
    into whichever of itself and its neighbours has the smallest hash, with a new salt each round.
    That takes away a third of the nodes or more, as expected, in any graph, so long chains need
    few rounds, each smaller than the last. Minima combine before the shuffle; a node with very
    many edges is a key of joins only, which Spark splits. What is left in the end fits one task.
    Nodes and labels do not pass through the driver.
    """
    a, b = edges.columns
    kind = arrow_type(edges, a)
    form = f"node {edges.schema[a].dataType.simpleString()}, top {edges.schema[a].dataType.simpleString()}"

    def united(pairs: DataFrame, loops: bool = False) -> DataFrame:
        return freeze(pairs.mapInArrow(lean(_unite(kind, loops, task)), form))

    left = united(edges.select(F.col(a).alias("node"), F.col(b).alias("top")).where("node <> top"))
    merged = []
    while left.count() > task:
        salt = F.lit(len(merged))

        def drawn(node: str):
            return F.struct(F.xxhash64(salt, node).alias("hash"), F.col(node).alias("top"))

        both = left.unionByName(left.select(F.col("top").alias("node"), F.col("node").alias("top")))
        near = both.groupBy("node").agg(F.min(drawn("top")).alias("near"))
        merged.append(freeze(near.select("node", F.least("near", drawn("node"))["top"].alias("top"))))
        into = merged[-1]
        left = united(
            left.join(into.select("node", F.col("top").alias("x")), "node")
            .join(into.select(F.col("node").alias("top"), F.col("top").alias("y")), "top")
            .select(F.col("x").alias("node"), F.col("y").alias("top"))
            .where("node <> top")
        )
    labels = united(left.coalesce(1), loops=True)
    for into in reversed(merged):
        end = labels.select(F.col("node").alias("top"), F.col("top").alias("end"))
        labels = freeze(into.join(end, "top", "left").select("node", F.coalesce("end", "top").alias("top")))
    if merged:
        smallest = labels.groupBy("top").agg(F.min("node").alias("component"))
        return freeze(labels.join(smallest, "top").select("node", "component"))
    return labels.withColumnRenamed("top", "component")
