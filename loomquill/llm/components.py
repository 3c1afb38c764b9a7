"""Connected components of an edge table, by contraction.

What is left of the edges is counted in every round; once they are few enough for
one task's memory, a bound that does not depend on the data, one task finishes.

Each round ties every node to its smallest neighbour, follows these ties to
their ends, and puts the ends in the place of the edges' nodes, so edges inside
what has been joined go.  A round reads only the edges that are left, and none of
a component that is whole, however large it is.  Every round is checkpointed to
the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import shared_checkpoint

#: Edges that one task may hold: some 60 MB.
FEW = 200_000


def _finished(edges: DataFrame) -> DataFrame:
    """``node, label`` of at most `FEW` edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
                if a != b:
                    root[max(a, b)] = min(a, b)
        nodes = list(root)
        kind = schema.field(0).type
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([find(x) for x in part], kind)], names=["node", "label"])

    kind = edges.schema["a"].dataType.simpleString()
    schema = pa.schema([("a", pa.int64() if kind == "bigint" else pa.binary() if kind == "binary" else pa.string())])
    return edges.coalesce(1).mapInArrow(run, f"node {kind}, label {kind}")


def _ends(parents: DataFrame) -> DataFrame:
    """``node, label`` of ``node, label`` with every label replaced by the last one that its own labels lead to.

    Labels that lead nowhere further are left out of the joined side, so the
    commonest ones meet nothing.
    """
    while True:
        jump = parents.filter("node <> label").select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        moved = shared_checkpoint(parents.join(jump, "label", "left").select("node", F.coalesce("beyond", "label").alias("label"), F.col("beyond").isNotNull().alias("moved")))
        parents = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return parents


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node, label`` for every node of ``edges`` (``a``, ``b``): the label is the component's smallest node.

    Self-loops, repeated and null edges do no harm (null ends are dropped); an
    empty table gives an empty result.
    """
    left = shared_checkpoint(edges.select("a", "b").filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not left.isEmpty():
        if left.count() <= few:
            rounds.append(shared_checkpoint(_finished(left)))
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
        ends = _ends(shared_checkpoint(parents))
        rounds.append(ends)
        of = lambda name: ends.select(F.col("node").alias(name), F.col("label").alias(f"{name}_end"))  # noqa: E731, B023
        left = left.join(of("a"), "a").join(of("b"), "b").filter("a_end <> b_end")
        left = shared_checkpoint(left.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct())
    # Nodes of one round are the ends of the one before: labels are followed through the rounds.
    out = rounds[0]
    for later in rounds[1:]:
        out = out.join(later.select(F.col("node").alias("label"), F.col("label").alias("last")), "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return out
