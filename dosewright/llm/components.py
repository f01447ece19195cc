"""Connected components of a written edge table, without a task that holds a hub's edges.

An edge (a, b) points from the larger node to the smaller. A round has two steps:

1. Contraction. Each task joins the edges it has by union-find and gives one star for each part: every node
   once, pointing at the part's least. Done before the shuffle, it bounds the edges of one node by the number
   of tasks; done after a shuffle by a, all edges of a node have met, so each is left with one parent (``own``).
2. Jump. Edges are joined with the parents of their smaller ends and point there instead. Both sides of the
   join are plain scans, so Spark can split the partition of a node that many others point at.

Nodes only ever point at smaller ones and what is connected stays so. The rounds end when the contraction
finds no new edge and no edge jumps: stars are left. Their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import dropped, written

EDGES = "a long, b long"
STARS = "a long, b long, own boolean, new boolean"


def _forest(batches: Iterator[pa.RecordBatch], held: int, marked: bool) -> Iterator[pa.RecordBatch]:
    """The stars of the edges of ``batches``; ``held`` edges are joined at a time, never parting those of one a."""
    root: dict[int, int] = {}
    given: set[tuple[int, int]] = set()

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root[x]
        return top

    def stars() -> pa.RecordBatch:
        own = [(x, find(x)) for x in list(root)]
        columns = [pa.array([x for x, _ in own], pa.int64()), pa.array([y for _, y in own], pa.int64())]
        names = ["a", "b"]
        if marked:
            keys = {x for x, _ in given}
            columns += [pa.array([x in keys for x, _ in own], pa.bool_()), pa.array([e not in given for e in own], pa.bool_())]
            names += ["own", "new"]
        return pa.RecordBatch.from_arrays(columns, names)

    last = None
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(root) >= held and a != last:
                yield stars()
                root.clear()
                given.clear()
            last = a
            if marked:
                given.add((a, b))
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        yield stars()


def contracted(edges: DataFrame, held: int = 500_000) -> DataFrame:
    """Edges (a, b) of the same connected parts, at most one for each node and ``held`` edges of a task; no shuffle."""
    return edges.mapInArrow(lambda batches: _forest(batches, held, False), EDGES)


def components(edges: DataFrame, held: int = 500_000) -> DataFrame:
    """(node, root) of every node of ``edges`` (a long, b long) that is not the smallest of its component, its root.

    Loops and nulls are left out; an empty table gives no rows. The driver sees two counts a round.
    """
    own = edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    now = written(contracted(own, held), "edges")
    while True:
        met, jumps = Observation(), Observation()
        keyed = now.repartition("a").sortWithinPartitions("a")
        stars = keyed.mapInArrow(lambda batches: _forest(batches, held, True), STARS)
        stars = written(stars.observe(met, F.count_if("new").alias("n")), "stars")
        dropped(now)
        up = stars.where("own").select(F.col("a").alias("at"), F.col("b").alias("up"))
        moved = stars.join(up, F.col("b") == F.col("at"), "left").observe(jumps, F.count("up").alias("n"))
        now = written(contracted(moved.select("a", F.coalesce("up", "b").alias("b")), held), "edges")
        dropped(stars)
        if not met.get["n"] and not jumps.get["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
