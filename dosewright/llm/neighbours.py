"""Approximate nearest neighbours: stable random projections, kd-trees and a chi-square stopping test.

Largest inner product becomes least distance: a row x gets one more coordinate, sqrt(M^2 - |x|^2) for
the greatest norm M, a query gets 0 there and is scaled to norm M, and then |q - x|^2 = 2 M^2 - 2 <q, x>.
Every row is projected on ``dims`` Gaussian directions (a 2-stable law): for two points at distance r the
squared projected distance over r^2 follows a chi-square law with ``dims`` degrees of freedom.

Rows are dealt into blocks by a hash of vec_id. A block is indexed once, by a kd-tree over its projections, and
the index is a written table of a row for each block. A task holds one block of rows and one block of queries,
both of fixed size, so its memory does not grow with the table. For each query the rows are verified with exact
inner products in order of projected distance, in runs of growing length. With r the k-th best distance so far
and d the projected distance of the next row, a row at distance r or less lies beyond d with probability
1 - F(d^2 / r^2); the search stops when F reaches ``sure``, and leaves whose boxes lie beyond that d are not opened.

Vectors that are null, of norm zero, or hold null or non-finite components take no part, nor do vectors
whose length is not the most frequent one (the smaller of equals). Where squared norms overflow a double every
row is verified. Ties in score go to the smaller
vec_id. Rows repeated under one vec_id are one candidate (their least vector by comparison) and one
query; null vec_ids take no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

FOUND = "query_id long, vec_id long, score double, r int, verified long, block_rows long"


def chi_square(x: np.ndarray, dims: int) -> np.ndarray:
    """Distribution function of the chi-square law with an even number of degrees of freedom."""
    half, term, total = x / 2, np.ones_like(x), np.ones_like(x)
    for k in range(1, dims // 2):
        term = term * half / k
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_point(sure: float, dims: int) -> float:
    """The x at which :func:`chi_square` reaches ``sure``, by bisection."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array(mid), dims) < sure else (low, mid)
    return high


class Tree:
    """A kd-tree over projected rows: leaves of about ``leaf`` rows with their bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = 64):
        order, parts, stack = np.arange(len(points)), [], [np.arange(len(points))]
        while stack:
            own = stack.pop()
            if len(own) <= leaf:
                parts.append(own)
                continue
            axis = int(np.ptp(points[own], axis=0).argmax())
            split = np.argpartition(points[own, axis], len(own) // 2)
            stack += [own[split[: len(own) // 2]], own[split[len(own) // 2 :]]]
        self.order = np.concatenate(parts) if parts else order
        sizes = np.array([len(x) for x in parts])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.low = np.array([points[x].min(axis=0) for x in parts])
        self.high = np.array([points[x].max(axis=0) for x in parts])


class Block:
    """The index of one block of rows: vectors, ids and projections in the order of a kd-tree's leaves."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, projected: np.ndarray):
        tree = Tree(projected)
        self.vectors, self.ids, self.projected = vectors[tree.order], ids[tree.order], projected[tree.order]
        self.low, self.high = tree.low, tree.high
        self.leaf_of = np.repeat(np.arange(len(tree.starts)), tree.ends - tree.starts)

    def dumped(self) -> dict:
        arrays = {"vectors": self.vectors, "ids": self.ids, "projected": self.projected, "low": self.low, "high": self.high, "leaf_of": self.leaf_of.astype(np.int32)}
        return {k: v.tobytes() for k, v in arrays.items()}

    @classmethod
    def loaded(cls, row, width: int, dims: int, kind: type) -> Block:
        out = cls.__new__(cls)
        flat = lambda name, kind_: np.frombuffer(row[name], kind_)
        out.vectors, out.ids = flat("vectors", kind).reshape(-1, width), flat("ids", np.int64)
        out.projected, out.low, out.high = (flat(n, np.float64).reshape(-1, dims) for n in ("projected", "low", "high"))
        out.leaf_of = flat("leaf_of", np.int32)
        return out

    def search(self, query: np.ndarray, query_id: int, seen: np.ndarray, k: int, radius2: float, point: float, probe: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
        """The best k (ids, scores) found for one query, and the number of rows verified.

        ``seen`` is the query's projection, scaled to the greatest norm. Projected neighbours are verified nearest
        first; after each run of them the k-th best distance gives the projected distance beyond which the
        chi-square test holds, which only shrinks, and leaves whose box lies beyond it are never opened.
        """
        norm, slack = np.sqrt(query @ query), 1e-5 * np.sqrt(query @ query) * np.sqrt(radius2)
        gap = np.maximum(np.maximum(self.low - seen, seen - self.high), 0)
        box = np.einsum("ij,ij->i", gap, gap)
        short = query.astype(self.vectors.dtype)
        best_ids, best_scores, best_far = np.empty(0, np.int64), np.empty(0), np.empty(0)

        def far(rows: np.ndarray) -> np.ndarray:
            step = self.projected[rows] - seen
            return np.einsum("ij,ij->i", step, step)

        def verify(rows: np.ndarray, d2: np.ndarray) -> float:
            """Take ``rows`` into the best k; the projected distance at which the search may stop."""
            nonlocal best_ids, best_scores, best_far
            rough = self.vectors[rows] @ short
            # Fast scores choose the rows that may be among the best; those are scored again, each in the same order of sums.
            least = best_scores[-1] if len(best_ids) == k else np.partition(rough, -k - 1)[-k - 1] if len(rough) > k + 1 else -np.inf
            likely = np.flatnonzero(~(rough < least - slack))
            likely = likely[self.ids[rows[likely]] != query_id]
            own = rows[likely]
            scores = np.einsum("ij,j->i", self.vectors[own].astype(np.float64), query)
            best_ids, best_scores, best_far = (np.concatenate(x) for x in ((best_ids, self.ids[own]), (best_scores, scores), (best_far, d2[likely])))
            keep = np.lexsort((best_ids, -best_scores))[:k]
            best_ids, best_scores, best_far = best_ids[keep], best_scores[keep], best_far[keep]
            if len(best_ids) < k or not np.isfinite(radius2):
                return np.inf
            r2 = max(0.0, 2 * radius2 - 2 * np.sqrt(radius2) * best_scores[-1] / norm)
            return max(point * r2, best_far.max() * (1 + 1e-9))  # rows at the projected distance of one held may equal it

        first = np.argsort(box, kind="stable")[: max(1, 4 * probe // 64)]
        rows = np.flatnonzero(np.isin(self.leaf_of, first))
        d2 = far(rows)
        some = np.argsort(d2, kind="stable")[:probe]
        bound, done = verify(rows[some], d2[some]), len(some)
        open_ = box <= bound
        left = open_[self.leaf_of]
        left[rows[some]] = False
        rows = np.flatnonzero(left)
        d2 = far(rows)
        near = np.flatnonzero(d2 <= bound)
        near = near[np.argsort(d2[near], kind="stable")]
        rows, d2, at = rows[near], d2[near], 0
        while at < (end := int(np.searchsorted(d2, bound, "right"))):
            some = slice(at, min(end, at + max(2 * probe, (end - at) // 4)))
            bound, done, at = verify(rows[some], d2[some]), done + some.stop - at, some.stop
        return best_ids, best_scores, done


def _usable(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part, once for each id."""
    own = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(finite & F.exists("v", lambda x: x != 0))
    own = own.groupBy("id").agg(F.min("v").alias("v"))
    sizes = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("v") == (sizes["n"] if sizes else 0))


def _found(table: DataFrame, key: str, vector: str, every: int, k: int, dims: int, sure: float, row_block: int, query_block: int, seed: int) -> DataFrame:
    """The best k rows of each block for each query, with the block and the number of its rows that were verified."""
    own = written(_usable(table, key, vector), "vectors")
    squared = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = own.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"), F.max(squared).alias("m"), F.max(F.size("v")).alias("d")).first()
    n_rows, n_queries = max(1, -(-facts["n"] // row_block)), max(1, -(-facts["q"] // query_block))
    radius2, width = float(facts["m"] or 1.0), int(facts["d"] or 0)
    gauss, point = np.random.default_rng(seed).standard_normal((width + 1, dims)), chi_square_point(sure, dims)
    kind = np.float32 if table.schema[vector].dataType.elementType.typeName() == "float" else np.float64
    dealt = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        more = np.sqrt(np.maximum(0.0, radius2 - (x * x).sum(axis=1)))
        block = Block(x.astype(kind), pdf["id"].to_numpy(), np.nan_to_num(x @ gauss[:-1] + more[:, None] * gauss[-1]))
        return pd.DataFrame([{"r": pdf["r"].iloc[0], **block.dumped()}])

    # The index: a row for each block, built once whatever the number of query blocks.
    shape = "r int, " + ", ".join(f"{n} binary" for n in ("vectors", "ids", "projected", "low", "high", "leaf_of"))
    blocks = written(own.withColumn("r", dealt(1, n_rows)).groupBy("r").applyInPandas(index, shape), "index")
    rows = blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asks = own.where(F.col("id") % every == 0).select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"), dealt(2, n_queries).alias("q"))

    def pair(has: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in has.iterrows():
            block = Block.loaded(row, width, dims, kind)
            for query_id, v in zip(asked["id"], asked["v"], strict=True):
                query = np.asarray(v, np.float64)
                seen = np.nan_to_num(query / np.sqrt(query @ query) * np.sqrt(radius2) @ gauss[:-1])
                ids, scores, done = block.search(query, query_id, seen, k, radius2, point)
                out.append(pd.DataFrame({"query_id": np.full(len(ids), query_id, np.int64), "vec_id": ids, "score": scores, "r": np.int32(row["r"]), "verified": np.int64(done), "block_rows": np.int64(len(block.ids))}))
        return pd.concat(out) if out else pd.DataFrame({n: np.empty(0) for n in ("query_id", "vec_id", "score", "r", "verified", "block_rows")})

    return rows.groupBy("r", "q").cogroup(asks.groupBy("r", "q")).applyInPandas(pair, FOUND)


def nearest(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, dims: int = 16, sure: float = 0.95, row_block: int = 1 << 15, query_block: int = 1024, seed: int = 7) -> DataFrame:
    """The k nearest found of each query (rows whose id is divisible by ``every``), best first."""
    found = _found(table, key, vector, every, k, dims, sure, row_block, query_block, seed)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def effort(table: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, dims: int = 16, sure: float = 0.95, row_block: int = 1 << 15, query_block: int = 1024, seed: int = 7) -> DataFrame:
    """(query_id, verified, candidates): how many rows each query's search verified, of how many."""
    found = _found(table, key, vector, every, k, dims, sure, row_block, query_block, seed)
    return found.groupBy("query_id", "r").agg(F.max("verified").alias("v"), F.max("block_rows").alias("n")).groupBy("query_id").agg(F.sum("v").alias("verified"), F.sum("n").alias("candidates"))
