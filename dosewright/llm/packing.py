"""Pattern packing by non-negative least squares.

Pieces of at most ``capacity`` tokens go into as few sequences as possible. Only their length histogram
reaches the driver: it has ``capacity`` entries at most, whatever the number of documents.

1. Patterns of one, two or three lengths that fill a sequence exactly are enumerated.
2. Their repeat counts are fitted to the histogram by non-negative least squares (accelerated projected
   gradient on the sparse pattern matrix), then rounded down, never using a length more often than it occurs.
3. What rounding leaves is packed by best fit decreasing on the histogram.
4. Every piece gets its rank among the pieces of its length; a pattern's slot owns an interval of ranks,
   which one binary search of a small sorted array finds.

Ranks need no sort: each task numbers the pieces of a length as it writes them, and sums over (length,
task) give where a task's numbers begin.

Null texts count as empty (one piece that holds the end id alone), repeated rows are packed as often as
they occur, null doc_ids are kept, ties in length are broken by place in the written table, and an empty
table gives no rows. Only doc_id and text are read; other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: whole capacities, the first piece taking the rest."""
    first = n - (max(1, -(-n // capacity)) - 1) * capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenised_pieces(docs: DataFrame, capacity: int, vocabulary_file: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text), written once: each with its task and its number in that task and length."""
    schema = PIECES + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = encoder(vocabulary_file), TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, own in enc.batches(batch.column(1), end_id):
                out: list[tuple] = []
                for key, ids in zip(keys[at : at + len(own)], own, strict=True):
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        some = ids[start : start + n]
                        out.append((key, k, start, n, zlib.crc32(some.astype("<u4").tobytes()), task, int(met[n])) + (some.astype(np.int32),) * with_ids)
                        met[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=False)], names[: 7 + with_ids])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.mapInArrow(pieces, schema), "pieces")


def enumerate_patterns(capacity: int, present: np.ndarray) -> np.ndarray:
    """Patterns of up to three lengths (0: none) that sum to ``capacity``; third lengths come from a geometric grid."""
    found = [(capacity, 0, 0)]
    found += [(a, capacity - a, 0) for a in range(1, capacity // 2 + 1)]
    grid = sorted({max(1, round(capacity / 2 ** (k / 3))) for k in range(5, 34)})
    for a in grid:
        found += [(a, b, capacity - a - b) for b in range(a, (capacity - a) // 2 + 1)]
    patterns = np.unique(np.sort(np.array(found, np.int64), axis=1)[:, ::-1], axis=0)
    return patterns[(present[patterns] | (patterns == 0)).all(axis=1)]


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths comes nearest to ``histogram`` (least squares)."""
    b = histogram.astype(float)
    size, used = len(b), patterns > 0
    # Columns and rows are scaled by the histogram so that rare lengths count as much as common ones.
    weight = 1.0 / np.sqrt(np.maximum(b, 1.0))
    weight[0] = 0.0
    scale = 1.0 / np.maximum((np.where(used, weight[patterns], 0.0) ** 2).sum(axis=1), 1e-12) ** 0.5

    def ahead(x: np.ndarray) -> np.ndarray:
        y = x * scale
        return weight * sum(np.bincount(patterns[:, k], y * used[:, k], size) for k in range(3))

    def back(r: np.ndarray) -> np.ndarray:
        w = weight * r
        return scale * sum(w[patterns[:, k]] * used[:, k] for k in range(3))

    v = np.ones(len(patterns))
    for _ in range(30):
        v = back(ahead(v))
        bound = np.linalg.norm(v)
        v /= max(bound, 1e-12)
    step, goal = 1.0 / max(bound * 1.05, 1e-12), weight * b
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(ahead(y) - goal))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Packing of a histogram: ([(length, times in a sequence)], number of such sequences)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if not left[1:].any():
        return out
    patterns = enumerate_patterns(capacity, left > 0)
    if len(patterns):
        fitted = fit_counts(patterns, left)
        for k in np.argsort(-fitted, kind="stable"):
            lengths, times = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            n = min(int(fitted[k] + 1e-9), int((left[lengths] // times).min()))
            if n > 0:
                left[lengths] -= n * times
                out.append((list(zip(lengths.tolist(), times.tolist(), strict=True)), n))
    return out + best_fit(left, capacity)


def best_fit(histogram: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit decreasing on a histogram; equal sequences are handled together, by their number."""
    left = histogram.astype(np.int64).copy()
    spaces: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            room = next((s for s in range(length, capacity) if spaces.get(s)), 0)
            if room:
                held, many = spaces[room].pop()
                times = min(room // length, max(1, n // many))
                some = min(many, n // times)
                if some < many:
                    spaces[room].append((held, many - some))
            else:
                held, room = (), capacity
                times = min(room // length, n)
                some = n // times
            n -= some * times
            spaces.setdefault(room - times * length, []).append(((*held, (length, times)), some))
    return [(list(held), many) for kind in spaces.values() for held, many in kind]


def intervals(packing: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, times, offset) of every slot."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for held, many in packing:
        offset = 0
        for length, times in held:
            low = taken.get(length, 0)
            taken[length] = low + many * times
            rows.append((length, low, low + many * times, sequence, times, offset))
            offset += length * times
        sequence += many
    return rows


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` of :func:`tokenised_pieces` with sequence_id and offset added."""
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # capacity rows at most
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = pieces.join(begins, ["length", "task"]).withColumn("rank", F.col("begin") + F.col("place"))
    # The slots depend on the capacity and the patterns alone, not on the number of documents.
    slots = np.array(sorted(intervals(plan(histogram, capacity))) or [(0, 0, 0, 0, 1, 0)], np.int64)
    return _placed(ranked.drop("task", "place", "begin"), slots, 62 - capacity.bit_length())


def _placed(ranked: DataFrame, slots: np.ndarray, shift: int) -> DataFrame:
    """``ranked`` with sequence_id and offset in place of rank: each piece's slot is found by one search for (length, rank)."""
    length, low, _, sequence, times, offset = slots.T
    keys = (length << shift) + low
    names = [c for c in ranked.columns if c != "rank"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (own << shift) + rank, "right") - 1
            past = rank - low[at]
            more = [pa.array(sequence[at] + past // times[at]), pa.array(offset[at] + past % times[at] * own)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *more], [*names, "sequence_id", "offset"])

    schema = ranked.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(rows, schema)


def pack_documents(docs: DataFrame, vocabulary_file: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack ``docs``: a row per piece, with its sequence and its place there."""
    return pack(tokenised_pieces(docs, capacity, vocabulary_file, end_id, with_ids), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that carry ids: ids, and the doc_ids and offsets within."""
    own = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(own.alias("own"))  # a sequence holds capacity tokens at most
    return grouped.select("sequence_id", F.flatten("own.ids").alias("ids"), F.col("own.doc_id").alias("doc_ids"), F.col("own.offset").alias("offsets"))
