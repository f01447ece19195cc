"""Line dedup by pairwise alignment: later documents are aligned with earlier ones by patience diff and the
common blocks go from the later one.

Lines are compared by a 64-bit hash of their words (ASCII white space does not count). Candidates come from
runs of consecutive lines: from each line on, and up to each line, the shortest run of ``words`` words or
more. Each run is joined with its first owner, the text with the smallest doc_id that has it: one candidate
per run and document, whatever its frequency. Any block of ``words`` words that two documents share is made
of such runs (a line of it ends a run inside the block or lies in the run from the block's start), so each of
its lines meets an earlier document that has the same run around it, whichever documents own its single lines.

Each (later, earlier) pair is then aligned on all the lines that both have: lines unique on both sides in
their longest increasing run, recursively between them, and equal ends taken along. A run of aligned lines
that follow each other in both texts (lines without words aside) is a common block; blocks of ``words`` words
or more are deleted from the later document, and so are blocks of that size that the alignment passes over
because they are repeated or stand in another order. Lines common by chance and shorter blocks stay.

"Later" is by doc_id, then by a hash of the text; null doc_ids come last. An exact copy of an earlier text
is found by the text's hash and loses all its lines, if they have ``words`` words together. Rows equal in
doc_id and text are one document and are treated alike. Null texts stay null, lines without words always
stay, and an empty table gives no rows. :func:`trimmed` keeps all columns of its input and overwrites text
and n_chars alone.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, fresh, written

LAST = (1 << 63) - 1


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (sorted by the first) whose seconds increase."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        back[k] = at[p - 1] if p else -1
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items of two sequences."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if once_b[b[j]] == 1}
        found = _increasing([(i, where[a[i]]) for i in range(a0, a1) if once_a[a[i]] == 1 and a[i] in where])
        for (i, j), (i1, j1) in zip([(a0 - 1, b0 - 1), *found], [*found, (a1, b1)], strict=True):
            if found:
                todo.append((i + 1, i1, j + 1, j1))
        out += found
    return sorted(out)


def common_blocks(own: list[tuple[int, int, int]], other: list[tuple[int, int]], words: int) -> list[int]:
    """Places of ``own`` (place, hash, words) in common blocks with ``other`` (place, hash); places skip lines without words."""
    aligned = patience([x[1] for x in own], [x[1] for x in other])
    out: list[int] = []
    run: list[int] = []
    held, before = 0, None
    for i, j in [*aligned, (None, None)]:
        place = None if i is None else (own[i][0], other[j][0])
        if before is None or place is None or place != (before[0] + 1, before[1] + 1):
            if held >= words:
                out += run
            run, held = [], 0
        if place is not None:
            run.append(place[0])
            held += own[i][2]
        before = place
    return out


def least_runs(own: list[tuple[int, int, int]], words: int) -> dict[tuple, set[int]]:
    """Shortest runs of ``words`` words from and up to each line of ``own`` (place, hash, words): their hashes, and the places they take."""
    out: dict[tuple, set[int]] = {}

    def add(low: int, high: int) -> None:
        out.setdefault(tuple(x[1] for x in own[low:high]), set()).update(x[0] for x in own[low:high])

    low = held = 0
    for k, (place, _, n) in enumerate(own):
        if k and place != own[k - 1][0] + 1:
            low, held = k, 0
        held += n
        if held >= words:
            while held - own[low][2] >= words:
                add(low, k + 1)
                held -= own[low][2]
                low += 1
            add(low, k + 1)
    return out


def moved_blocks(own: list[tuple[int, int, int]], other: list[tuple[int, int]], words: int) -> set[int]:
    """Places of ``own`` in runs of ``words`` words that ``other`` has too, wherever they stand."""
    size = {h: n for _, h, n in own}
    theirs = least_runs([(p, h, size[h]) for p, h in other], words)
    return set().union(*(places for run, places in least_runs(own, words).items() if run in theirs))


def _lines(texts: DataFrame) -> DataFrame:
    """A row for each text of ``texts`` (d, t, text): hash, words and number of each of its lines with words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        one = xxhash.xxh64_intdigest
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hashes, sizes, numbers = [], [], []
                for text in part.column(2).cast(pa.large_binary()).to_pylist():
                    own = [(number, line.split()) for number, line in enumerate(text.split(b"\n"))]
                    own = [x for x in own if x[1]]
                    hashes.append(np.array([one(b" ".join(x)) for _, x in own], np.uint64).view(np.int64))
                    sizes.append([len(x) for _, x in own])
                    numbers.append([x for x, _ in own])
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(hashes, longs), pa.array(sizes, ints), pa.array(numbers, ints)], ["d", "t", "hs", "sizes", "numbers"])

    return texts.mapInArrow(rows, "d long, t long, hs array<long>, sizes array<int>, numbers array<int>")


def run_keys(hashes: np.ndarray, sizes: np.ndarray, starts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the different runs of each text; text k has the lines from starts[k] to starts[k + 1]."""
    n = len(hashes)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first, end = starts[:-1][text], starts[1:][text]
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    base = 0x9E3779B97F4A7C15
    power, back = (np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, x, np.uint64))]) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n], dtype=np.uint64)])
    line = np.arange(n)
    up = np.searchsorted(total, total[:-1] + words)
    down = np.searchsorted(total, total[1:] - words, "right") - 1
    texts, keys = [], []
    for low, high, good in ((line, up, up <= end), (down, line + 1, down >= first)):
        low, high = low[good], high[good]
        texts.append(text[good])
        keys.append((sums[high] - sums[low]) * back[low])
    texts, keys = np.concatenate(texts), np.concatenate(keys)
    order = np.lexsort((keys, texts))
    texts, keys = texts[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (texts[1:] != texts[:-1]) | (keys[1:] != keys[:-1])
    return texts[new], keys[new]


def _runs(lists: DataFrame, words: int) -> DataFrame:
    """(d, t, r) for each different run of each row of ``lists`` (d, t, hs, sizes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hs, sizes = part.column(2), part.column(3)
                starts = np.concatenate([[0], np.cumsum(hs.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                index, keys = run_keys(hs.flatten().to_numpy().view(np.uint64), sizes.flatten().to_numpy(), starts, words)
                take = pa.array(index, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(keys.view(np.int64))], ["d", "t", "r"])

    return lists.select("d", "t", "hs", "sizes").mapInArrow(rows, "d long, t long, r long")


def _blocks(pairs: DataFrame, words: int) -> DataFrame:
    """(d, t, gone) for each pair of ``pairs`` (d, t, hs, sizes, numbers, theirs): the line numbers that its common blocks take."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for d, t, hs, sizes, numbers, theirs in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                both = set(hs).intersection(theirs)
                own = [(p, h, n) for p, (h, n) in enumerate(zip(hs, sizes, strict=True)) if h in both]
                other = [(p, h) for p, h in enumerate(theirs) if h in both]
                if found := moved_blocks(own, other, words).union(common_blocks(own, other, words)):
                    for column, x in zip(out, (d, t, [numbers[p] for p in sorted(found)]), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32()))], ["d", "t", "gone"])

    return pairs.mapInArrow(rows, "d long, t long, gone array<int>")


def removals(docs: DataFrame, words: int = 10) -> DataFrame:
    """(d, t, gone) of each document of ``docs`` (doc_id, text) that loses lines: gone holds their numbers from 0.

    d is the doc_id (the greatest long for null), t the 64-bit hash of the text.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")
    texts = docs.where(F.col("text").isNotNull()).select(d, F.xxhash64("text").alias("t"), "text")
    lists = written(_lines(texts).where(F.size("hs") > 0).dropDuplicates(["d", "t"]), "lines")
    # Small tables are written before they are joined, so that both sides of a join are plain exchanges and a hot key's partition can be split.
    firsts = written(lists.groupBy("t").agg(F.min("d").alias("fd"), F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "fd"), "firsts")
    enough = F.aggregate("sizes", F.lit(0), lambda x, y: x + y) >= words
    copies = lists.join(firsts, "t").where((F.col("d") != F.col("fd")) & enough)
    singles = lists.join(firsts, "t", "left").where("fd is null or d = fd")
    runs = written(_runs(singles, words), "runs")
    owners = runs.groupBy("r").agg(F.min(F.struct("d", "t")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owners = written(owners.select("r", F.col("first.d").alias("od"), F.col("first.t").alias("ot")), "owners")
    pairs = written(runs.join(owners, "r").where("d <> od or t <> ot").select("d", "t", "od", "ot").distinct(), "pairs")
    theirs = lists.select(F.col("d").alias("od"), F.col("t").alias("ot"), F.col("hs").alias("theirs"))
    both = pairs.join(lists, ["d", "t"]).join(theirs, ["od", "ot"]).select("d", "t", "hs", "sizes", "numbers", "theirs")
    found = _blocks(both, words).unionAll(copies.select("d", "t", F.col("numbers").alias("gone")))
    gone = written(found.groupBy("d", "t").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone")), "gone")
    for table in (lists, firsts, runs, owners, pairs):
        dropped(table)
    return gone


def with_removals(docs: DataFrame, words: int = 10) -> tuple[DataFrame, str]:
    """``docs`` with one more column, the numbers of the lines that go (null: none), and that column's name."""
    gone = removals(docs, words)
    name, d, t = (fresh(docs, x) for x in ("gone", "removal_d", "removal_t"))
    gone = gone.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(name))
    at = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col(d)) & (F.xxhash64("text") == F.col(t))
    return docs.join(gone, at, "left").drop(d, t), name


def _without(text: str, gone: str):
    own = F.split(text, "\n", -1)
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(F.filter(own, lambda x, k: ~F.array_contains(F.col(gone), k)), "\n"))


def trimmed(docs: DataFrame, words: int = 10, drop_emptied: bool = True) -> DataFrame:
    """``docs`` without the deleted lines; documents that lose all their words go, or stay as what is left."""
    own, gone = with_removals(docs, words)
    out = own.withColumn("text", _without("text", gone))
    if drop_emptied:
        out = out.where(F.col(gone).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, words: int = 10) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0) and the text that is left, for every row."""
    own, gone = with_removals(docs.select("doc_id", "text"), words)
    removed = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    return own.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), _without("text", gone).alias("text"))
