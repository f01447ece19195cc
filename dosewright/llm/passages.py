"""Substring dedup by collinear chaining: fuzzy passages of ``least`` words or more that two documents share.

1. Words are lower-cased runs of anything but ASCII white space. A seed is four words, one that may differ, and
   four more; half of all seeds count, chosen by their hash and so alike in every document. One changed word in
   five or more, evenly spread, leaves such seeds, and eight fixed words seldom agree by chance. To these come runs
   of 39 and 50 words, thinned to the least hash of each window of 12: any 50 equal words share a run of 39 and any
   61 a run of 50, whoever owns their seeds, and the owner of a run of 50 is a passage by itself.
2. Each occurrence of a seed or run is matched with its first owner, the document with the smallest doc_id that has
   it, so a passage in a third of all documents costs no more than its words. Nearly all seeds occur once. So that
   these cost little, tasks sort some million seeds at a time by hash and send them in blocks of a few bytes a seed
   to the range of hashes that they belong to, where owners are found. Of a seed that is frequent in one task, the
   first occurrence there goes into the block and the others go as rows of their own, dealt out evenly, that are
   joined with the owner later; so no range holds a frequent seed's occurrences.
3. The matches of a (document, owner) pair, of ``k`` sure words each, are chained: a Fenwick tree over owner
   positions keeps the best chain end, scored by the words it covers less a cost for every word of gap,
   separately from a cost for gaps of different length, until chains of matches that increase on both sides
   remain. A match alone is a chain too; of matches alone with one place of the owner, as repeated words have,
   there is one for every ``least`` words.
4. Each chain is aligned: the words of both sides are fetched, equal runs grow from the matches, small gaps
   are aligned by longest common subsequence, and both ends are extended while they still gain.

A chain that lies within another of its document, and the other is long and alike enough by its matches alone, is
not aligned: a document in a group of copies is reported with the copies that matter, not with all of them. An
aligned chain is reported if both sides have ``least`` words or more and 2 * matched / (words of both sides) is
at least ``similar``. Of a document's passages with one owner the fewest are reported that cover all the words of
the document that any of them covers: a line that repeats within both texts meets its first place in the owner at
every shift, and each shift would be a row. Only passages shared by different documents count.

Exact copies need no rule of their own: their only chain with the first copy is the whole text. Null texts
count as empty. Different texts under one doc_id, or under null, are different documents, ordered by doc_id (null
last) and a hash of the text; rows equal in both are one document, whose passages are reported once. Only doc_id
and text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

FOUND = "doc_id long, start int, n_words int, source_id long, source_start int, source_words int, matched int, similarity double"


class Words(dict):
    """A bounded memo of word hashes (64 bits)."""

    def __init__(self, bound: int = 500_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes(text: bytes | None, memo: Words) -> np.ndarray:
    own = (text or b"").lower().split()
    return np.array(list(map(memo.__getitem__, own)), np.uint64)


#: The last doc_id of all, for null.
LAST = (1 << 63) - 1
#: Words, window (none: places are taken by their hash) and word left out (none: -1) of each kind of seed.
KINDS = ((9, None, 4), (39, 12, -1), (50, 12, -1))
BITS = 48
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(n, base, np.uint64))])


def seeds(hashes: np.ndarray, k: int, window: int | None, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of a text; word ``skip`` of the k is left out.

    With a window: the least hashes of every window of that many places. Without: half of all places, by their hash.
    """
    n = len(hashes) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    # Sums of words times powers, moved to one place by the inverse power.
    up = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes) - 1), dtype=np.uint64)])
    sums = (up[k:] - up[:n]) * _powers(_INVERSE, n - 1)
    if skip >= 0:
        sums -= hashes[skip : skip + n] * np.uint64(pow(_BASE, skip, 1 << 64))
    sums ^= sums >> np.uint64(29)
    sums *= np.uint64(0xBF58476D1CE4E5B9)
    sums ^= sums >> np.uint64(32)
    if window is None:
        at = np.flatnonzero(sums & np.uint64(1))
    elif n <= window:
        at = np.flatnonzero(sums == sums.min())
    else:
        # A place is the least of some window if it equals the greatest of the minima of the windows it lies in.
        least = _sliding(sums, window, np.minimum)
        edge = np.zeros(window - 1, np.uint64)
        at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), window, np.maximum) == sums)
    return at, sums[at]


def _sliding(x: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``window`` values that follow each other, by doubling."""
    done = 1
    while done < window:
        step = min(done, window - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def all_seeds(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 48-bit hashes of the seeds of every kind."""
    own = [seeds(hashes, *kind) for kind in KINDS]
    mixed = [(x[1] ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS) for n, x in enumerate(own)]
    return np.concatenate([x[0] for x in own]), np.concatenate(mixed)


def _narrow(x: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, numbers) of unsigned numbers, at as few bytes as the greatest needs."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return width, x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(width: int, data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


#: ``salt`` is 0 for a block of seeds (hash steps, places, the documents they lie in), else the row's are the occurrences of seeds that are frequent in one task.
BLOCK = "part int, salt int, hw int, hs binary, pw int, ps binary, ds binary, ts binary, starts binary, hot binary"
#: kind 0: matches of a document with an owner; 1: the owner of a seed that is frequent somewhere; 2: an occurrence of such a seed.
MATCH = "kind int, h long, d long, t long, o long, u long, ps array<int>, qs array<int>"


def _blocks_of(docs: list[tuple[int, int, np.ndarray]], parts: int, hot: int, salts: int) -> list[tuple]:
    """The rows of ``BLOCK`` of some documents (d, t, word hashes)."""
    ds, ts = np.array([x[0] for x in docs], np.int64), np.array([x[1] for x in docs], np.int64)
    sizes = np.array([len(x[2]) for x in docs], np.int64)
    starts = np.cumsum(sizes) - sizes
    own = [all_seeds(x[2]) for x in docs]
    h = np.concatenate([x[1] for x in own])
    places = np.concatenate([x[0] + start for x, start in zip(own, starts, strict=True)])
    order = np.argsort(h, kind="stable")
    h, places = h[order], places[order]
    doc = np.searchsorted(starts, places, "right") - 1
    while (empty := sizes[doc] == 0).any():  # empty documents share their start with the next
        doc[empty] -= 1
    edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(h)))
    out: list[tuple] = []
    many = np.empty(0, np.uint64)
    if (count > hot).any():
        many = h[edge[count > hot]]
        big = np.flatnonzero(np.repeat(count > hot, count))
        rank = np.lexsort((places[big], ts[doc[big]], ds[doc[big]], h[big]))
        big = big[rank]
        away = big[np.concatenate([[False], h[big][1:] == h[big][:-1]])]  # all but the first of each
        pieces = min(32, salts)
        turn = int((ds[0] ^ ts[0]) % salts)  # the pieces of all tasks spread over all salts
        for piece in range(pieces):
            some = away[piece::pieces]
            if len(some):
                out.append((0, (turn + piece) % salts + 1, 8, h[some].tobytes(), 8, (places[some] - starts[doc[some]]).tobytes(), ds[doc[some]].tobytes(), ts[doc[some]].tobytes(), b"", b""))
        stay = np.ones(len(h), bool)
        stay[away] = False
        h, places, doc = h[stay], places[stay], doc[stay]
    part = (h >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)
    where = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    hot_part = (many >> np.uint64(BITS - 32)) * np.uint64(parts) >> np.uint64(32)
    for k in range(parts):
        low, high = where[k], where[k + 1]
        if low < high:
            met, number = np.unique(doc[low:high], return_inverse=True)
            # Places are counted over the documents met here, so that they stay small numbers.
            shift = np.cumsum(sizes[met]) - sizes[met]
            hw, hs = _narrow(np.diff(h[low:high], prepend=np.uint64(0)))
            pw, ps = _narrow((places[low:high] - starts[doc[low:high]] + shift[number.ravel()]).astype(np.uint64))
            out.append((k, 0, hw, hs, pw, ps, ds[met].tobytes(), ts[met].tobytes(), shift.tobytes(), many[hot_part == k].tobytes()))
    return out


def _seed_blocks(texts: DataFrame, parts: int, flush: int = 1_000_000, hot: int = 64, salts: int = 32, least: int = 0) -> DataFrame:
    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 5]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            own = _blocks_of(held, parts, hot, salts)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(list(zip(*own, strict=True)) or [()] * len(kinds), kinds, strict=True)], names)

        for batch in batches:
            for d, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), strict=True):
                own = word_hashes(text.as_py(), memo)
                if len(own) < least:  # too short for any passage
                    continue
                held.append((d, t, own))
                size += len(own)
                if size >= flush:
                    yield emit()
                    size = 0
        if held:
            yield emit()

    return texts.mapInArrow(rows, BLOCK)


def _matches(block: pd.DataFrame) -> pd.DataFrame:
    """The rows of ``MATCH`` of one part's blocks."""
    names = [x.split()[0] for x in MATCH.split(", ")]
    none = [np.empty(0, np.int32)]
    if block["salt"].iloc[0]:
        h, d, t, p = (np.concatenate([np.frombuffer(x, np.int64) for x in block[c]]) for c in ("hs", "ds", "ts", "ps"))
        empty = none * len(h)
        return pd.DataFrame({"kind": 2, "h": h, "d": d, "t": t, "o": 0, "u": 0, "ps": list(p.astype(np.int32)[:, None]), "qs": empty}, columns=names)
    hs, ds, ts, ps, hot = [], [], [], [], []
    for hw, h, pw, p, d, t, starts, many in zip(*(block[c] for c in ("hw", "hs", "pw", "ps", "ds", "ts", "starts", "hot")), strict=True):
        at, starts = _wide(pw, p).astype(np.int64), np.frombuffer(starts, np.int64)
        doc = np.searchsorted(starts, at, "right") - 1
        hs.append(np.cumsum(_wide(hw, h), dtype=np.uint64))
        ds.append(np.frombuffer(d, np.int64)[doc])
        ts.append(np.frombuffer(t, np.int64)[doc])
        ps.append((at - starts[doc]).astype(np.int32))
        hot.append(np.frombuffer(many, np.uint64))
    h, many = np.concatenate(hs), np.unique(np.concatenate(hot))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h), bool)
    often[order[1:][same]] = often[order[:-1][same]] = True
    if len(many):
        often |= np.isin(h, many)
    at = np.flatnonzero(often)
    h, d, t, p = h[at], np.concatenate(ds)[at], np.concatenate(ts)[at], np.concatenate(ps)[at]
    order = np.lexsort((p, t, d, h))
    h, d, t, p = h[order], d[order], t[order], p[order]
    first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.empty(0, bool)
    owner = np.flatnonzero(first)[np.cumsum(first) - 1]
    other = np.flatnonzero((d != d[owner]) | (t != t[owner]))
    d_, t_, o, u, p_, q = d[other], t[other], d[owner[other]], t[owner[other]], p[other], p[owner[other]]
    order = np.lexsort((p_, u, o, t_, d_))
    d_, t_, o, u, p_, q = (x[order] for x in (d_, t_, o, u, p_, q))
    new = np.flatnonzero(np.concatenate([[True], (d_[1:] != d_[:-1]) | (t_[1:] != t_[:-1]) | (o[1:] != o[:-1]) | (u[1:] != u[:-1])])) if len(d_) else np.empty(0, np.int64)
    out = pd.DataFrame({"kind": 0, "h": 0, "d": d_[new], "t": t_[new], "o": o[new], "u": u[new], "ps": np.split(p_, new[1:]) if len(new) else [], "qs": np.split(q, new[1:]) if len(new) else []}, columns=names)
    led = np.flatnonzero(first & np.isin(h, many))
    owners = pd.DataFrame({"kind": 1, "h": h[led].astype(np.int64), "d": 0, "t": 0, "o": d[led], "u": t[led], "ps": none * len(led), "qs": list(p[led][:, None])}, columns=names)
    return pd.concat([out, owners])


def thinned(pair: np.ndarray, p: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matches (p, q) of each pair without those that lie in a row on a diagonal between every k-th and the last."""
    order = np.lexsort((p, q - p, pair))
    pair, p, q = pair[order], p[order], q[order]
    twin = (pair[1:] == pair[:-1]) & (p[1:] == p[:-1]) & (q[1:] == q[:-1])
    new = np.concatenate([[True], ~twin]) if len(p) else np.empty(0, bool)
    pair, p, q = pair[new], p[new], q[new]
    same = (pair[1:] == pair[:-1]) & (p[1:] - p[:-1] <= k) & (q[1:] - p[1:] == q[:-1] - p[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(p) else np.empty(0, np.int64)
    since = p - np.repeat(p[starts], np.diff(np.append(starts, len(p))))
    step = since // k
    keep = np.append(~same, True) if len(p) else np.empty(0, bool)
    keep[starts] = True
    keep[1:] |= same & (step[1:] != step[:-1])  # the first match of every k places
    return pair[keep], p[keep], q[keep]


def wanted(chains: list[list[tuple[int, int]]], least: int, near: int = 60) -> list[list[tuple[int, int]]]:
    """``chains``, best first, without matches alone that a chain or another match alone of the same owner place stands for."""
    out = [run for run in chains if len(run) > 1]
    spans = [(run[0], run[-1]) for run in out]
    met: dict[int, int] = {}
    for i, j in sorted(run[0] for run in chains if len(run) == 1):
        if j in met and i - met[j] < least:
            continue
        if any(x[0] - near <= i <= y[0] + near and x[1] - near <= j <= y[1] + near and (i >= x[0] or abs(i - j - x[0] + x[1]) <= 1) and (i <= y[0] or abs(i - j - y[0] + y[1]) <= 1) for x, y in spans):
            continue
        met[j] = i
        out.append([(i, j)])
    return out


def chain(matches: list[tuple[int, int]], k: int, reach: int = 60, gap: float = 0.1, skew: float = 0.5) -> list[list[tuple[int, int]]]:
    """Chains of ``matches`` (i, j), increasing on both sides, best first; each match is in one chain at most.

    Score: words covered, less ``gap`` for each word between matches and ``skew`` for each word by which the
    gaps of both sides differ. The Fenwick tree holds, for owner positions up to j, the best end by score
    plus gap cost credit, so that the least total gap wins; ends further than ``reach`` words break a chain.
    """
    matches = sorted(set(matches))
    places = sorted({j for _, j in matches})
    rank = {j: r + 1 for r, j in enumerate(places)}
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(places) + 1)
    score, back = [0.0] * len(matches), [-1] * len(matches)
    at = 0
    for m, (i, j) in enumerate(matches):
        while matches[at][0] < i:  # only matches before i on this side may come before
            r, value = rank[matches[at][1]], (score[at] + gap * (matches[at][0] + matches[at][1]), at)
            while r < len(tree):
                if value > tree[r]:
                    tree[r] = value
                r += r & -r
            at += 1
        score[m], best, r = float(k), (-1e18, -1), rank[j] - 1
        while r:
            best = max(best, tree[r])
            r -= r & -r
        options = [best[1]] if best[1] >= 0 else []
        options += [x for x in range(max(0, m - 4), m)]  # and the matches just before, for the least skew
        for b in options:
            di, dj = i - matches[b][0], j - matches[b][1]
            if 0 < di <= reach and 0 < dj <= reach:
                got = score[b] + min(k, di, dj) - gap * max(0, min(di, dj) - k) - skew * abs(di - dj)
                if got > score[m]:
                    score[m], back[m] = got, b
    used = [False] * len(matches)
    out = []
    for m in sorted(range(len(matches)), key=lambda x: (-score[x], x)):
        run = []
        while m >= 0 and not used[m]:
            used[m] = True
            run.append(matches[m])
            m = back[m]
        if run:
            out.append(run[::-1])
    return out


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        up = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(up)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, run: list[tuple[int, int]], k: int, miss: float = 1.0, stop: float = 12.0) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, matched words) of the passage around a chain of matches (i, j) in a and b."""
    i, j = run[0]
    i1, j1, matched = i, j, 0
    for p, q in run:
        if p < i1 or q < j1:  # overlaps what is aligned: only a match on the same diagonal adds to it
            if p - i1 == q - j1 and p + k > i1:
                matched += p + k - i1
                i1, j1 = p + k, q + k
            continue
        matched += int((a[i1:p] == b[j1:q]).sum()) if p - i1 == q - j1 else _lcs(a[i1:p], b[j1:q])
        matched += k
        i1, j1 = p + k, q + k

    def extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
        """Words of both sides and matches gained by going on along x and y, one skip at a time."""
        u = v = 0
        score, got = 0.0, 0
        best = (0.0, 0, 0, 0)
        while u < len(x) and v < len(y) and score > best[0] - stop:
            n = min(len(x) - u, len(y) - v, 64)
            same = x[u : u + n] == y[v : v + n]
            run_ = n if same.all() else int(same.argmin())
            if run_:
                u, v, score, got = u + run_, v + run_, score + run_, got + run_
                if score > best[0]:
                    best = (score, u, v, got)
                continue
            # The skip of 4 words at most on either side after which two words agree again.
            step = next(((s, t) for total in range(1, 6) for s in range(total + 1) for t in (total - s,) if u + s + 1 < len(x) and v + t + 1 < len(y) and x[u + s] == y[v + t] and x[u + s + 1] == y[v + t + 1]), None)
            step = step or (1, 1)
            u, v, score = u + step[0], v + step[1], score - miss * max(step)
        return best[1], best[2], best[3]

    du, dv, got = extend(a[i1:], b[j1:])
    i1, j1, matched = i1 + du, j1 + dv, matched + got
    du, dv, got = extend(a[:i][::-1], b[:j][::-1])
    return i - du, i1, j - dv, j1, matched + got


def certain(run: list[tuple[int, int]], k: int, least: int, similar: float) -> bool:
    """Whether a chain is long and alike enough by its matches alone, whatever lies between them."""
    a, b = run[-1][0] + k - run[0][0], run[-1][1] + k - run[0][1]
    sure = k + sum(min(k, y[0] - x[0], y[1] - x[1]) for x, y in zip(run, run[1:], strict=False))
    return min(a, b) >= least and 2 * sure >= similar * (a + b)


def leading(chains: list[tuple[int, list[tuple[int, int]]]], k: int, least: int, similar: float) -> list[tuple[int, list[tuple[int, int]]]]:
    """The chains (owner, run) of one document without those that lie within a certain one, longest first."""
    out, spans = [], []
    for owner, run in sorted(chains, key=lambda x: (x[1][0][0] - x[1][-1][0], x[0], x[1][0])):
        low, high = run[0][0], run[-1][0] + k
        if any(a <= low and high <= b for a, b in spans):
            continue
        out.append((owner, run))
        if certain(run, k, least, similar):
            spans.append((low, high))
    return out


def covering(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The fewest of ``spans`` (start, end, other start, other end) that cover every word of the first side that any of them covers."""
    out, end, best = [], -1, None
    for span in sorted(spans, key=lambda x: (x[0], -x[1], x[2:])):
        if best is not None and span[0] > end:  # no other span covers the word at ``end``
            out.append(best)
            end, best = best[1], None
        if span[1] > end:
            end = max(end, span[0])
            best = span if best is None or span[1] > best[1] else best
    return out if best is None else [*out, best]


def _chains(documents: DataFrame, k: int, least: int, similar: float) -> DataFrame:
    """The chains (ps, qs) of each document of ``documents`` (d, t, own: its owners o, u and their places ps, qs), a row for each owner."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2)
            docs = np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy(zero_copy_only=False))
            own = own.flatten()
            os, us = (own.field(c).to_numpy() for c in (0, 1))
            ps, qs = own.field(2), own.field(3)
            # Rows of one document and owner are one pair.
            order = np.lexsort((us, os, docs))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(docs[order]) != 0) | (os[order][1:] != os[order][:-1]) | (us[order][1:] != us[order][:-1])
            pair_of = np.empty(len(order), np.int64)
            pair_of[order] = np.cumsum(new) - 1
            heads = order[new]
            pair = np.repeat(pair_of, ps.value_lengths().to_numpy(zero_copy_only=False))
            pair, p, q = thinned(pair, ps.flatten().to_numpy().astype(np.int64), qs.flatten().to_numpy().astype(np.int64), k)
            edges = np.searchsorted(pair, np.arange(len(heads) + 1))
            held: dict[int, list] = {}
            for n, head in enumerate(heads.tolist()):
                matches = list(zip(p[edges[n] : edges[n + 1]].tolist(), q[edges[n] : edges[n + 1]].tolist(), strict=True))
                held.setdefault(int(docs[head]), []).extend((head, run) for run in wanted(chain(matches, k), least))
            ds, ts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for n, found in held.items():
                own_runs: dict[int, list] = {}
                for head, run in leading(found, k, least, similar):
                    own_runs.setdefault(head, []).append(run)
                for m, (head, runs) in enumerate(own_runs.items()):
                    ps_, qs_ = ([[x[side] for x in run] for run in runs] for side in (0, 1))
                    out.append({"c": f"{ds[n]}/{ts[n]}/{m}", "d": ds[n], "t": ts[n], "o": int(os[head]), "u": int(us[head]), "ps": ps_, "qs": qs_})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    runs, long = pa.list_(pa.list_(pa.int32())), pa.int64()
    shape = pa.schema([("c", pa.string()), ("d", long), ("t", long), ("o", long), ("u", long), ("ps", runs), ("qs", runs)])
    return documents.mapInArrow(rows, "c string, d long, t long, o long, u long, ps array<array<int>>, qs array<array<int>>")


def _word_blocks(asked: DataFrame, block: int) -> DataFrame:
    """(d, t, b, words): the blocks of 32-bit word hashes that each row of ``asked`` (d, t, text, blocks) asks for."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ds, ts, bs, own = [], [], [], []
                for d, t, text, blocks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                    hashes = word_hashes(text, memo).astype(np.uint32).view(np.int32)
                    for b in blocks:
                        if len(some := hashes[b * block : (b + 1) * block]):
                            ds.append(d)
                            ts.append(t)
                            bs.append(b)
                            own.append(some)
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(ts, pa.int64()), pa.array(bs, pa.int32()), pa.array(own, pa.list_(pa.int32()))], ["d", "t", "b", "words"])

    return asked.mapInArrow(rows, "d long, t long, b int, words array<int>")


def _aligned(ready: DataFrame, k: int, least: int, similar: float, margin: int, block: int) -> DataFrame:
    """The passages of each row of ``ready``: y, a document's chains with one owner, and x, the blocks of words of both around them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sides: tuple[dict, dict] = ({}, {})
                pieces = x.values
                for n, (side, b) in enumerate(zip(pieces.field(0).to_pylist(), pieces.field(1).to_pylist(), strict=True)):
                    sides[side][b] = pieces.field(2)[n].values.to_numpy()

                def around(side: int, places: list[int], sides=sides) -> tuple[int, np.ndarray]:
                    """(first place, words) of one text from ``margin`` words before a chain to as many after it."""
                    low, high = max(0, min(places) - margin), max(places) + k + margin
                    first = low // block
                    words = np.concatenate([sides[side][b] for b in range(first, (high - 1) // block + 1) if b in sides[side]])
                    return low, words[low - first * block : high - first * block].astype(np.int64)

                grown: dict[tuple[int, int, int, int], int] = {}  # several chains may grow into one passage
                for ps, qs in zip(y["ps"], y["qs"], strict=True):
                    (a_low, a), (b_low, b) = around(0, ps), around(1, qs)
                    i, i1, j, j1, matched = align(a, b, [(p - a_low, q - b_low) for p, q in zip(ps, qs, strict=True)], k)
                    if min(i1 - i, j1 - j) >= least and 2 * matched >= similar * (i1 - i + j1 - j):
                        grown[i + a_low, i1 + a_low, j + b_low, j1 + b_low] = matched
                for i, i1, j, j1 in covering(list(grown)):
                    likeness = 2 * grown[i, i1, j, j1] / (i1 - i + j1 - j)
                    out.append({"doc_id": y["d"], "start": i, "n_words": i1 - i, "source_id": y["o"], "source_start": j, "source_words": j1 - j, "matched": grown[i, i1, j, j1], "similarity": likeness})
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in FOUND.split(", ")])
            yield pa.RecordBatch.from_pandas(frame, schema=shape, preserve_index=False)

    shape = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("n_words", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32()), ("source_words", pa.int32()), ("matched", pa.int32()), ("similarity", pa.float64())])
    return ready.mapInArrow(rows, FOUND)


def matched(texts: DataFrame, least: int, seeds_in_part: int = 1_500_000) -> DataFrame:
    """(d, t, own) of each document of ``texts`` (d, t, text) with seeds that earlier ones own: these (o, u), and the places in both (ps, qs)."""
    # About a seed for six bytes of text; the number of parts follows the input, so that a part fits in memory.
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // (6 * seeds_in_part)))
    blocks = _seed_blocks(texts, parts, salts=max(32, parts), least=least).groupBy("part", "salt")
    found = written(blocks.applyInPandas(_matches, MATCH), "matches")
    owners = found.where("kind = 1").select(F.col("h").alias("_h"), F.col("o").alias("_o"), F.col("u").alias("_u"), F.col("qs")[0].alias("_q"))
    # Both sides are plain scans, so the partition of a frequent seed can be split.
    hot = found.where("kind = 2").select("h", "d", "t", F.col("ps")[0].alias("p")).join(owners, F.col("h") == F.col("_h"))
    hot = hot.where("d <> _o or t <> _u").select("d", "t", F.col("_o").alias("o"), F.col("_u").alias("u"), F.array("p").alias("ps"), F.array("_q").alias("qs"))
    both = found.where("kind = 0").select("d", "t", "o", "u", "ps", "qs").unionAll(hot)
    # No more matches than the document has seeds.
    return both.groupBy("d", "t").agg(F.collect_list(F.struct("o", "u", "ps", "qs")).alias("own"))


def passages(docs: DataFrame, least: int = 50, similar: float = 0.8, k: int = 4, margin: int = 64, block: int = 256) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that an earlier document has too: a row per passage and earlier copy."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    chains = written(_chains(matched(texts, least), k, least, similar), "chains")

    # The blocks of words that the chains of a pair need of both texts, each once.
    def near(runs: str):
        low = lambda x: F.greatest(F.array_min(x) - margin, F.lit(0))
        high = lambda x: F.array_max(x) + (k + margin - 1)
        return F.array_distinct(F.flatten(F.transform(runs, lambda x: F.sequence(F.floor(low(x) / block).cast("int"), F.floor(high(x) / block).cast("int")))))

    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.col("d"), F.col("t"), near("ps").alias("bs")),
        F.struct(F.lit(1).alias("side"), F.col("o").alias("d"), F.col("u").alias("t"), near("qs").alias("bs")),
    )
    asks = chains.select("c", F.inline(sides)).select("c", "side", "d", "t", F.explode("bs").alias("b"))
    asked = written(asks.select("d", "t", "b").distinct().groupBy("d", "t").agg(F.collect_list("b").alias("blocks")), "asked")  # no more than a text has
    blocks = _word_blocks(texts.join(asked, ["d", "t"]).select("d", "t", "text", "blocks"), block)
    cut = asks.join(blocks, ["d", "t", "b"]).select("c", F.struct("side", "b", "words").alias("x"))
    rows = cut.withColumn("y", F.lit(None)).unionAll(chains.select("c", F.lit(None), F.struct("d", "o", "ps", "qs")))
    # One shuffle brings a pair's chains and words together; repeated rows give a block twice.
    ready = rows.groupBy("c").agg(F.first("y", ignorenulls=True).alias("y"), F.collect_set("x").alias("x")).select("y", "x")
    ids = {c: F.when(F.col(c) != LAST, F.col(c)) for c in ("doc_id", "source_id")}
    return _aligned(ready, k, least, similar, margin, block).withColumns(ids).distinct()  # chains may grow into the same passage
