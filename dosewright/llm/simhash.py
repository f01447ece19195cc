"""SimHash near-dedup with an anchor-point covering.

Two fingerprints at 3 or fewer differing bits differ by at most 1 bit in one of their two 32-bit halves,
so a half is searched with threshold 1. The anchors of a half are the words of a covering code: the
[31, 26] Hamming code on its lower 31 bits, any value of the last bit. Its covering radius is 1. A
fingerprint's home is the anchor nearest to it, and it is also sent to every anchor within radius plus
threshold, 2 bits: 2 or 17 anchors. If x and y differ by one bit in that half, y lies within 2 bits of
the home of x, so each pair meets at the home of its smaller member, and is compared there on all 64
bits. There are 2^27 anchors for each half; equal fingerprints are one row, whatever their number.

Words and shingles: A to Z are lowered, words are runs of anything but ASCII white space, shingles are 3
words (all words if there are fewer; none: fingerprint 0, which links like any other). Before a document is dropped,
it is compared with the one that stays on shingles of five words. Null texts count
as empty. Rows with a null doc_id are fingerprinted and linked; a component's id is its smallest doc_id
that is not null, or null if it has none. Repeated rows each give a row. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written
from .components import components

SEED, THRESHOLD = 42, 3


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8, as a signed number."""
    import xxhash

    own = (text or b"").lower().split()
    if not own:
        return 0
    shingles = map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False)) if len(own) >= words else [b" ".join(own)]
    one = xxhash.xxh64_intdigest
    hashes = np.array([one(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        some = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, text hash t and fingerprint of every row of ``docs`` (doc_id, text); no shuffle."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                own = [fingerprint(t, words) for t in part.column(2).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.int64())], ["doc_id", "t", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), "text").mapInArrow(rows, "doc_id long, t long, fp long")


def _parity(half: Column, mask: int) -> Column:
    return F.bit_count(half.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))


def _syndrome(half: Column) -> Column:
    """Of the lower 31 bits under the Hamming code: 0 for a code word, else the bit (from 1) that is off."""
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)]
    out = _parity(half, masks[0])
    for k in range(1, 5):
        out = out.bitwiseOR(F.shiftleft(_parity(half, masks[k]), k))
    return out


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``fps`` (fp long, distinct) at 3 or fewer differing bits."""
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("half")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned("fp", 32).alias("half")),
    )
    own = fps.select("fp", F.inline(halves)).withColumn("off", _syndrome(F.col("half")))
    home = F.when(F.col("off") == 0, F.col("half")).otherwise(F.col("half").bitwiseXOR(_bit(F.col("off"))))
    own = own.withColumn("home", home)
    near = F.array("home", F.col("home").bitwiseXOR(F.lit(1 << 31)))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda p: p < p.bitwiseXOR(F.col("off")))
    far = F.transform(pairs, lambda p: F.col("half").bitwiseXOR(_bit(p)).bitwiseXOR(_bit(p.bitwiseXOR(F.col("off")))))
    sent = F.when(F.col("off") == 0, near).otherwise(F.concat(near, far))
    x = own.select("side", F.col("home").alias("anchor"), F.col("fp").alias("a"))
    y = own.select("side", F.explode(sent).alias("anchor"), F.col("fp").alias("b"))
    close = (F.col("x.side") == F.col("y.side")) & (F.col("x.anchor") == F.col("y.anchor")) & (F.col("a") < F.col("b"))
    close = close & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    return x.alias("x").join(y.alias("y"), close).select("a", "b")


def _rooted(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, fp) of every row of ``docs``, t the 64-bit hash of its text, and (fp, first, root) of every fingerprint."""
    marked = written(fingerprints(docs, words), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp")))
    known = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return marked, written(known, "roots")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    marked, known = _rooted(docs, words)
    # Small tables are written before they are joined, so that both sides are plain exchanges and a hot key's partition can be split.
    least = written(known.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = written(known.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def shingle_set(text: bytes | None, words: int) -> set[bytes]:
    """The different shingles of a text; fewer words: the whole sequence; none: the empty set."""
    own = (text or b"").lower().split()
    return {b" ".join(own[k : k + words]) for k in range(max(1, len(own) - words + 1))} if own else set()


def _alike(pairs: DataFrame, words: int, similar: float) -> DataFrame:
    """(t) of the rows of ``pairs`` (t, text, leader) whose shingle sets have a Jaccard similarity of ``similar`` or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, set()
        for batch in batches:
            out = []
            for t, text, leader in zip(*(batch.column(k) for k in range(3)), strict=True):
                leader = leader.as_py()
                if leader != known:
                    known, own = leader, shingle_set((leader or "").encode(), words)
                if jaccard(shingle_set((text.as_py() or "").encode(), words), own) >= similar:
                    out.append(t.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["t"])

    return pairs.mapInArrow(rows, "t long")


def one_of_each(docs: DataFrame, words: int = 5, similar: float = 0.8, digest: int = 3) -> DataFrame:
    """The rows of ``docs`` that are no copy or near copy of a row that stays; all columns are kept.

    Equal texts are one text, at its least doc_id (null last). Of each group of linked fingerprints the text with
    the least doc_id, then hash, leads; another text of the group goes if its shingles of ``words`` words have a Jaccard similarity of
    ``similar`` or more with the leader's, compared exactly, and stays if not. Fingerprints only choose whom to compare;
    shingles of ``digest`` words, which a changed word touches less, bring more near copies within their reach. Different texts under one doc_id or
    under null are different documents. Rows equal in doc_id and text are one document.
    """
    marked, known = _rooted(docs, digest)
    at = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    texts = written(marked.groupBy("t", "fp").agg(F.min(at).alias("at")), "texts")
    placed = written(texts.join(known, "fp").select("t", "at", "root"), "placed")
    leaders = placed.groupBy("root").agg(F.min(F.struct("at", "t")).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    leaders = written(leaders.select("root", F.col("lead.t").alias("lt"), F.col("lead.at").alias("lat")), "leaders")
    bodies = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), "text")

    def body(rows: DataFrame, hashed: str, place: str) -> DataFrame:
        """``rows`` with the text of the document at (``place``, ``hashed``), more than once if that row is repeated."""
        own = bodies.select(F.col("doc_id").alias("__d"), F.col("t").alias("__t"), F.col("text").alias("__x"))
        return rows.join(own, (F.col(hashed) == F.col("__t")) & F.col(f"{place}.doc_id").eqNullSafe(F.col("__d"))).drop("__d", "__t", place)

    followers = written(placed.join(leaders, "root").where("t <> lt").select("t", "at", "root"), "followers")
    own = body(followers, "t", "at").withColumnRenamed("__x", "text")
    lead = body(leaders, "lt", "lat").dropDuplicates(["root"]).select("root", F.col("__x").alias("leader"))
    gone = _alike(own.join(written(lead, "leading"), "root").select("t", "text", "leader"), words, similar)
    kept = written(texts.join(gone.distinct(), "t", "left_anti").select(F.col("at.doc_id").alias("__d"), F.col("t").alias("__t")), "kept")
    key, hashed, names = fresh(docs, "kept_id"), fresh(docs, "kept_text"), docs.columns
    kept = kept.select(F.col("__d").alias(key), F.col("__t").alias(f"{hashed}_"))
    rows = docs.withColumn(hashed, _text_hash())
    out = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(f"{hashed}_")), "left_semi")
    return out.dropDuplicates(["doc_id", hashed]).select(*names)
