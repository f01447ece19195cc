"""Token-ID output: fixed-width bit packing with block offsets.

A token store is a folder of two tables, written by Spark's own committer so that it works on any
file system and survives retried tasks:

``blocks``  one row per block of whole documents, sorted by (shard, block): ``shard``, ``block``,
            ``first`` (ids of the shard before it), ``n_ids``, ``width``, ``doc_ids`` and ``doc_ends``
            (end of each document within the block, in ids) and ``payload``, the ids at ``width`` bits
            each, least significant bit first.
``shards``  one row per shard: ``shard``, ``first`` (ids of all shards before it), ``n_ids``.

Shards hold ascending ranges of doc_id. A block never splits a document, so any document or id range
is read from the blocks whose offsets cover it, without the rest. Null doc_ids come first, null texts
count as empty, rows repeated under one doc_id are all kept (ordered by a hash of the text), and a document longer
than a block gets a block of its own. An empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path
from .tokens import encoder

BLOCKS = "shard int, block int, first long, n_ids long, width int, doc_ids array<long>, doc_ends array<long>, payload binary"


def bit_width(vocabulary: int) -> int:
    """Least bits that hold every id of a vocabulary of that size."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """``ids`` at ``width`` bits each, least significant bit first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids ends on a whole byte
        some = ids[at : at + (1 << 16)].astype(np.uint32)
        bits = (some[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from place ``start`` on, reading only the bytes that hold them."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    out = []
    for at in range(start, start + count, 1 << 16):
        n = min(1 << 16, start + count - at)
        low, high = at * width, (at + n) * width
        raw = np.frombuffer(payload, np.uint8, (high + 7) // 8 - low // 8, low // 8)
        bits = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + n * width].reshape(n, width)
        out.append(bits.astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32)))
    return np.concatenate(out).astype("<u4") if out else np.empty(0, "<u4")


def write_store(docs: DataFrame, path: str, vocabulary_file: str, end_id: int = 0, block_ids: int = 1 << 16) -> str:
    """Encode ``docs`` (doc_id, text) and write them as a token store in ascending doc_id order."""
    spark = docs.sparkSession

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(vocabulary_file), TaskContext.get().partitionId()
        width = bit_width(enc.vocabulary)
        held: list[tuple[int | None, np.ndarray]] = []
        block, first, size = 0, 0, 0

        def emit() -> pa.RecordBatch:
            ends = np.cumsum([len(x) for _, x in held])
            payload = pack_bits(np.concatenate([x for _, x in held]), width)
            row = {"shard": [shard], "block": [block], "first": [first], "n_ids": [size], "width": [width], "doc_ids": [[k for k, _ in held]], "doc_ends": [ends.tolist()], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, own in enc.batches(batch.column(1), end_id):
                for key, ids in zip(keys[at : at + len(own)], own, strict=True):
                    if held and size + len(ids) > block_ids:
                        yield emit()
                        block, first, size, held = block + 1, first + size, 0, []
                    held.append((key, ids))
                    size += len(ids)
        if held:
            yield emit()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(BLOCKS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    rows.mapInArrow(blocks, BLOCKS).write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    first, table = 0, []
    for r in sorted(sizes.collect()):  # a row for each written partition
        table.append((r["shard"], first, r["n_ids"]))
        first += r["n_ids"]
    spark.createDataFrame(table, "shard int, first long, n_ids long").coalesce(1).write.parquet(f"{path}/shards")
    return path


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.col("first").alias("shard_first"))
    # A row for each written partition: its size does not grow beyond the number of tasks.
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").join(F.broadcast(shards), "shard")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Each document of a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids. No shuffle."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch.column(n) for n in ("width", "n_ids", "first", "shard_first", "doc_ids", "doc_ends", "payload")}
            for k in range(batch.num_rows):
                payload, width, n = own["payload"][k].as_buffer(), own["width"][k].as_py(), own["n_ids"][k].as_py()
                ids, ends = unpack_bits(payload, width, 0, n), own["doc_ends"][k].values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                parts = [ids[a:b] for a, b in zip(starts, ends, strict=True)]
                out = {"doc_id": own["doc_ids"][k].values, "start": pa.array(starts + own["shard_first"][k].as_py() + own["first"][k].as_py()), "n_tokens": pa.array(ends - starts)}
                out["ids_crc32"] = pa.array([zlib.crc32(x) for x in parts], pa.int64())
                if with_ids:
                    out["ids"] = pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    return _with_starts(spark, path).mapInArrow(documents, schema)


def read_range(spark: SparkSession, path: str, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of the whole store; only the blocks that cover them are read."""
    at = F.col("shard_first") + F.col("first")
    rows = _with_starts(spark, path).where((at < start + count) & (at + F.col("n_ids") > start))
    out = []
    for r in rows.select(at.alias("at"), "n_ids", "width", "payload").orderBy("at").collect():
        low, high = max(start, r["at"]), min(start + count, r["at"] + r["n_ids"])
        out.append(unpack_bits(bytes(r["payload"]), r["width"], low - r["at"], high - low))
    return np.concatenate(out) if out else np.empty(0, "<u4")


def round_trip(docs: DataFrame, vocabulary_file: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as a store in the shared folder and read every document back from it."""
    path = write_store(docs, scratch_path(docs.sparkSession, "tokens"), vocabulary_file, end_id)
    return read_documents(docs.sparkSession, path)
