"""Token-id files with Elias-Fano document boundaries.

Documents are range-partitioned by id and sorted; each partition (a shard)
writes blocks. A block is one byte string:

    magic, n_docs, n_ids, id width, rows without id, least id,
    sizes of the two sequences below
    Elias-Fano sequence of the n_docs + 1 boundaries (0 .. n_ids)
    Elias-Fano sequence of the document ids, less the least
    the concatenated ids, 2 or 4 bytes each, little-endian

A sequence of n values up to u takes about 2 + log2(u / n) bits a value: the
low bits are packed, the high bits are unary, and the place of every 64th one
is kept so that ``select`` reads any value without decoding the others. Blocks
lie in a Parquet table (shard, block, ids before it in the shard, ...), so any
store that Spark reaches will do; the manifest has one row per shard.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import frees, steps
from marquee.llm.tokens import encoder
from marquee.session import ship_package

MAGIC = b"MQTB"
#: Ids of a block, at which it closes (a longer document has its own block).
BLOCK_IDS = 1 << 20
SAMPLE = 64
_EF, _HEAD = struct.Struct("<QBQQ"), struct.Struct("<4sQQBQqQQ")


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned integers."""
    v = np.asarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return _EF.pack(0, 0, 0, 0)
    low = max(0, (int(v[-1]) // n).bit_length() - 1)
    bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    return _EF.pack(n, low, len(lows), len(highs)) + lows + highs + ones[::SAMPLE].astype("<u4").tobytes()


def _ef_parts(data: bytes):
    n, low, nl, nh = _EF.unpack_from(data)
    at = _EF.size
    return n, low, data[at:at + nl], data[at + nl:at + nl + nh], data[at + nl + nh:]


def _low_value(lows: bytes, low: int, i: int) -> int:
    a, b = i * low, (i + 1) * low
    whole = int.from_bytes(lows[a // 8:(b + 7) // 8], "little")
    return (whole >> (a % 8)) & ((1 << low) - 1)


def ef_decode(data: bytes) -> np.ndarray:
    n, low, lows, highs, _ = _ef_parts(data)
    if not n:
        return np.empty(0, np.uint64)
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(highs, np.uint8), bitorder="little"))[:n]
    out = (ones - np.arange(n)).astype(np.uint64) << np.uint64(low)
    if low:
        bits = np.unpackbits(np.frombuffer(lows, np.uint8), bitorder="little")[:n * low].reshape(n, low)
        out |= (bits.astype(np.uint64) << np.arange(low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def ef_select(data: bytes, i: int) -> int:
    """Value ``i`` alone: from the sampled one before it, over at most 63 more."""
    n, low, lows, highs, samples = _ef_parts(data)
    if not 0 <= i < n:
        raise IndexError(i)
    at = struct.unpack_from("<I", samples, i // SAMPLE * 4)[0]
    need = i % SAMPLE
    byte, word = at // 8, highs[at // 8] >> (at % 8) << (at % 8)
    while need >= word.bit_count():
        need -= word.bit_count()
        byte += 1
        word = highs[byte]
    for _ in range(need):
        word &= word - 1
    at = byte * 8 + (word & -word).bit_length() - 1
    return (at - i) << low | _low_value(lows, low, i)


def encode_block(doc_ids: list, ends: list[int], ids: bytes, width: int) -> bytes:
    """``ends``: ids up to and with each document; ids without a value first."""
    real = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(real[0]) if len(real) else 0
    edges = ef_encode(np.array([0, *ends], np.uint64))
    keys = ef_encode(real.astype(np.uint64) - np.uint64(least % (1 << 64)))
    head = _HEAD.pack(MAGIC, len(doc_ids), ends[-1] if ends else 0, width, len(doc_ids) - len(real), least,
                      len(edges), len(keys))
    return head + edges + keys + ids


class Block:
    """A block read back; ``bounds(i)`` uses select alone."""

    def __init__(self, data: bytes):
        magic, self.n_docs, self.n_ids, self.width, self.no_id, self.least, ne, nk = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at, view = _HEAD.size, memoryview(data)
        # Views: a select copies nothing, however many documents a block has.
        self.edges, self.keys = view[at:at + ne], view[at + ne:at + ne + nk]
        self.ids = np.frombuffer(data, "<u2" if self.width == 2 else "<u4", self.n_ids, at + ne + nk)

    def bounds(self, i: int) -> tuple[int, int]:
        return ef_select(self.edges, i), ef_select(self.edges, i + 1)

    def doc_ids(self) -> list:
        keys = (ef_decode(self.keys) + np.uint64(self.least % (1 << 64))).astype(np.int64)
        return [None] * self.no_id + keys.tolist()

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.ids[lo:hi]


def _write(path: str, end_id: int, block_ids: int):
    def run(batches):
        from array import array

        from pyspark import TaskContext
        enc, shard = encoder(path), TaskContext.get().partitionId()
        end = array(enc.code, [end_id]).tobytes()
        docs, ends, ids, before, block = [], [], [], 0, 0
        total = 0

        def close():
            data = encode_block(docs, ends, b"".join(ids), enc.width)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in ((shard, pa.int32()), (block, pa.int32()), (before, pa.int64()),
                                               (len(docs), pa.int64()), (total, pa.int64()), (data, pa.binary()))],
                names=["shard", "block", "before", "n_docs", "n_ids", "data"])
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in steps(texts):
                for d, own in zip(names[lo:hi], enc.encode(texts[lo:hi])):
                    own += end
                    total += len(own) // enc.width
                    docs.append(d)
                    ids.append(own)
                    ends.append(total)
                    if total >= block_ids:
                        yield close()
                        before, block = before + total, block + 1
                        docs, ends, ids, total = [], [], [], 0
        if docs:
            yield close()
    return frees(run)


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file ``path`` and write
    blocks and manifest under ``out``, in ascending doc_id order (rows without
    an id first, ties by text). Null text counts as empty and is only its end
    id; an empty table gives an empty table of blocks."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Ranges may part rows of one id by how their texts begin; the order is by whole texts.
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_write(path, end_id, block_ids),
                    "shard int, block int, before long, n_docs long, n_ids long, data binary").write.parquet(f"{out}/blocks")
    # One row per shard, however many documents: the prefix sums fit the driver.
    sizes = spark.read.parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, start = [], 0
    for r in sizes:
        base.append((r["shard"], start))
        start += r["n"]
    spark.createDataFrame(base, "shard int, base long").coalesce(1).write.parquet(f"{out}/manifest")


@frees
def _read(batches):
    for b in batches:
        docs, starts, sizes, sums = [], [], [], []
        for base, data in zip(b.column("base").to_pylist(), b.column("data")):
            x = Block(data.as_py())
            docs += x.doc_ids()
            for lo, hi in map(x.bounds, range(x.n_docs)):
                starts.append(lo + base)
                sizes.append(hi - lo)
                sums.append(zlib.crc32(x.ids[lo:hi].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (docs, starts, sizes, sums)],
                                         names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """What the files say of each document: ``doc_id, start`` (ids before it in
    the whole corpus), ``n_tokens`` (with the end id), ``ids_crc32``."""
    ship_package(spark)
    blocks = spark.read.parquet(f"{out}/blocks")
    manifest = spark.read.parquet(f"{out}/manifest")
    based = blocks.join(F.broadcast(manifest), "shard").select((F.col("base") + F.col("before")).alias("base"), "data")
    return based.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
