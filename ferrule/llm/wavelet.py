"""Token ids in wavelet-matrix shard files.

Format of a shard file, little-endian:

======== =====================================================================
bytes    content
======== =====================================================================
8        magic ``FWM1`` and four zero bytes
4 × u64  n symbols, b bit planes, d documents, bits per block
d × i64  document ids (``-2**63`` for null)
d × u64  end of each document, in symbols from the shard's start
b × u64  zeros of each plane
b × ...  per plane: (blocks+1) × u64 ones before each block, then
         (blocks+1) × u64 offsets of the packed blocks in the payload
payload  blocks of one plane after the other, each a zstd frame or, where that
         is no shorter, the plain bits (its length tells which)
======== =====================================================================

The most significant plane comes first; each plane stably moves the symbols
with a 0 bit before those with a 1 bit.  ``access``, ``rank`` and ``select``
unpack one block a plane; ``decode`` unpacks all.

A shard is cut at the first document end past ``shard_tokens``, so a task holds
one shard's ids whatever the size of its partition.  Shards are written under a
temporary name and renamed, so a task that is lost and run again leaves one
whole file of the same name and content.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"FWM1\0\0\0\0"
BLOCK = 1 << 15
NO_ID = -(1 << 63)
END_ID = 1


def build(ids: np.ndarray, doc_ids: list[int | None], ends: list[int], bits: int = 16) -> bytes:
    """The file of one shard: its symbols in document order, document ids and ends."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    pack = zstandard.ZstdCompressor(level=1)
    seq, zeros, heads, payload, at = ids.astype(np.uint16 if bits <= 16 else np.uint32), [], [], [], 0
    for plane in range(bits - 1, -1, -1):
        bit = (seq & seq.dtype.type(1 << plane)) != 0
        raw = np.packbits(bit, bitorder="little").tobytes()
        ones, where = [0], [at]
        for k in range(blocks):
            part = raw[k * BLOCK // 8 : (k + 1) * BLOCK // 8]
            ones.append(ones[-1] + int(np.count_nonzero(bit[k * BLOCK : (k + 1) * BLOCK])))
            short = pack.compress(part)
            payload.append(short if len(short) < len(part) else part)
            at += len(payload[-1])
            where.append(at)
        heads.append(np.asarray(ones + where, "<u8").tobytes())
        zeros.append(n - ones[-1])
        seq = seq[_stable(bit)]
    head = MAGIC + struct.pack("<4Q", n, bits, len(doc_ids), BLOCK)
    names = np.asarray([NO_ID if x is None else x for x in doc_ids], "<i8").tobytes()
    return b"".join([head, names, np.asarray(ends, "<u8").tobytes(), np.asarray(zeros, "<u8").tobytes(), *heads, *payload])


def _stable(bit: np.ndarray) -> np.ndarray:
    """Places of the 0 bits, then of the 1 bits."""
    return np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])


class Shard:
    """Queries on one shard file held as bytes (or a memory map)."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a wavelet shard")
        self.n, self.bits, docs, self.block = struct.unpack_from("<4Q", data, 8)
        at = 40

        def take(count, kind="<u8"):
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += 8 * count
            return got

        self.doc_ids = [None if x == NO_ID else int(x) for x in take(docs, "<i8")]
        self.ends = take(docs)
        self.zeros = take(self.bits).astype(np.int64)
        blocks = -(-self.n // self.block)
        self.ones, self.where = [], []
        for _ in range(self.bits):
            self.ones.append(take(blocks + 1))
            self.where.append(take(blocks + 1))
        self.payload = memoryview(data)[at:]
        self.unpack = zstandard.ZstdDecompressor()

    def _block(self, plane: int, k: int) -> np.ndarray:
        raw = bytes(self.payload[int(self.where[plane][k]) : int(self.where[plane][k + 1])])
        size = min(self.block, self.n - k * self.block)
        if len(raw) < -(-size // 8):
            raw = self.unpack.decompress(raw, max_output_size=self.block // 8)
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=size)

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        k, rest = divmod(i, self.block)
        return int(self.ones[plane][k]) + (int(self._block(plane, k)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        got = 0
        for p in range(self.bits):
            bit = int(self._block(p, i // self.block)[i % self.block])
            one = self._rank1(p, i)
            i = int(self.zeros[p]) + one if bit else i - one
            got = got << 1 | bit
        return got

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._rank1(p, lo), self._rank1(p, hi)
            lo, hi = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if symbol >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of ``symbol`` in positions lo to hi, hi excluded."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def rank(self, symbol: int, i: int) -> int:
        return self.count(symbol, 0, i)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``symbol``."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for p in range(self.bits - 1, -1, -1):
            one = symbol >> (self.bits - 1 - p) & 1
            target = at - int(self.zeros[p]) if one else at
            ones = self.ones[p].astype(np.int64)
            before = ones if one else np.minimum(np.arange(len(ones)) * self.block, self.n) - ones
            b = int(np.searchsorted(before, target, "right")) - 1
            at = b * self.block + int(np.flatnonzero(self._block(p, b) == one)[target - int(before[b])])
        return at

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All symbols: planes are undone from the last to the first."""
        blocks = -(-self.n // self.block)
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            bit = np.concatenate([self._block(p, k) for k in range(blocks)] or [np.zeros(0, np.uint8)]).astype(bool)
            seq[int(self.zeros[p]) :] |= seq.dtype.type(1 << (self.bits - 1 - p))
            up = np.empty_like(seq)
            up[_stable(bit)] = seq
            seq = up
        return seq


def write_shards(docs: DataFrame, vocabulary: str, folder: str, shard_tokens: int = 2_000_000, end_id: int = END_ID) -> DataFrame:
    """Tokenise, range-partition by doc_id and write shard files; a row for each: ``path, part, shard, n_tokens``.

    Texts are tokenised before the shuffle, which then moves 16 bits a token.
    Runs at once (writing files is its purpose) and returns the bounded listing
    as a staged table.
    """

    def encode():
        words = common.word_ids(vocabulary)
        squeeze = zstandard.ZstdCompressor(level=1)

        def f(batch):
            ids, texts = (batch.column(i).to_pylist() for i in range(2))
            for begin, run in common.slices(texts):
                packed = [squeeze.compress(x.tobytes() + struct.pack("<H", end_id)) for x in words.encode(run)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin : begin + len(run)], pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "ids"])

        return f

    def pack(batches):
        from pyspark import TaskContext

        store, root = common.filesystem(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, shard = task.partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def flush():
            nonlocal shard, size
            data = build(np.concatenate(held), names, np.cumsum([len(x) for x in held]).tolist())
            path = f"{root}/{part:06d}-{shard:06d}.fwm"
            with store.open_output_stream(temp := f"{path}.{task.taskAttemptId()}.tmp") as out:
                out.write(data)
            store.move(temp, path)
            row = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([size], pa.int64())], ["path", "part", "shard", "n_tokens"])
            held.clear()
            names.clear()
            shard, size = shard + 1, 0
            return row

        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            for name, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(np.frombuffer(unpack.decompress(packed), "<u2"))
                names.append(name)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    ids = common.arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), encode, "doc_id long, ids binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # bounds from the id column alone: a range exchange would run the tokenizer once more to sample
    doc_id = F.col("doc_id").cast("long")
    cuts, known, null = docs.agg(F.percentile_approx(doc_id, [k / parts for k in range(1, parts + 1)]), F.count(doc_id), F.count(F.when(doc_id.isNull(), 1))).first()
    bounds = F.array(*[F.lit(int(c)).cast("long") for c in sorted(set((cuts or [])[:-1]))]).cast("array<bigint>")
    # rows without an id come last, in as many partitions more as their number asks for
    more = min(parts, -(-null * parts // max(known, parts)))
    place = F.when(F.col("doc_id").isNull(), parts + F.pmod(F.xxhash64("ids"), F.lit(max(1, more)))).otherwise(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))))
    ordered = ids.repartitionById(parts + more, place.cast("int")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "ids")
    files = common.stage(ordered.mapInArrow(pack, "path string, part long, shard long, n_tokens long"), "shards")
    return files


def read_shards(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    # where a shard starts: what the partitions before it hold (a row for each partition), and the shards before it in its own
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("from"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("own", F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).join(bases, "part").withColumn("base", (F.col("own") + F.col("from")).cast("long"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("path", "base").repartition(n)

    def scan():
        store, _ = common.filesystem(folder)

        def f(batch):
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(path) as file:
                    shard = Shard(file.read_buffer())
                ids, ends = shard.decode(), shard.ends.astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [common.ids_crc(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

        return f

    return common.arrow_map(placed, scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, spark: SparkSession | None = None) -> DataFrame:
    """Write ``docs`` as shard files in the shared folder and read them back.

    Null text is empty (the end id alone); rows with a null doc_id come last;
    equal doc_ids keep an order fixed by their content; no rows, no files.
    """
    folder = common.shared_dir(spark or docs.sparkSession, "wavelet")
    return read_shards(write_shards(docs, vocabulary, folder), folder)
