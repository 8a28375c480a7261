"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters that occurs in a document within k edits shares at
least m + 1 - q(k + 1) of its q-grams with one region of the document, on
diagonals at most k apart.  Documents stream past the items' q-grams:

1. every 8-byte gram of a document (as the 64-bit number it is) is looked up in
   a bitmap of the items' grams, and those that pass in the sorted gram table;
2. hits are counted in bands of diagonals that overlap by half, so that any k + 1
   neighbouring diagonals lie whole in one band;
3. bands that reach an item's bound are regions, and a banded alignment of item
   and region gives the edit distance, which decides.

Text is compared lower-cased with white-space runs as one space, in UTF-8 bytes;
an item of m bytes may differ by ``rate * m`` edits, an item under 2q bytes must
occur as it is.

The benchmark is a stated query set against all rows: it goes to the tasks in
blocks of bounded size (``block_bytes``), one pass over the documents a block.  A
benchmark of several blocks is met block after block: what a pass gives is staged
and its broadcast dropped before the next.

Defined cases: null or empty texts and items match nothing; equal item texts are
separate items; repeated doc_ids are judged row by row; nothing is capped: each
pair of document row and item within the budget gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 8
BITMAP_BITS = 22
SLICE = 1 << 20  # hits met at once
WIDEST = 1 << 16  # diagonals aligned at once
MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "surrogatepass")


def grams(data: bytes) -> np.ndarray:
    """The q-gram at each byte, as a number."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(n, np.uint64)
    for k in range(Q):  # eight interleaved views of the bytes as 64-bit words
        words = np.frombuffer(raw[k : k + (n - k + Q - 1) // Q * Q].tobytes(), "<u8") if n > k else np.zeros(0, np.uint64)
        out[k::Q] = words
    return out


class Items:
    """One block of the benchmark, ready to be looked up."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float):
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        size = np.array([len(t) for t in self.texts])
        self.budget = np.where(size >= 2 * Q, (rate * size).astype(int), 0)
        self.least = np.maximum(1, size + 1 - Q * (self.budget + 1))
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < Q]
        found = [grams(t) for t in self.texts]
        code = np.concatenate(found) if found else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(found)), [len(f) for f in found]) if found else np.zeros(0, np.int64)
        pos = np.concatenate([np.arange(len(f)) for f in found]) if found else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(code))
        self.item, self.pos = item[order].astype(np.int64), pos[order].astype(np.int64)
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[(self.codes * MIX) >> np.uint64(64 - BITMAP_BITS)] = True
        self.width = 1 << int(self.budget.max() if len(items) else 0).bit_length()  # a power of two over every budget
        self.longest = int(size.max()) if len(items) else 0

    def regions(self, data: bytes) -> list[tuple[int, int, int]]:
        """(item, lowest diagonal, highest) of each run of bands that reach the item's bound.

        Hits are met ``SLICE`` at a time and only their counts are held, at most one for each
        item and band, so that a text of one letter takes no more memory than any other.
        """
        code = grams(data)
        at = np.flatnonzero(self.bitmap[(code * MIX) >> np.uint64(64 - BITMAP_BITS)])
        if not len(at) or not len(self.codes):
            return []
        k = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        ok = self.codes[k] == code[at]
        at, k = at[ok], k[ok]
        ends = np.cumsum(self.first[k + 1] - self.first[k])
        total = int(ends[-1]) if len(ends) else 0
        span = (len(code) + 2 * self.longest) // self.width + 2  # bands
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(0, total, SLICE):
            # hit number h belongs to the first place whose end is past h
            lo, hi = np.searchsorted(ends, [begin, min(total, begin + SLICE) - 1], "right")
            who = np.arange(lo, hi + 1)
            some = np.minimum(ends[who], begin + SLICE) - np.maximum(ends[who] - (self.first[k[who] + 1] - self.first[k[who]]), begin)
            h = np.arange(begin, min(total, begin + SLICE))
            of = np.repeat(who, some)
            spot = self.first[k[of] + 1] - (ends[of] - h)
            band = (at[of] - self.pos[spot] + self.longest) // self.width  # the diagonal is never negative
            part, count = np.unique(self.item[spot] * span + band, return_counts=True)
            key, where = np.unique(np.concatenate([key, part]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, count]), len(key)).astype(np.int64)
        # band b covers diagonals b * width up to (b + 2) * width: its own hits and those of the next one
        item, band = key // span, key % span
        lower = key[band > 0] - 1
        key, where = np.unique(np.concatenate([key, lower]), return_inverse=True)
        n = np.bincount(where, np.concatenate([n, n[band > 0]]), len(key)).astype(np.int64)
        item, band = key // span, key % span
        ok = n >= self.least[item]
        item, band = item[ok], band[ok]
        out, most = [], max(4, WIDEST // self.width)  # bands that are neighbours are aligned together
        for i, b in zip(item.tolist(), band.tolist(), strict=True):
            low, high = b * self.width - self.longest, (b + 2) * self.width - self.longest
            if out and out[-1][0] == i and low <= out[-1][2] and high - out[-1][1] <= most * self.width:
                out[-1] = i, out[-1][1], high
            else:
                out.append((i, low, high))
        return out

    def aligned(self, item: int, low: int, high: int, data: bytes) -> tuple[int, int] | None:
        """(edits, end) of the item's best occurrence on diagonals from ``low`` to ``high``, if within its budget.

        A row of the alignment is one byte of the item, held for all diagonals at once.
        """
        text, k = self.texts[item], int(self.budget[item])
        left = low - k
        cols = high - low + 2 * k + 1
        begin, end = max(0, left), left + cols + len(text)
        window = data[begin : max(0, end)]
        if (found := window.find(text)) >= 0:
            return 0, begin + found + len(text)
        if not k:
            return None
        # column j of row i is the text's end at left + i + j; outside the text stands 256, which equals no byte
        # (to match it costs what leaving out the item's byte costs, so the distance stays right)
        w = np.full(end - left, 256, np.int16)
        w[begin - left : begin - left + len(window)] = np.frombuffer(window, np.uint8)
        ramp = np.arange(cols, dtype=np.int32)
        row = np.zeros(cols, np.int32)  # the occurrence may begin anywhere
        for i, c in enumerate(text):
            new = row + (w[i : i + cols] != c)
            new[:-1] = np.minimum(new[:-1], row[1:] + 1)
            row = np.minimum.accumulate(new - ramp) + ramp
            if row.min() > k:  # edits never become fewer
                return None
        best = int(row.argmin())
        return (int(row[best]), min(len(data), left + len(text) + best)) if row[best] <= k else None

    def matches(self, data: bytes) -> dict[int, tuple[int, int]]:
        """Item -> its best (edits, end) in one document."""
        out: dict[int, tuple[int, int]] = {}
        for k in self.short:
            if (at := data.find(self.texts[k])) >= 0:
                out[k] = 0, at + len(self.texts[k])
        for item, low, high in self.regions(data):
            if out.get(item, (1, 0))[0] and (got := self.aligned(item, low, high, data)):
                out[item] = min(out.get(item, got), got)
        return out


def blocks(benchmark: DataFrame, rate: float, block_bytes: int = 8_000_000) -> Iterator[Items]:
    """The benchmark ``(item_id, text)`` in blocks of at most about ``block_bytes`` of text."""
    held: list[tuple[int | None, bytes]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        text = normal(r.text)
        if not text:
            continue
        if held and size + len(text) > block_bytes:
            yield Items(held, rate)
            held, size = [], 0
        held.append((r.item_id, text))
        size += len(text)
    if held:
        yield Items(held, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """``doc_id, item_id, edits, end_byte``: documents that hold an item within its edit budget."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, edits int, end_byte long"

    def search(shared):
        def make():
            def f(batch):
                items, got = shared.value, []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got += [(doc, items.ids[k], *v) for k, v in items.matches(normal(text)).items()]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "end_byte"])

            return f

        return common.arrow_map(rows, make, schema)

    out = None
    for shared, several in _broadcasts(docs.sparkSession, blocks(benchmark, rate)):
        part = search(shared)
        if several:
            part = common.stage(part, "benchmark-block")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08) -> DataFrame:
    """The rows of ``docs`` that hold no item; a map pass for each block, no join."""
    at, schema = docs.columns.index("text"), docs.schema

    def keep(shared):
        def make():
            def f(batch):
                yield batch.filter(pa.array([not shared.value.matches(normal(t)) for t in batch.column(at).to_pylist()], pa.bool_()))

            return f

        return make

    for shared, several in _broadcasts(docs.sparkSession, blocks(benchmark, rate)):
        docs = common.arrow_map(docs, keep(shared), schema)
        if several:
            docs = common.stage(docs, "benchmark-block")
            shared.unpersist()
    return docs


def _broadcasts(spark, items: Iterator[Items]) -> Iterator[tuple]:
    """Each block as a broadcast, and whether there are several."""
    block, several = next(items, None), False
    while block is not None:
        shared, block = spark.sparkContext.broadcast(block), next(items, None)
        several = several or block is not None
        yield shared, several
