"""Hierarchical multi-length packing of token ids into training sequences.

Tiers are context sizes, each half the next (256, 512, 1024, 2048).  A document
is routed by length: whole windows of the longest tier are cut off, and what is
left belongs to the smallest tier it fits.  Packing goes from the longest tier
down: an item opens a window of its own tier's size, and the gap is closed with
the longest items of its own tier and then of shorter ones that still fit
(best fit, decreasing); what no whole item closes, a cut of a short item does.
The last items of a task, less than one window in all, are cut into windows
whose sizes are powers of two, so that none is padded.

Windows of one tier then form step groups of ``step`` windows.  Attention costs
the square of each piece's length, so windows are dealt to the groups of their
flush by longest-processing-time first.

A task packs its own rows as they stream by, in pools of ``pool_tokens``; there
is no shuffle, and no row waits for another task.  Window numbers are
``task << 32 | running number`` and do not repeat.

Defined cases: null and empty text are the end id alone; repeated doc_ids are
separate documents; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The smallest context size that holds ``length`` tokens."""
    return next(t for t in tiers if length <= t)


def fill(items: list[tuple[int, int, int]], tiers: tuple[int, ...], last: bool) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Windows, each a list of (document, start, length), and the items kept for the next pool.

    Every window holds exactly the tokens of the tier that its first item belongs to, or, for the last items, a power of two.
    """
    most = tiers[-1]
    by: dict[int, list[tuple[int, int, int]]] = {}
    for it in items:
        by.setdefault(it[2], []).append(it)
    lengths = sorted(by)
    total = sum(it[2] for it in items)
    windows = []

    def take(limit: int):
        k = bisect_right(lengths, limit)
        if not k:
            return None
        size = lengths[k - 1]
        it = by[size].pop()
        if not by[size]:
            del by[size], lengths[k - 1]
        return it

    def put(it):
        if it[2] not in by:
            lengths.insert(bisect_right(lengths, it[2]), it[2])
        by.setdefault(it[2], []).append(it)

    def window(size: int):
        nonlocal total
        got, gap = [], size
        while gap:
            if (it := take(gap)) is None:  # nothing fits whole: cut the shortest
                doc, start, n = it = by[lengths[0]][-1]
                take(n)
                it, rest = (doc, start, gap), (doc, start + gap, n - gap)
                put(rest)
            got.append(it)
            gap -= it[2]
        total -= size
        return got

    for tier, below in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while total >= tier and lengths[-1] > below:
            windows.append(window(tier))
        if total and lengths[-1] > below:  # less than a window is left; it waits for the next pool
            break
    if last:
        size = most
        while total:
            while size > total:
                size //= 2
            windows.append(window(size))
    return windows, [it for group in by.values() for it in group]


def step_groups(costs: list[int], step: int) -> list[int]:
    """A group number for each window: longest-processing-time first into groups of at most ``step``."""
    n = -(-len(costs) // step)
    heap = [(0, g, 0) for g in range(n)]
    out = [0] * len(costs)
    for k in sorted(range(len(costs)), key=lambda k: -costs[k]):
        load, g, used = heapq.heappop(heap)
        out[k] = g
        if used + 1 < step:
            heapq.heappush(heap, (load + costs[k], g, used + 1))
    return out


def pack(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = (256, 512, 1024, 2048), end_id: int = 1, step: int = 8, pool_tokens: int = 1_000_000) -> DataFrame:
    """One row for each piece of a document; :data:`COLUMNS`."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers are ascending powers of two")
    most = tiers[-1]

    def run(batches):
        from pyspark import TaskContext

        words = common.word_ids(vocabulary)
        base = TaskContext.get().partitionId() << 32
        docs_of: dict[int, tuple[int | None, np.ndarray]] = {}  # texts of which a piece is not out yet
        waiting: list[tuple[int, int, int]] = []
        size = serial = sequence = group = 0

        def flush(last: bool):
            nonlocal waiting, size, sequence, group
            windows, waiting = fill(waiting, tiers, last)
            rows = [[] for _ in COLUMNS]
            by_tier: dict[int, list[int]] = {}
            for k, w in enumerate(windows):
                by_tier.setdefault(tier_of(sum(n for _, _, n in w), tiers), []).append(k)
            placed: dict[int, tuple[int, int]] = {}
            for tier, ks in by_tier.items():
                for k, g in zip(ks, gs := step_groups([sum(n * n for _, _, n in windows[k]) for k in ks], step), strict=True):
                    placed[k] = tier, base | group + g
                group += max(gs) + 1
            for k, w in enumerate(windows):
                at = 0
                for doc, start, n in w:
                    doc_id, ids = docs_of[doc]
                    for c, v in zip(rows, (doc_id, start, n, common.ids_crc(ids[start : start + n]), len(ids), base | sequence, at, *placed[k]), strict=True):
                        c.append(v)
                    at += n
                sequence += 1
            left = {doc for doc, _, _ in waiting}
            for doc in [d for d in docs_of if d not in left]:
                del docs_of[doc]
            size = sum(n for _, _, n in waiting)
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], COLUMNS)

        for b in (x for whole in batches for x in common.small(whole)):
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for begin, part in common.slices(texts):
                for k, ids in enumerate(words.encode(part)):
                    ids = np.append(ids, np.uint16(end_id))
                    docs_of[serial] = names[begin + k], ids
                    cut = len(ids) // most * most
                    waiting += [(serial, s, most) for s in range(0, cut, most)]
                    if cut < len(ids):
                        waiting.append((serial, cut, len(ids) - cut))
                    serial += 1
                    size += len(ids)
                    if size >= pool_tokens:
                        yield flush(False)
        if waiting:
            yield flush(True)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
