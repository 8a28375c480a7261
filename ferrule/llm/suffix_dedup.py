"""Repeated byte strings, by column-wise Burrows-Wheeler transforms of many short documents.

A window is any string of ``K`` = 100 bytes inside one document.  Its anchor is
the 32-byte string in it with the least hash (the leftmost of equal ones), so
equal windows have equal anchors.  Neighbouring windows with the same anchor
occurrence form a run (at most 69 windows, 168 bytes); all windows of a run
differ.  Runs are what is compared, and only with runs of the same anchor:

1. Map tasks find the runs and send, for each, the hash of its anchor, 128 bits of
   its bytes' SHA-256, and its place.  Of equal runs a task sends the first two as
   they are; the others are noted as removed, as what the first two say goes for them.
2. By anchor hash, a run whose anchor occurs once is done with.  Of each content the
   first two places are kept for 3; further ones are removed whole, as the second is.
3. A second scan cuts out the bytes of those, and sends them by anchor hash.
4. Each task builds collections of them (:class:`Columns`): every round inserts
   one symbol a document, from the last to the first, into the collection's transform,
   and updates the common-prefix lengths next to it, both held in sequential
   files that each round reads and writes anew.  A symbol is ten bytes, and a run
   makes ten documents, cut into symbols from each of its last ten bytes on, so that
   every window begins with a symbol of one of them and rounds are at most 16.
   Suffixes with common prefixes of 10 symbols (100 bytes) are equal windows; all but
   the earliest are removed.  So the transform decides each content that occurs twice,
   and each window that different contents share.
5. A last scan turns removed windows into bytes.

An anchor with more than ``crowd`` contents (a passage in very many settings)
is compared window by window, each under the hash of its own 100 bytes.

Texts are never shuffled.  Notes for a document go back to the scan task that
reads it, as staged tables sorted by that task's number.  The files of
:class:`Columns` lie in the shared folder, under names of their own for each
collection and attempt, and are deleted when their step is done.

Order is (doc_id, row, start), null doc_ids last; null text is empty; texts under
100 bytes have no windows; rows with equal doc_id are separate documents.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K, ANCHOR = 100, 32
SPAN = K - ANCHOR + 1  # anchor places in a window
CHUNK = 1 << 19
RUN = np.dtype([("anchor", "<u8"), ("content", "<u8"), ("more", "<u8"), ("doc_id", "<i8"), ("row", "<i8"), ("start", "<i8"), ("n", "<i4")])
SPOT = np.dtype([("row", "<i8"), ("start", "<i8"), ("n", "<i4")])
WANT = np.dtype([("anchor", "<u8"), ("row", "<i8"), ("start", "<i8"), ("n", "<i4"), ("crowded", "?")])
NO_ID = (1 << 63) - 1
BLOBS = "place int, kind int, src int, data binary"


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place."""
    from .decontaminate import grams

    g = grams(data.tobytes())
    n = len(data) - ANCHOR + 1
    h = np.zeros(max(0, n), np.uint64)
    for k in range(0, ANCHOR, 8):
        h ^= g[k : k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each ``w`` neighbours, from running minima over blocks of ``w``."""
    n = len(x) - w + 1
    size = -(-len(x) // w) * w
    pad = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    left = np.minimum.accumulate(pad.reshape(-1, w), axis=1).ravel()
    right = np.minimum.accumulate(pad.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each run of a document."""
    out = []
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw) - K + 1, CHUNK):
        part = raw[at : at + CHUNK + K - 1]
        h = anchor_hashes(part)
        low = np.uint64((1 << 20) - 1)
        best = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), SPAN)
        edge = np.flatnonzero(np.diff(best)) + 1
        start = np.concatenate([[0], edge])
        place = (best[start] & low).astype(np.int64)
        out.append((h[place], start + at, np.diff(np.append(start, len(best)))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def spread(anchor: np.ndarray, parts: int) -> np.ndarray:
    return ((anchor >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def in_order(r: np.ndarray) -> np.ndarray:
    """Runs by anchor and content, and those of one content by their place."""
    return np.lexsort((r["start"], r["row"], r["doc_id"], r["more"], r["content"], r["anchor"]))


def third(r: np.ndarray) -> np.ndarray:
    """Which of ordered runs have two or more of the same anchor and content before them."""
    out = np.zeros(len(r), bool)
    out[2:] = (r["anchor"][2:] == r["anchor"][:-2]) & (r["content"][2:] == r["content"][:-2]) & (r["more"][2:] == r["more"][:-2])
    return out


def blobs(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    place, kind, src, data = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(kind, pa.int32()), pa.array(src, pa.int32()), pa.array(data, pa.binary())], ["place", "kind", "src", "data"])


def by_source(records: np.ndarray, parts: int, kind: int):
    """Rows that bring records back to the scan tasks of their documents; a task's number is in the row key."""
    src = records["row"] >> 33
    order = np.argsort(src, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(src[order])) + 1) if len(order) else []:
        s = int(src[group[0]])
        yield s % parts, kind, s, records[group].tobytes()


def by_symbol(x: np.ndarray) -> np.ndarray:
    """The stable order of symbols, by 16 bits at a time: numpy sorts no wider integers by radix."""
    if x.itemsize <= 2:
        return np.argsort(x, kind="stable")
    low = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((x >> 16).astype(np.uint16)[low], kind="stable")]


class Columns:
    """Transform and common-prefix lengths of a collection, built column by column.

    ``texts`` are byte strings.  A symbol is ``width`` bytes.  The documents of the
    collection are the texts cut into symbols from the last byte but 0, 1, ...,
    ``width`` - 1 on, so that each place of a text begins a suffix of one of them;
    document ``width * text + skipped``.  Wide symbols make as many rows in fewer
    rounds.  Single bytes are symbols by their value plus 1, wider ones by a
    number that the collection gives them; 0 is none.

    After round j the collection holds all suffixes of up to j symbols (in round 0
    the empty ones, in the order of the documents).  A round needs the last one's
    transform and lengths and one symbol a document; the new suffix's place follows
    from its symbol's rank in the transform, and its common prefixes from the least
    length on the way to the symbol's neighbours there.  Lengths count symbols and
    are held up to 255.
    """

    def __init__(self, texts: list[bytes], folder: str, width: int = 1):
        length = np.array([len(t) for t in texts], np.int64)
        last = ((np.cumsum(length))[:, None] - np.arange(width)).ravel()  # where a document's last symbol ends
        self.size = (np.maximum(length[:, None] - np.arange(width), 0) // width).ravel()
        m, longest = len(self.size), int(self.size.max(initial=0))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        live = self.size > np.arange(longest)[:, None]
        at = (last - width * (np.arange(longest)[:, None] + 1))[live]
        symbols = np.zeros(len(at), np.int64)
        for k in range(width):
            symbols = symbols << 8 | flat[at + k]
            if width > 1 and (k == width - 1 or k % 4 == 3):  # numbers of what the bytes so far are, below 2**31
                symbols = pd.factorize(symbols)[0]
        most = int(symbols.max(initial=0))
        # UTF-8 has no byte 255, so that 8 bits, which sort twice as fast, do for single bytes of text
        self.kind = np.uint8 if most < 0xFF else np.uint16 if most < 0xFFFF else np.uint32
        grid = np.zeros((longest, m), self.kind)  # row j: the symbol before the suffix of j symbols
        grid[live] = symbols + 1
        self.store, root = common.filesystem(folder)
        self.store.create_dir(root, recursive=True)
        self.name, self.generation = f"{root}/{uuid.uuid4().hex}", 0
        self.place = np.arange(m)  # of each document's longest suffix so far
        self._write(grid[0] if longest else np.zeros(m, self.kind), np.zeros(m, np.uint8))
        for j in range(1, longest + 1):
            self._round(grid[j] if j < longest else np.zeros(m, self.kind), live[j - 1])

    def _paths(self) -> list[str]:
        return [f"{self.name}-{self.generation}.{kind}" for kind in ("bwt", "lcp")]

    def _write(self, bwt: np.ndarray, lcp: np.ndarray) -> None:
        """The next generation of both files; the last one goes."""
        old = self._paths() if self.generation else []
        self.generation += 1
        for path, x in zip(self._paths(), (bwt, lcp), strict=True):
            with self.store.open_output_stream(path, buffer_size=0) as f:
                f.write(pa.py_buffer(x))
        for path in old:
            self.store.delete_file(path)

    def read(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for path, kind in zip(self._paths(), (self.kind, np.uint8), strict=True):
            with self.store.open_input_stream(path) as f:
                out.append(np.frombuffer(f.read(), kind))
        return tuple(out)

    def close(self) -> None:
        for path in self._paths():
            self.store.delete_file(path)

    def _round(self, before: np.ndarray, live: np.ndarray) -> None:
        """Insert, for each live document, the suffix one symbol longer; ``before``: the symbol in front of it."""
        bwt, lcp = self.read()
        n = len(bwt)
        # rows by (symbol, row): the rank of a row there is the place of its suffix with the symbol in front,
        # once all that are to come are in; rows with no symbol (0) lead to none
        order = by_symbol(bwt)
        none = n - int(np.count_nonzero(bwt))
        whose = np.full(n, -1, np.int32)  # the documents that go on at these rows
        whose[self.place[live]] = np.flatnonzero(live)
        r = np.flatnonzero((whose >= 0)[order])  # ranks of the documents' rows, ascending
        old = order[r]
        who = whose[old]
        at = r - none + len(self.size)  # place after this round; the empty suffixes stay in front
        # common prefixes with the neighbours that start with the same symbol
        symbol = bwt[old]
        up, down = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
        same_up = (r > 0) & (bwt[up] == symbol)
        same_down = (r + 1 < n) & (bwt[down] == symbol)
        least = Minima(lcp)
        with_up, with_down = np.zeros(len(r), np.uint8), np.zeros(len(r), np.uint8)
        with_up[same_up] = np.minimum(254, least(up[same_up] + 1, old[same_up])) + 1
        with_down[same_down] = np.minimum(254, least(old[same_down] + 1, down[same_down])) + 1
        total = n + len(who)
        stay = np.ones(total, bool)
        stay[at] = False
        new_bwt, new_lcp = np.empty(total, self.kind), np.empty(total, np.uint8)
        new_bwt[stay], new_lcp[stay] = bwt, lcp
        new_bwt[at], new_lcp[at] = before[who], with_up
        # the row after an inserted one: its prefix in common with it (inserted rows know their own)
        after = at + 1
        ok = after < total
        ok[ok] &= stay[after[ok]]
        new_lcp[after[ok]] = with_down[ok]
        self.place[who] = at
        self._write(new_bwt, new_lcp)


class Minima:
    """Least value of ranges: tables of all ranges of 1, 2, 4, ..., 32 values, and of 1, 2, 4, ... blocks of 32."""

    LEVELS, B = 6, 32

    def __init__(self, x: np.ndarray):
        self.near = self._table(x, self.LEVELS)
        blocks = self.near[-1][:: self.B][: len(x) // self.B]
        self.far = self._table(blocks, max(1, len(blocks).bit_length()))

    @staticmethod
    def _table(x: np.ndarray, levels: int) -> np.ndarray:
        """Row v: the least of the 2**v values from each place; at the end, of those there are."""
        out = np.empty((levels, len(x)), x.dtype)
        out[0] = x
        for v in range(1, levels):
            out[v] = out[v - 1]
            half = 1 << (v - 1)
            if half < len(x):
                np.minimum(out[v - 1, :-half], out[v - 1, half:], out=out[v, :-half])
        return out

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of positions lo to hi, both included."""
        length = hi - lo + 1
        v = np.minimum(np.frexp(length)[1] - 1, self.LEVELS - 1)
        flat, n = self.near.ravel(), self.near.shape[1]
        got = np.minimum(flat[v * n + lo], flat[v * n + hi + 1 - (1 << v)])
        long = np.flatnonzero(length > 2 * self.B)
        a, b = lo[long] // self.B + 1, hi[long] // self.B  # whole blocks a to b - 1
        v = np.frexp(b - a)[1] - 1
        got[long] = np.minimum(got[long], np.minimum(self.far[v, a], self.far[v, b - (1 << v)]))
        return got


def windows(texts: list[bytes], folder: str, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, starts and group numbers of strings of ``k`` bytes that occur more than once; equal ones share the number."""
    width = next(w for w in (10, 5, 4, 2, 1) if k % w == 0)
    c = Columns(texts, folder, width)
    bwt, lcp = c.read()
    c.close()
    n, heads = len(bwt), len(c.size)
    order = by_symbol(bwt)
    none = n - int(np.count_nonzero(bwt))
    # place -> (document, symbols): walk from each document's empty suffix to its whole
    document, symbols = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - none + heads
    who, at = np.arange(heads), np.arange(heads)
    for j in range(int(c.size.max(initial=0)) + 1):
        document[at], symbols[at] = who, j
        go = c.size[who] > j
        who, at = who[go], rank[at[go]]
    joined = lcp >= k // width  # with the row before
    group = np.cumsum(~joined)
    rows = np.flatnonzero(symbols >= k // width)
    if not len(rows):
        return rows, rows, rows
    g = group[rows]
    same = g[1:] == g[:-1]
    rows, g = (x[np.append(False, same) | np.append(same, False)] for x in (rows, g))
    text, skipped = np.divmod(document[rows], width)
    length = np.array([len(t) for t in texts], np.int64)
    return text, length[text] - skipped - width * symbols[rows], g


def later(texts: list[bytes], folder: str, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, how many) of the neighbouring strings that are not the first of their group, in the order of text and start."""
    text, start, group = windows(texts, folder, k)
    order = np.lexsort((start, text, group))
    again = np.append(False, group[order][1:] == group[order][:-1])[: len(order)]
    keep = order[again]
    keep = keep[np.lexsort((start[keep], text[keep]))]
    text, start = text[keep], start[keep]
    new = np.append(True, (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1))[: len(text)]
    first = np.flatnonzero(new)
    return text[first], start[first], np.diff(np.append(first, len(text)))


def _notes(folder: str, src: int, parts: int, kind: int) -> list[bytes]:
    """A scan task's notes of a kind from a shelved table."""
    out = []
    for b in common.read_part(folder, src % parts, ["kind", "src", "data"]):
        out += [d for k, s, d in zip(*(c.to_pylist() for c in b.columns), strict=True) if k == kind and s == src]
    return out


def _shelve(rows: DataFrame, parts: int, name: str) -> str:
    """Stage notes by source task; the folder."""
    folder = common.shared_dir(rows.sparkSession, name)
    rows.repartitionById(parts, F.pmod("src", F.lit(parts)).cast("int")).sortWithinPartitions("src").write.parquet(folder)
    return folder


DUP, WANTED, RUNS = 1, 2, 3


def removed(docs: DataFrame, crowd: int = 4096, collection: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.with_row(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = common.shared_dir(spark, "columns")

    def find(batches):
        held: list[np.ndarray] = []
        count = 0

        def flush():
            nonlocal count
            r = np.concatenate(held)
            held.clear()
            count = 0
            r = r[in_order(r)]
            again = third(r)
            dup = np.zeros(int(again.sum()), SPOT)
            for f in SPOT.names:
                dup[f] = r[f][again]
            out = list(by_source(dup, parts, DUP))
            first = r[~again]
            place = spread(first["anchor"], parts)
            order = np.argsort(place, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
                out.append((int(place[g[0]]), RUNS, -1, first[g].tobytes()))
            return blobs(out)

        for b in batches:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < K:
                    continue
                anchor, start, n = runs(raw)
                r = np.zeros(len(anchor), RUN)
                r["anchor"], r["start"], r["n"], r["row"], r["doc_id"] = anchor, start, n, row, NO_ID if doc_id is None else doc_id
                digest = b"".join([hashlib.sha256(raw[a:e]).digest()[:16] for a, e in zip(start.tolist(), (start + n + K - 1).tolist(), strict=True)])
                r["content"], r["more"] = np.frombuffer(digest, "<u8").reshape(-1, 2).T
                held.append(r)
                count += len(r)
                if count >= 500_000:
                    yield flush()
        if held:
            yield flush()

    def match(batches):
        held, out = [], []
        for b in batches:
            for kind, src, data in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if kind == RUNS:
                    held.append(np.frombuffer(data, RUN))
                else:
                    out.append((0, kind, src, data))
        if held:
            r = np.concatenate(held)
            held.clear()
            r = r[in_order(r)]
            again = third(r)
            dup = np.zeros(int(again.sum()), SPOT)
            for f in SPOT.names:
                dup[f] = r[f][again]
            out += by_source(dup, 1, DUP)
            r = r[~again]
            group = np.cumsum(np.append(True, r["anchor"][1:] != r["anchor"][:-1])) - 1
            many = np.bincount(group)[group]
            want = np.zeros(int((many > 1).sum()), WANT)
            for f in ("anchor", "row", "start", "n"):
                want[f] = r[f][many > 1]
            want["crowded"] = many[many > 1] > 2 * crowd
            out += by_source(want, 1, WANTED)
        if out:
            yield blobs(out)

    found = rows.mapInArrow(find, BLOBS).repartitionById(parts, F.col("place")).mapInArrow(match, BLOBS)
    first = _shelve(found, parts, "repeats")

    def cut(batches):
        from pyspark import TaskContext

        src = TaskContext.get().partitionId()
        want = np.concatenate([np.zeros(0, WANT), *(np.frombuffer(x, WANT) for x in _notes(first, src, parts, WANTED))])
        want = want[np.argsort(want["row"], kind="stable")]
        rows_of = np.ascontiguousarray(want["row"])
        heads = np.zeros(len(want), RUN_HEAD)
        for f in ("anchor", "n", "row", "start"):
            heads[f] = want[f]
        place, crowded = spread(want["anchor"], parts), want["crowded"].copy()
        used, size = 0, RUN_HEAD.itemsize
        for b in batches:
            out: dict[int, list[bytes]] = {}

            def send(anchor, doc_id, row, start, n, raw, out=out):
                head = np.array([(anchor, n, doc_id, row, start, 0)], RUN_HEAD).tobytes()
                out.setdefault(int(spread(np.array([anchor], np.uint64), parts)[0]), []).append(head + raw)

            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                lo, hi = np.searchsorted(rows_of, [row, row + 1])
                if lo == hi:
                    continue
                used += hi - lo
                raw = text.encode("utf-8", "surrogatepass")
                key = NO_ID if doc_id is None else doc_id
                heads["doc_id"][lo:hi] = key
                packed = heads[lo:hi].tobytes()
                spots = zip(want["start"][lo:hi].tolist(), want["n"][lo:hi].tolist(), place[lo:hi].tolist(), crowded[lo:hi].tolist(), strict=True)
                for i, (s, n, to, every) in enumerate(spots):
                    if every:
                        for k in range(s, s + n):
                            send(xxhash.xxh3_64_intdigest(raw[k : k + K]), key, row, k, 1, raw[k : k + K])
                    else:
                        out.setdefault(to, []).append(packed[i * size : (i + 1) * size] + raw[s : s + n + K - 1])
            if out:
                yield blobs([(p, RUNS, -1, b"".join(x)) for p, x in out.items()])
        if used != len(want):
            raise RuntimeError("the scan gave other row keys than before; docs must be a stable scan")

    def compare(batches):
        heads, texts = [], []
        for b in batches:
            for data in b.column(3).to_pylist():
                at = 0
                while at < len(data):
                    size = struct.unpack_from("<i", data, at + RUN_HEAD.fields["n"][1])[0] + K - 1
                    heads.append(data[at : at + RUN_HEAD.itemsize])
                    at += RUN_HEAD.itemsize
                    texts.append(data[at : at + size])
                    at += size
        if not heads:
            return
        h = np.frombuffer(b"".join(heads), RUN_HEAD)
        heads.clear()
        anchors = h["anchor"].tolist()
        order = np.lexsort((h["start"], h["row"], h["doc_id"], h["anchor"]))
        out = []

        equal: list[int] = []  # the third and further of equal bytes: removed, as the second is
        members: list[int] = []  # groups of one anchor stay in one collection
        group: list[int] = []
        seen: dict[bytes, int] = {}
        last = None

        def solve():
            if len(members) > 1:
                # equal windows have the same anchor, and members of one anchor stand in the order of documents and starts
                at = np.array(members)
                text, start, n = later([texts[i] for i in members], scratch)
                spots = np.zeros(len(text), SPOT)
                spots["row"], spots["start"], spots["n"] = h["row"][at[text]], h["start"][at[text]] + start, n
                out.extend(by_source(spots, 1, DUP))
            members.clear()

        for i in order.tolist():
            if anchors[i] != last:
                if len(group) > 1:
                    members.extend(group)
                if len(members) >= collection:
                    solve()
                group, seen, last = [], {}, anchors[i]
            seen[texts[i]] = seen.get(texts[i], 0) + 1
            (group if seen[texts[i]] <= 2 else equal).append(i)
        if len(group) > 1:
            members.extend(group)
        solve()
        spots = np.zeros(len(equal), SPOT)
        for f in SPOT.names:
            spots[f] = h[f][equal]
        out += by_source(spots, 1, DUP)
        if out:
            yield blobs(out)

    pieces = rows.mapInArrow(cut, BLOBS).repartitionById(parts, F.col("place")).mapInArrow(compare, BLOBS)
    second = _shelve(pieces, parts, "windows")
    common.remove(spark, scratch)

    def report(batches):
        from pyspark import TaskContext

        src = TaskContext.get().partitionId()
        spots = np.concatenate([np.zeros(0, SPOT), *(np.frombuffer(x, SPOT) for f in (first, second) for x in _notes(f, src, parts, DUP))])
        spots = spots[np.argsort(spots["row"], kind="stable")]
        rows_of, first_of = np.ascontiguousarray(spots["row"]), np.ascontiguousarray(spots["start"])
        end_of = first_of + spots["n"] + K - 1
        for b in batches:
            out = []
            for row, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                lo, hi = np.searchsorted(rows_of, [row, row + 1])
                if lo == hi:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                size = len(raw) + 1
                step = np.bincount(first_of[lo:hi], minlength=size) - np.bincount(end_of[lo:hi], minlength=size)
                gone = np.cumsum(step[:-1]) > 0
                spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([b.column(1), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(report, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


RUN_HEAD = np.dtype([("anchor", "<u8"), ("n", "<i4"), ("doc_id", "<i8"), ("row", "<i8"), ("start", "<i8"), ("x", "<i4")])

ORACLE_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(CAST(greatest((length(h) // 2 - 99 + 255) // 256, 0) AS BIGINT))) * 256 AS base FROM d),
c AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2 * (256 + 99)) AS h FROM b),
w AS (SELECT doc_id, base + o AS s, md5_number(substr(h, 2 * o + 1, 200)) AS x
      FROM (SELECT doc_id, base, h, unnest(range(CAST(length(h) // 2 - 99 AS BIGINT))) AS o FROM c)),
g AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM w),
r AS (SELECT doc_id, s, s > coalesce(max(s) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1) AS fresh FROM g WHERE k > 1),
i AS (SELECT doc_id, s, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM r),
p AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM p),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
             list(struct_pack(a := a, prev := prev) ORDER BY a) AS cuts FROM q GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(array_to_string(list_transform(cuts, lambda c: substr(h, 2 * c.prev + 1, 2 * (c.a - c.prev))), ''), '')
              || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
