"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are white-space separated words (A-Z lower-cased) and one end a text.  A
restaurant stands for each context, the hashed word before (``2**CONTEXT_BITS``
restaurants, so what is known of all of them is a table of fixed size); all share
one parent, the unigram restaurant, whose own parent is uniform over the
vocabulary and one unseen word.  A dish is a word; of each restaurant's dish the
seating keeps customers ``c`` and tables ``t``, and each table is a customer of
the parent.

Seating is sampled by blocked Gibbs: a dish's tables are drawn anew from their
distribution given all other dishes, then the parent's: by generalised Stirling
numbers up to 64 customers; beyond, by their limit (Poisson) where tables are few and
by Metropolis-Hastings where they are many, within 5 % of the exact mean (tests).
Discounts follow from the numbers of dishes with one and two customers.  Scores
use predictive probabilities averaged over the samples.

Data flow.  One shuffle brings the tokens, 4 to 6 bytes each after packing, to
their word's bucket, so that all dishes of a word and its unigram dish meet in
one task; later rounds read the staged buckets.  What a task does not know, the
tables of the restaurants, it takes from the last round's sums (distributed Gibbs
with stale totals), which are arrays of fixed size.  Words that make up much of
the corpus (at most ``HEAVY``) are spread by context, and their unigram dishes
are seated on the driver from summed customers.  Draws are a function of dish and
sweep, so scores do not depend on the number of tasks.  Partial scores go back by group of documents,
a few bytes for each document and bucket.

No vocabulary or count is cut off, and dishes grow with the corpus.  The restaurants do not:
contexts beyond some 2**CONTEXT_BITS share them, which costs score (figures in the README).

Defined cases: null and white-space text is the end token alone; repeated or null
doc_ids are separate rows (a null id's crc is that of empty text); with no
training rows N and V are 0 and the model is uniform.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CONTEXT_BITS, HEAVY = 18, 1024
STRENGTH = 1.0
EXACT = 64
START, END = xxhash.xxh3_64_intdigest(b"\x00start"), xxhash.xxh3_64_intdigest(b"\x00end")
META, TRAIN, HELD = 0, 1, 2
FLUSH_TOKENS, FLUSH_DOCS = 1_000_000, 60_000
BLOBS = "place int, kind int, flush long, data binary"
ARRAYS = "name string, part int, data binary"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(struct.pack("<I", a.nbytes) + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for k in kinds:
        (n,) = struct.unpack_from("<I", raw, at)
        out.append(np.frombuffer(raw, k, n // np.dtype(k).itemsize, at + 4))
        at += 4 + n
    return out


def pack_events(word: np.ndarray, context: np.ndarray, doc: np.ndarray) -> bytes:
    """Events in (word, context, doc) order: words with run lengths, contexts as steps, documents in 16 bits."""
    order = np.lexsort((doc, context, word))
    word, context, doc = word[order], context[order].astype(np.int32), doc[order].astype("<u2")
    names, first = np.unique(word, return_index=True)
    many = np.diff(np.append(first, len(word))).astype("<u4")
    step = np.diff(context, prepend=np.int32(0))
    step[first] = context[first]
    return _pack(names.astype("<u8"), many, (step & 0xFFFF).astype("<u2"), (step >> 16).astype(np.uint8), doc)


def unpack_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, events of each, and the events' contexts and documents."""
    names, many, low, high, doc = _unpack(data, "<u8", "<u4", "<u2", "u1", "<u2")
    total = np.cumsum(low.astype(np.int64) | high.astype(np.int64) << 16)
    ends = np.cumsum(many)
    base = np.append(0, total[ends[:-1] - 1]) if len(ends) else np.zeros(0, np.int64)
    return names, many.astype(np.int64), total - np.repeat(base, many), doc


def unpack_events(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, many, context, doc = unpack_runs(data)
    return np.repeat(names, many), context, doc


def log_stirling(discount: float, n: int = EXACT) -> np.ndarray:
    """log of generalised Stirling numbers S(c, t), c and t from 0 to n."""
    s = np.full((n + 1, n + 1), -np.inf)
    s[0, 0] = 0
    for c in range(n):
        t = np.arange(1, c + 2)
        stay = np.log(np.maximum(c - discount * t, 1e-300))
        s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], np.where(t <= c, stay + s[c, 1 : c + 2], -np.inf))
    return s


def uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 for each 64-bit key and salt: a dish's draws depend on the dish, not on the task that makes them."""
    z = key + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def binomial(n: np.ndarray, p: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Draws of successes in ``n`` trials: by inversion, or rounded normal where over 50 are expected."""
    p, u = np.clip(p, 0, 1), uniform(key, salt)
    q = np.minimum(p, 1 - p)
    mean, out = n * q, np.zeros(len(n), np.int64)
    wide = mean > 50
    if wide.any():
        z = np.sqrt(-2 * np.log(1 - u[wide])) * np.cos(2 * np.pi * uniform(key[wide], ~salt))
        out[wide] = np.rint(mean[wide] + np.sqrt(mean[wide] * (1 - q[wide])) * z)
    at, k = np.flatnonzero(~wide), 0
    pmf = np.exp(n[at] * np.log1p(-q[at]))
    seen = pmf.copy()
    while True:
        go = (seen < u[at]) & (k < n[at])
        if not go.any():
            break
        at, pmf, seen = at[go], pmf[go], seen[go]
        pmf *= (n[at] - k) / (k + 1) * q[at] / (1 - q[at])
        seen += pmf
        k += 1
        out[at] = k
    return np.clip(np.where(p > 0.5, n - out, out), 0, n)


def draw_tables(c: np.ndarray, rate: np.ndarray, discount: float, table: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of dishes with ``c`` customers; ``rate``: weight of a new table, (strength + discount × tables) × parent probability."""
    t = np.minimum(c, 1)
    small = np.flatnonzero((c > 1) & (c <= EXACT))
    small = small[np.argsort(c[small], kind="stable")]
    for g in np.split(small, np.flatnonzero(np.diff(c[small])) + 1) if len(small) else []:
        n = int(c[g[0]])
        k = np.arange(1, n + 1)
        for at in range(0, len(g), 1 << 15):
            h = g[at : at + (1 << 15)]
            p = table[n, 1 : n + 1] + k * np.log(np.maximum(rate[h], 1e-300))[:, None]
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
            t[h] = 1 + (p < uniform(key[h], salt)[:, None] * p[:, -1:]).sum(1)
    large = np.flatnonzero(c > EXACT)
    few = rate[large] < c[large] ** discount
    some = large[few]  # the limit for many customers: S(c, t) falls as discount**-t / (t - 1)!
    t[some] = np.minimum(c[some], 1 + binomial(np.full(len(some), 1 << 40), rate[some] / discount * 2.0**-40, key[some], salt))
    some = large[~few]
    if len(some):
        some = some[np.argsort(-c[some], kind="stable")]
        t[some] = many_tables(c[some], rate[some], discount, key[some], salt)
    return t


_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def many_tables(c: np.ndarray, rate: np.ndarray, discount: float, key: np.ndarray, salt: int, steps: int = 2) -> np.ndarray:
    """Tables of dishes with many customers (``c`` descending) and a rate of c**discount or more: chance in proportion to S(c, t) rate**t, by Metropolis-Hastings.

    Proposals come from a restaurant of strength s, whose chances are S(c, t) times the product of
    s + i discount; s is where rate meets those factors at the expected t, so most proposals are taken.
    """
    low, high = np.full(len(c), -60.0), np.log(rate)  # s in logarithms: s**(1 - discount) (s + c)**discount == rate
    low = np.minimum(low, high - 1)
    for _ in range(40):
        mid = (low + high) / 2
        over = (1 - discount) * mid + discount * np.log(np.exp(mid) + c) > np.log(rate)
        low, high = np.where(over, low, mid), np.where(over, mid, high)
    strength = np.exp(low)

    def seated(step: int) -> np.ndarray:
        """Customers come one by one and then in blocks, at a rate taken from the block's middle."""
        got, at, block = np.ones(len(c), np.int64), 1, 0
        while True:
            n = int(np.searchsorted(-c, -at))  # dishes with more customers than that
            if not n:
                return got
            size = max(1, at // 16)
            left = np.minimum(c[:n] - at, size)
            p = (strength[:n] + discount * got[:n]) / (strength[:n] + at + (size - 1) / 2)
            got[:n] += binomial(left, p, key[:n], salt + 4096 * (1 + block * (steps + 1) + step))
            at, block = at + size, block + 1

    def weight(t: np.ndarray) -> np.ndarray:
        return t * np.log(rate / discount) - _log_gamma(strength / discount + t).astype(np.float64)

    t = seated(0)
    for step in range(1, steps + 1):
        new = seated(step)
        with np.errstate(divide="ignore"):
            taken = np.log(uniform(key, ~(salt + 4096 * step))) < weight(new) - weight(t)
        t = np.where(taken, new, t)
    return t


@dataclass
class Totals:
    """What a round knows of the whole: fixed in size, sent to every task."""

    tokens: int = 0
    vocabulary: int = 0
    discount: float = 0.5
    root_discount: float = 0.5
    context_customers: np.ndarray = field(default_factory=lambda: np.zeros(1 << CONTEXT_BITS, np.int64))
    context_tables: np.ndarray = field(default_factory=lambda: np.zeros(1 << CONTEXT_BITS, np.int64))
    root_customers: int = 0
    root_tables: int = 0
    heavy_count: np.ndarray = field(default_factory=lambda: np.zeros(HEAVY, np.int64))
    heavy_customers: np.ndarray = field(default_factory=lambda: np.zeros(HEAVY, np.int64))
    heavy_tables: np.ndarray = field(default_factory=lambda: np.zeros(HEAVY, np.int64))

    @property
    def root_rate(self) -> float:
        """Weight of a new table of a word in the unigram restaurant."""
        return (STRENGTH + self.root_discount * self.root_tables) / (self.vocabulary + 1)


class Bucket:
    """The restaurants' dishes for the words of one bucket."""

    def __init__(self, train: list[bytes], heavy: np.ndarray):
        # a blob at a time: what stays of its events are its distinct dishes
        runs = [_unpack(x, "<u8", "<u4")[0] for x in train]
        self.words = np.unique(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
        self.count = np.zeros(len(self.words), np.int64)
        keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in train:
            names, many, context, _ = unpack_runs(x)
            w = np.searchsorted(self.words, names)
            self.count[w] += many
            k, n = np.unique(np.repeat(w << CONTEXT_BITS, many) | context, return_counts=True)
            keys.append(k)
            counts.append(n)
        self.dish, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.c = np.bincount(at, np.concatenate(counts), len(self.dish)).astype(np.int64)
        self.w, self.context = self.dish >> CONTEXT_BITS, self.dish & ((1 << CONTEXT_BITS) - 1)
        # the place of each word among the heavy ones, or -1
        at = np.minimum(np.searchsorted(heavy, self.words), max(0, len(heavy) - 1))
        self.heavy = np.where(heavy[at] == self.words, at, -1) if len(heavy) else np.full(len(self.words), -1)
        self.key = self.words[self.w] ^ (self.context.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.t = np.ones(len(self.c), np.int64)
        self.seat()

    def seat(self) -> None:
        self.c1 = np.bincount(self.w, self.t, len(self.words)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1)

    def known(self, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Unigram customers and tables of the words; heavy ones from the totals."""
        h = self.heavy >= 0
        c1, t1 = self.c1.copy(), self.t1.copy()
        c1[h], t1[h] = totals.heavy_customers[self.heavy[h]], totals.heavy_tables[self.heavy[h]]
        return c1, t1

    def unigram(self, totals: Totals) -> np.ndarray:
        c1, t1 = self.known(totals)
        return (np.maximum(c1 - totals.root_discount * t1, 0) + totals.root_rate) / (totals.root_customers + STRENGTH)

    def sweep(self, totals: Totals, tables: tuple[np.ndarray, np.ndarray], salt: int) -> None:
        rate = (STRENGTH + totals.discount * totals.context_tables[self.context]) * self.unigram(totals)[self.w]
        self.t = draw_tables(self.c, rate, totals.discount, tables[0], self.key, salt)
        self.seat()
        # a heavy word's customers are spread over buckets; its unigram dish is seated on the driver
        own = np.flatnonzero(self.heavy < 0)
        self.t1[own] = draw_tables(self.c1[own], np.full(len(own), totals.root_rate), totals.root_discount, tables[1], self.words[own], salt)

    def sums(self) -> dict[str, np.ndarray]:
        h = self.heavy >= 0
        size = 1 << CONTEXT_BITS
        out = {
            "customers": np.bincount(self.context, self.c, size), "tables": np.bincount(self.context, self.t, size),
            "scalars": np.array([self.count.sum(), (~h).sum(), (self.c == 1).sum(), (self.c == 2).sum(), (self.c1[~h] == 1).sum(), (self.c1[~h] == 2).sum(), self.t.sum(), self.t1[~h].sum()]),
            "heavy_count": np.bincount(self.heavy[h], self.count[h], HEAVY), "heavy_customers": np.bincount(self.heavy[h], self.c1[h], HEAVY),
        }
        return {k: v.astype(np.int64) for k, v in out.items()}


SIZES = {"customers": 1 << CONTEXT_BITS, "tables": 1 << CONTEXT_BITS, "scalars": 8, "heavy_count": HEAVY, "heavy_customers": HEAVY}


def _totals(rows: DataFrame, before: Totals | None, heavy: np.ndarray, salt: int = 0) -> Totals:
    """Sums of a round over all buckets; heavy words' unigram dishes are seated here, from their whole customers."""
    s = common.gathered(rows, SIZES)
    n, v, one, two, root_one, root_two, tables, root = s["scalars"].tolist()
    seen = int((s["heavy_count"] > 0).sum())
    customers = s["heavy_customers"]
    if before is None:  # until tables are drawn, a dish has one
        drawn = np.minimum(customers, 1)
    else:
        some = np.flatnonzero(customers[: len(heavy)])
        drawn = np.zeros(HEAVY, np.int64)
        drawn[some] = draw_tables(customers[some], np.full(len(some), before.root_rate), before.root_discount, log_stirling(before.root_discount), heavy[some], salt)
    out = Totals(n, v + seen, one / (one + 2 * two) if one else 0.5, root_one / (root_one + 2 * root_two) if root_one else 0.5, s["customers"], s["tables"], tables, root + int(drawn.sum()), s["heavy_count"], customers, drawn)
    out.discount, out.root_discount = (min(0.95, max(0.05, x)) for x in (out.discount, out.root_discount))
    if before is not None:
        out.discount, out.root_discount = before.discount, before.root_discount
    return out


def score(docs: DataFrame, train: "F.Column | None" = None, burn: int = 2, samples: int = 3, seed: int = 1) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs (doc_id, text)``.

    ``train``: the rows to learn from, by default those whose crc32(doc_id) mod 7 is not 2.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    learn = (common.crc_mod(F.col("doc_id"), 7) != 2) if train is None else train
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~learn).alias("held_out"), "text")

    def frequent(batches):
        count, n = Counter(), 0
        for b in batches:
            for held, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not held:
                    w = words(text)
                    n += len(w) + 1
                    count.update(w)
                    count[b""] += 1
            if len(count) > 200_000:  # a word that holds 1/512 of the task's tokens is never among those let go for long
                count = Counter({k: v for k, v in count.items() if v * 20_000 > n})
        hash_of = lambda w: xxhash.xxh3_64_intdigest(w) if w else END
        found = [(np.uint64(hash_of(w)).astype(np.int64).item(), v) for w, v in count.items() if v * 512 >= n]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["word", "n"])

    top = rows.mapInArrow(frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "word").limit(HEAVY).collect()
    heavy = np.sort(np.array([r.word for r in top], np.int64).view(np.uint64))

    def events(batches):
        from pyspark import TaskContext

        flush_id, hashes = TaskContext.get().partitionId() << 24, Hashes()
        flat, sizes, ids, held = array("Q"), [], [], []

        def flush():
            nonlocal flush_id, flat
            word = np.frombuffer(flat, np.uint64)
            n = np.array(sizes, np.int64)
            first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
            context = np.empty(len(word), np.int64)
            mask = np.uint64((1 << CONTEXT_BITS) - 1)
            context[1:] = (word[:-1] & mask).astype(np.int64)
            context[first] = START & int(mask)
            doc = np.repeat(np.arange(len(n)), n)
            place = (word >> np.uint64(24)) % np.uint64(parts)
            at = np.minimum(np.searchsorted(heavy, word), max(0, len(heavy) - 1))
            if len(heavy):
                hot = heavy[at] == word
                mixed = (word[hot] ^ context[hot].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                place[hot] = (mixed >> np.uint64(24)) % np.uint64(parts)
            key = place.astype(np.int64) * 2 + np.array(held, np.int64)[doc]
            order = np.argsort(key, kind="stable")
            out = [(k := int(key[g[0]]), pack_events(word[g], context[g], doc[g])) for g in np.split(order, np.flatnonzero(np.diff(key[order])) + 1)]
            meta = _pack(np.array([0 if x is None else x for x in ids], "<i8"), np.array([x is None for x in ids], "?"), np.array(held, "?"), n.astype("<i8"))
            rows = [(flush_id % parts, META, meta), *((k // 2, HELD if k % 2 else TRAIN, x) for k, x in out)]
            batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([flush_id] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["place", "kind", "flush", "data"])
            flush_id += 1
            flat = array("Q")
            sizes.clear()
            ids.clear()
            held.clear()
            return batch

        for b in batches:
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = words(text)
                flat.extend(map(hashes.__getitem__, w))
                flat.append(END)
                sizes.append(len(w) + 1)
                ids.append(doc_id)
                held.append(out)
                if len(flat) >= FLUSH_TOKENS or len(sizes) >= FLUSH_DOCS:
                    yield flush()
        if sizes:
            yield flush()

    folder = common.shared_dir(spark, "tokens")
    rows.mapInArrow(events, BLOBS).repartitionById(parts, F.col("place")).write.parquet(folder)

    def each(run, schema):
        """``run(bucket number, its rows)`` for each bucket, in parallel."""

        def go(part, batches):
            held = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[0] != META]
            if held:
                yield from run(part, held)

        return common.each_part(spark, folder, parts, ["kind", "flush", "data"], go, schema)

    def count(place, held):
        yield common.array_rows(Bucket([d for kind, _, d in held if kind == TRAIN], heavy).sums())

    totals = _totals(each(count, ARRAYS), None, heavy)
    shared = spark.sparkContext.broadcast(totals)

    def sampled(held, totals, tables, salt):
        bucket = Bucket([d for kind, _, d in held if kind == TRAIN], heavy)
        for k in range(burn):
            bucket.sweep(totals, tables, salt + k)
        return bucket

    first, second = seed << 40, seed << 40 | 1 << 11  # the passes' salts; a block's draw adds multiples of 4096

    def seat(place, held):
        totals = shared.value
        tables = log_stirling(totals.discount), log_stirling(totals.root_discount)
        yield common.array_rows(sampled(held, totals, tables, first).sums())

    totals = _totals(each(seat, ARRAYS), totals, heavy, first + burn)
    shared_last = spark.sparkContext.broadcast(totals)

    def judge(place, held):
        totals = shared_last.value
        tables = log_stirling(totals.discount), log_stirling(totals.root_discount)
        bucket = sampled(held, totals, tables, second)
        m = len(bucket.words)
        fresh = totals.root_rate
        heavy_p = (np.maximum(totals.heavy_customers - totals.root_discount * totals.heavy_tables, 0) + fresh) / (totals.root_customers + STRENGTH)
        count = np.append(np.where(bucket.heavy >= 0, totals.heavy_count[np.maximum(bucket.heavy, 0)], bucket.count), 0)
        states = []  # a sample is what its dishes and words weigh
        for k in range(samples):
            bucket.sweep(totals, tables, second + burn + k)
            own = (bucket.c - totals.discount * bucket.t).astype(np.float32)
            states.append((own, np.append(bucket.unigram(totals), fresh / (totals.root_customers + STRENGTH))))
        for _, flush, data in held:
            names, many, context, doc = unpack_runs(data)
            w = np.minimum(np.searchsorted(bucket.words, names), max(0, m - 1))
            ok = bucket.words[w] == names if m else np.zeros(len(names), bool)
            # a heavy word may have no training token in this bucket
            at = np.minimum(np.searchsorted(heavy, names), max(0, len(heavy) - 1))
            stray = ~ok & (heavy[at] == names) if len(heavy) else np.zeros(len(names), bool)
            w = np.where(ok, w, m)
            c = np.where(stray, totals.heavy_count[at], count[w]) if len(heavy) else count[w]
            key = np.repeat(w << CONTEXT_BITS, many) | context
            d = np.minimum(np.searchsorted(bucket.dish, key), max(0, len(bucket.dish) - 1))
            seen = bucket.dish[d] == key if len(bucket.dish) else np.zeros(len(key), bool)
            back = STRENGTH + totals.discount * totals.context_tables[context]
            p = np.zeros(len(key))
            for own, parents in states:
                parent = np.where(stray, heavy_p[at], parents[w]) if len(heavy) else parents[w]
                p += (own[d] * seen if len(own) else 0) + back * np.repeat(parent, many)
            logs = np.log10(p / samples / (totals.context_customers[context] + STRENGTH))
            docs, k = np.unique(doc, return_inverse=True)
            c = np.repeat(c, many)
            data = _pack(docs.astype("<u2"), np.bincount(k, c > 0).astype("<u4"), np.bincount(k, np.log10(c + 1.0)).astype("<f8"), np.bincount(k, logs).astype("<f8"))
            yield pa.RecordBatch.from_arrays([pa.array([flush], pa.int64()), pa.array([TRAIN], pa.int32()), pa.array([data], pa.binary())], ["flush", "kind", "data"])

    partial = each(judge, "flush long, kind int, data binary").unionByName(spark.read.schema(BLOBS).parquet(folder).filter(F.col("kind") == META).select("flush", "kind", "data"))
    n, unit = totals.tokens, float(np.log10(totals.tokens + totals.vocabulary + 1))

    def report(batches):
        last, held = None, []

        def out():
            meta = next(d for k, d in held if k == META)
            ids, none, is_held, size = _unpack(meta, "<i8", "?", "?", "<i8")
            known, base, logs = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
            for k, d in held:
                if k != META:
                    doc, a, b, c = _unpack(d, "<u2", "<u4", "<f8", "<f8")
                    known[doc] += a
                    base[doc] += b
                    logs[doc] += c
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=none), pa.array(is_held), pa.array(size), pa.array(known), pa.array(np.full(len(ids), n, np.int64)), pa.array(base - size * unit), pa.array(logs)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        for b in batches:
            for flush, kind, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if flush != last and held:
                    yield out()
                    held = []
                last = flush
                held.append((kind, data))
        if held:
            yield out()

    return partial.repartition(parts, "flush").sortWithinPartitions("flush").mapInArrow(report, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
