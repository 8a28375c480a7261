"""SimHash near-duplicates, linked by the generalised pigeonhole principle.

Equal fingerprints fold into one before anything else, so exact copies cost one
row.  The 64 bits are grouped into partitions of correlated bits (correlated bits
vary together, which leaves the other partitions selective).  If two fingerprints
differ in at most ``distance`` bits and thresholds satisfy
``sum(t + 1) == distance + 1``, then some partition differs in at most its ``t``
bits (a threshold of -1 leaves a partition out).  The thresholds are chosen by
dynamic programming on candidate counts from the partitions' histograms over all
fingerprints.  Each fingerprint is indexed under its partition values and probes
those within the threshold; values that too many share are refined by a second
pigeonhole over the remaining bits.  Inside a value, links are verified on all 64
bits, and what leaves the task is a star for each group found there: at most one
link a fingerprint, however large the group, and no connection is lost.

Components of those links are then found in tables (:mod:`components`).

Defined cases: null or white-space text has fingerprint zero, which links like
any other; fewer words than a shingle make one shingle of all of them; rows with
equal or null doc_id are separate rows; a component of null ids only has a null
component_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

PARTS, WIDTH = 4, 16
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (all words, if they are fewer), repeats included."""
    return shingles_of(words_of(text), size)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only


def shingles_of(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, SEED)], np.uint64)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    return np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts, starts[size:], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        part = np.ascontiguousarray(hashes[k : k + (1 << 16)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``__row, doc_id, fp`` (the 64 bits as a signed long) for every row."""

    def make():
        def f(batch):
            fps = np.array([fingerprint(shingle_hashes(t, size)) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["__row", "doc_id", "fp"])

        return f

    return common.arrow_map(common.with_row(docs, F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "__row long, doc_id long, fp long")


def bit_groups(together: np.ndarray, n: int) -> list[list[int]]:
    """Partitions of correlated bits, from the 64 × 64 counts of bits set together in ``n`` fingerprints."""
    mean = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    corr = np.abs(cov / sd / sd[:, None])
    free, out = set(range(64)), []
    while free:
        group = [max(free, key=lambda b: (sum(corr[b, c] for c in free) - 1, -b))]
        free.discard(group[0])
        while len(group) < WIDTH:
            nxt = max(free, key=lambda b: (sum(corr[b, c] for c in group), -b))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def gather_bits(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint, side by side."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """Masks of at most ``radius`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.int64)


def allocate(histograms: list[np.ndarray], distance: int, probe_cost: float = 20.0) -> list[int]:
    """A threshold for each partition: least estimated work with ``sum(t + 1) == distance + 1``."""
    costs = []
    for h in histograms:
        h, seen, near, used = h.astype(float), [0.0], np.zeros(len(h)), 0
        masks = ball(int(len(h)).bit_length() - 1, min(distance, 3))
        size = np.bitwise_count(masks.astype(np.uint64))
        at = np.arange(len(h))
        for t in range(min(distance, 3) + 1):
            for m in masks[size == t]:
                near += h[at ^ m]
                used += 1
            seen.append(float((h * near).sum() + probe_cost * used * h.sum()))
        costs.append(seen)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for seen in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, ts) in best.items():
            for t1, c in enumerate(seen):  # t1 = threshold + 1
                if spent + t1 <= distance + 1 and (spent + t1 not in nxt or cost + c < nxt[spent + t1][0]):
                    nxt[spent + t1] = cost + c, [*ts, t1 - 1]
        best = nxt
    return best[distance + 1][1]


def stars(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, centre) that connect exactly what links of at most ``distance`` bits among distinct ``fps`` connect."""
    n = len(fps)
    root = np.arange(n)

    def merge(roots: np.ndarray) -> None:
        """Make components one, named by the least of their roots."""
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots.min()

    leader = np.full(n, -1)
    leaders = []
    for i in range(n):  # points within reach of a leader need no comparison with each other
        if leader[i] >= 0:
            continue
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= distance)
        leaders.append(i)
        leader[near[leader[near] < 0]] = i
        merge(np.unique(root[near]))
    # links between followers of different leaders
    if len(leaders) < n:
        crowd: dict[int, np.ndarray] = {}
        order = np.argsort(leader, kind="stable")
        cut = np.flatnonzero(np.diff(leader[order])) + 1
        for g in np.split(order, cut):
            if len(g) > 1:
                crowd[int(leader[g[0]])] = g[g != leader[g[0]]]
        heads = np.array(sorted(crowd))
        for x, a in enumerate(heads.tolist()):
            rest = heads[x + 1 :]
            for b in rest[np.bitwise_count(fps[rest] ^ fps[a]) <= 3 * distance].tolist():
                if root[a] == root[b]:
                    continue
                ga, gb = crowd[a], crowd[b]
                for k in range(0, len(ga), 256):
                    if (np.bitwise_count(fps[ga[k : k + 256], None] ^ fps[gb]) <= distance).any():
                        merge(root[[a, b]])
                        break
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def links(distinct: DataFrame, distance: int = 3, heavy: int = 4096) -> DataFrame:
    """``a, b``: links of at most ``distance`` bits that connect all that such links connect; ``distinct`` has ``fp``."""
    spark = distinct.sparkSession

    def together(batches):
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(np.ascontiguousarray(b.column(0).to_numpy()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
            n += len(x)
        yield common.array_rows({"t": total.ravel(), "n": np.array([n])})

    got = common.gathered(distinct.select("fp").mapInArrow(together, "name string, part int, data binary"), {"t": 4096, "n": 1})
    n = int(got["n"][0])
    groups = bit_groups(got["t"].reshape(64, 64), n)

    def histogram(batches):
        h = np.zeros((PARTS, 1 << WIDTH), np.int64)
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for k, bits in enumerate(groups):
                h[k] += np.bincount(gather_bits(fps, bits), minlength=1 << WIDTH)
        yield common.array_rows({str(k): h[k] for k in range(PARTS)})

    got = common.gathered(distinct.select("fp").mapInArrow(histogram, "name string, part int, data binary"), {str(k): 1 << WIDTH for k in range(PARTS)})
    thresholds = allocate([got[str(k)] for k in range(PARTS)], distance)
    masks = [ball(WIDTH, t) if t >= 0 else np.zeros(0, np.int64) for t in thresholds]
    # values that more than ``heavy`` fingerprints share (their number is n / heavy a partition at most, and 2**16)
    crowded = [got[str(k)] > heavy for k in range(PARTS)]
    rest = [[b for b in range(64) if b not in bits] for bits in groups]
    quarters = [[r[j::distance + 1] for j in range(distance + 1)] for r in rest]

    def index(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            for k, bits in enumerate(groups):
                own = gather_bits(fps, bits)
                for m in masks[k].tolist():
                    value = own ^ m
                    hot = crowded[k][value]
                    cold = ~hot
                    yield rows(k, value[cold], np.zeros(int(cold.sum()), np.int64), fps[cold], m != 0)
                    for j, q in enumerate(quarters[k] if hot.any() else []):
                        yield rows(k, value[hot], (gather_bits(fps[hot], q) << 3) + j + 1, fps[hot], m != 0)

    def rows(k, value, sub, fps, probe):
        return pa.RecordBatch.from_arrays([pa.array((value << 4) | k, pa.int64()), pa.array(sub), pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), probe))], ["value", "sub", "fp", "probe"])

    def verify(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(last: bool):
            nonlocal held, size
            value, sub, fp, probe = (np.concatenate(c) for c in zip(*held, strict=True))
            edge = np.flatnonzero((np.diff(value) != 0) | (np.diff(sub) != 0)) + 1
            end = len(value) if last else int(edge[-1]) if len(edge) else 0
            held = [(value[end:], sub[end:], fp[end:], probe[end:])]
            size = len(value) - end
            cuts = [0, *edge[edge < end].tolist(), end]
            many = np.diff(cuts)
            a, b = [], []
            # small buckets together: neighbours at each distance in the sorted order
            small = np.repeat(many <= 64, many)
            run = np.repeat(np.arange(len(many)), many)
            f, r, p = fp[:end].view(np.uint64), run, probe[:end]
            f, r, p = f[small], r[small], p[small]
            for s in range(1, int(many[many <= 64].max(initial=1))):
                ok = (r[s:] == r[:-s]) & (np.bitwise_count(f[s:] ^ f[:-s]) <= distance) & ~(p[s:] & p[:-s])
                if not (r[s:] == r[:-s]).any():
                    break
                a.append(f[s:][ok])
                b.append(f[:-s][ok])
            for k in np.flatnonzero(many > 64).tolist():
                got = stars(np.unique(fp[cuts[k] : cuts[k + 1]].view(np.uint64)), distance)
                a.append(got[0])
                b.append(got[1])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
            ok = a != b
            return pa.RecordBatch.from_arrays([pa.array(a[ok].view(np.int64)), pa.array(b[ok].view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
                size += batch.num_rows
                if size >= 1_000_000:
                    yield flush(False)
        if size:
            yield flush(True)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").mapInArrow(index, "value long, sub long, fp long, probe boolean")
    keyed = keyed.repartition(parts, "value", "sub").sortWithinPartitions("value", "sub")
    return keyed.mapInArrow(verify, "a long, b long")


def groups(docs: DataFrame, size: int = 3, distance: int = 3) -> DataFrame:
    """``__row, doc_id, fp, component_id, first_row`` for every row; first_row: the row of the component that would stay."""
    marks = common.stage(fingerprints(docs, size), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    distinct = common.stage(marks.groupBy("fp").agg(first), "distinct")
    tree = components(links(distinct, distance))
    rooted = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.__row").alias("first_row"))
    return marks.join(classes, "fp").select("__row", "doc_id", "fp", "component_id", "first_row")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id``."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(words: list[bytes], size: int) -> np.ndarray:
    """The distinct shingles, as ascending 32-bit hashes (of n shingles, some n / 2**32 meet another by chance)."""
    return np.unique(shingles_of(words, size).astype(np.uint32)).view(np.int32)


def feature_print(words: list[bytes], size: int) -> int:
    """The fingerprint over the distinct shingles: a word repeated all through a text counts once."""
    return fingerprint(shingles_of(list(set(words)), 1) if size == 1 and len(words) > 1 else np.unique(shingles_of(words, size)))


def joined(fps: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None, similarity: float, distance: int) -> list[tuple[int, int]]:
    """Index pairs that connect exactly what pairs within ``distance`` bits and of at least ``similarity`` connect.

    ``side``: a boolean for each set; only pairs of unlike sides count (None: all pairs).
    Every pair given is verified; a set is compared with all that are not yet reached.
    """
    size = np.array([len(x) for x in sets], np.int64)
    known, code = np.unique(np.concatenate(sets), return_inverse=True)
    code = np.split(code, np.cumsum(size)[:-1])
    held = np.zeros(len(known), bool)
    rest, queue, out = np.arange(len(sets)), [], []
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
        i = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[i]) <= distance
        near &= np.minimum(size[rest], size[i]) >= similarity * np.maximum(size[rest], size[i])
        if side is not None:
            near &= side[rest] != side[i]
        at = np.flatnonzero(near)
        if not len(at):
            continue
        held[code[i]] = True
        both = np.array([np.count_nonzero(held[code[j]]) for j in rest[at].tolist()])
        held[code[i]] = False
        at = at[both >= similarity * (size[rest[at]] + size[i] - both)]
        found = rest[at].tolist()
        out += [(i, j) for j in found]
        queue += found
        rest = np.delete(rest, at)
    return out


def similar(docs: DataFrame, size: int = 5, similarity: float = 0.8, features: int = 1, distance: int = 7, block: int = 256) -> DataFrame:
    """``__row, doc_id, first_row``: groups that pairs of at least ``similarity`` connect.

    Similarity is the Jaccard coefficient of the sets of ``size``-word shingles and
    is verified on the sets themselves.  Candidates are all pairs of fingerprints over
    distinct ``features``-word shingles within ``distance`` bits, equal ones included
    (single words keep similar texts' fingerprints closer than shingles do; figures in
    the README).  Equal shingle sets fold first.

    :func:`links` only connects fingerprints, so its components hold all candidate
    pairs, and the pairs are decided there: the sets of a component meet in one task,
    or, beyond ``block`` sets (or their shingles), in one for each pair of its blocks.
    A set so moves once for each block of its component.
    """

    def make():
        def f(batch):
            fps, sids, many = [], [], []
            for t in batch.column(2).to_pylist():
                words = words_of(t)
                fps.append(feature_print(words, features))
                s = shingle_set(words, size)
                sids.append(xxhash.xxh3_128_digest(s.tobytes()))
                many.append(len(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sids, pa.binary()), pa.array(many, pa.int64())], ["__row", "doc_id", "fp", "sid", "many"])

        return f

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = common.with_row(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = common.stage(common.arrow_map(rows, make, "__row long, doc_id long, fp long, sid binary, many long"), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row")).alias("first")
    sets = common.stage(marks.groupBy("sid").agg(F.min("fp").alias("fp"), F.first("many").alias("many"), first).withColumn("at", F.col("first.__row")), "sets")
    distinct = common.stage(sets.select("fp").distinct(), "distinct")
    near = components(links(distinct, distance))
    member = common.stage(sets.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("at", "fp", "many", F.coalesce("root", "fp").alias("near")), "member")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), F.sum("many") / F.lit(block * 2048))).cast("int").alias("blocks")
    sizes = member.groupBy("near").agg(F.count(F.lit(1)).alias("n"), blocks).filter("n > 1").select("near", "blocks")
    # the wanted rows go back to the scan tasks that read them
    wanted = common.shared_dir(spark, "wanted")
    ids = member.join(sizes, "near").select(F.col("at").alias("row"), "fp", "near", "blocks")
    ids.repartitionById(parts, F.pmod(F.shiftright("row", 33), F.lit(parts)).cast("int")).write.parquet(wanted)

    def cut(batches):
        from pyspark import TaskContext

        src = TaskContext.get().partitionId()
        mine = {}
        for b in common.read_part(wanted, src % parts, ["row", "fp", "near", "blocks"]):
            mine.update((r[0], r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) if r[0] >> 33 == src)
        found = 0
        for b in (x for whole in batches for x in common.small(whole)):
            got = [(*mine[r], shingle_set(words_of(t), size).tobytes()) for r, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if r in mine]
            found += len(got)
            for other in range(max((g[3] for g in got), default=0)):
                out = [(near, min(own, other), max(own, other), at, fp, s, many) for at, fp, near, many, s in got if other < many for own in [xxhash.xxh3_64_intdigest(at.to_bytes(8, "little")) % many]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32()], strict=True)], ["near", "i", "j", "at", "fp", "shingles", "blocks"])
        if found != len(mine):
            raise RuntimeError("the scan gave other row keys than before; docs must be a stable scan")

    def decide(batches):
        last, held = None, []

        def out():
            at, fps = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64).view(np.uint64)
            side = None if last[1] == last[2] else np.array([xxhash.xxh3_64_intdigest(h[0].to_bytes(8, "little")) % h[3] == last[1] for h in held])
            pairs = np.array(joined(fps, [np.frombuffer(h[2], np.int32) for h in held], side, similarity, distance), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(at[pairs[:, 0]]), pa.array(at[pairs[:, 1]])], ["a", "b"])

        for b in batches:
            for near, i, j, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (near, i, j) != last and held:
                    yield out()
                    held = []
                last = near, i, j
                held.append(row)
        if held:
            yield out()

    keyed = rows.mapInArrow(cut, "near long, i int, j int, at long, fp long, shingles binary, blocks int").repartition(parts, "near", "i", "j").sortWithinPartitions("near", "i", "j")
    tree = components(keyed.mapInArrow(decide, "a long, b long"))
    rooted = sets.join(tree.withColumnRenamed("node", "at"), "at", "left").select("sid", "first", F.coalesce("root", "at").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    classes = rooted.select("sid", "root").join(least, "root").select("sid", F.col("first.__row").alias("first_row"))
    return marks.join(classes, "sid").select("__row", "doc_id", "first_row")


def deduplicate(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, columns as they were, without all but one row of each group of :func:`similar` (smallest doc_id, then first row)."""
    return common.without(docs, similar(docs, size, similarity).filter("__row <> first_row"))
