"""Toxicity by weak supervision.

1. Eleven voters look at a text on their own grounds; each votes toxic or abstains:
   three written lexicons (insults, contempt, aversion; in four languages), four
   lexicons mined from labelled training rows (words and word beginnings, each from
   one half of a bounded sample, so that no row speaks for two of a kind), and four
   patterns (shouting, runs of marks, masked words, one word over and over).
2. All documents vote.  Votes are an 11-bit mask, so there are at most 2,048 kinds
   of votes, and only their counts and a few rows of each kind reach the driver.
3. A generative label model explains the votes of all documents, without labels:
   a hidden class, for each class and voter how readily it votes, and for each pair
   of voters that rest on the same ground (:data:`EDGES`) a coupling, all in one
   log-linear model that is fitted by expectation maximisation.  The posterior
   follows from it, so what a coupling explains counts once.
4. A linear classifier over the lexicons' entries and the patterns is trained on
   the posterior labels of at most ``per_kind`` training rows of each kind, weighted
   by how many documents voted so, and scores every document in one map pass.

Labels are used to mine lexicons and nowhere else.

Defined cases: null or empty text has no features and scores as such; labels
that are null do not count; a doc_id with several labels is toxic if one is;
without usable labels the mined lexicons are empty and the others go on; rows with
equal doc_id are scored one by one; a null doc_id is scored, never learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"[^\W\d_][*#@$]+[^\W\d_]")
BEGINNINGS = (4, 5, 6, 7)

INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools imbecile imbeciles clown clowns loser losers jerk jerks retard cretin dimwit halfwit bastard bitch asshole "
    "idioten dummkopf trottel vollidiot arschloch depp schwachkopf blödmann imbécile imbéciles crétin crétins abruti abrutis connard connards salaud débile idiota idiotas estúpido estúpida imbécil tonto tonta cabrón gilipollas pendejo"
).split()
CONTEMPT = (
    "trash garbage scum worthless pathetic useless filth filthy vermin parasite parasites subhuman rubbish lowlife degenerate degenerates pest "
    "abschaum dreck wertlos erbärmlich müll ungeziefer ordure ordures déchet racaille minable vermine basura escoria inútil patético despreciable gentuza"
).split()
AVERSION = (
    "disgusting disgust hate hates hated hateful despise repulsive revolting vile loathe loathsome sickening ugly gross creep "
    "hasse ekelhaft widerlich abscheulich hässlich dégoûtant dégueulasse répugnant déteste haine odio asqueroso asquerosa repugnante detesto"
).split()
WRITTEN = (INSULTS, CONTEMPT, AVERSION)
#: Bits of a vote: the written lexicons, words and beginnings of either half, the patterns.
WORDS, STARTS, PATTERNS = 3, 5, 7
VOTERS = 11
#: Voters that rest on the same ground: words of either half, beginnings of either half, words and beginnings of one half, and the written lexicons with what was mined as words.
EDGES = ((3, 4), (5, 6), (3, 5), (4, 6), *((i, j) for i in range(3) for j in (3, 4)))


@dataclass(frozen=True)
class Features:
    """The lexicons' entries: ``entries`` in a fixed order, and of each the voters that hold it, as a mask."""

    entries: tuple[str, ...]
    masks: tuple[int, ...]


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray  # one an entry, then a pattern, log1p of hits, density, and the bias
    prior: float
    accuracy: np.ndarray  # 2 × voters: chance to vote in clean and in toxic documents
    coupling: np.ndarray  # one an edge
    posterior: dict[int, float]


def names(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def lexicons(mined: dict[int, list[str]]) -> Features:
    """Written entries, and those mined by half (0, 1)."""
    held: dict[str, int] = {}
    for k, words in enumerate(WRITTEN):
        for w in words:
            held[f"w:{w}"] = held.get(f"w:{w}", 0) | 1 << k
    for half, entries in sorted(mined.items()):
        for e in entries:
            held[e] = held.get(e, 0) | 1 << ((WORDS if e[0] == "w" else STARTS) + half)
    return Features(tuple(held), tuple(held.values()))


class Reader:
    """What a text shows: entries hit, the voters' mask, and its number of distinct words; what a word brings is cached (bounded)."""

    def __init__(self, features: Features):
        self.index = {f: k for k, f in enumerate(features.entries)}
        self.masks = features.masks
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], int, int]:
        found = WORD.findall(text)
        cache, hits = self.cache, set()
        if len(cache) > 150_000:
            cache.clear()
        words = set(map(str.lower, found))
        for w in words:
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(k for n in names(w) if (k := self.index.get(n)) is not None)
            if got:
                hits.update(got)
        mask = patterns(text, found, len(words)) << PATTERNS
        for k in hits:
            mask |= self.masks[k]
        return sorted(hits), mask, len(words)


def patterns(text: str, found: list[str], distinct: int) -> int:
    """Bits: most words of three letters or more in capitals; three runs of ! or ?; a word with letters masked; words repeated ten times each on average."""
    out = 0
    long = [w for w in found if len(w) > 2]
    if len(long) >= 3 and 2 * sum(map(str.isupper, long)) > len(long):
        out |= 1
    if text.count("!!") + text.count("??") >= 3:
        out |= 2
    if ("*" in text or "#" in text or "@" in text or "$" in text) and MASKED.search(text):
        out |= 4
    if distinct and len(found) >= 10 * distinct:
        out |= 8
    return out


def vector(hits: list[int], mask: int, words: int, n: int) -> np.ndarray:
    p = VOTERS - PATTERNS
    x = np.zeros(n + p + 3)
    x[hits] = 1
    x[n : n + p] = mask >> PATTERNS >> np.arange(p) & 1
    x[n + p :] = np.log1p(len(hits)), min(1.0, 20 * len(hits) / max(1, words)), 1
    return x


def label_model(kinds: dict[int, int], voters: int = VOTERS, edges: tuple[tuple[int, int], ...] = EDGES, rounds: int = 60, penalty: float = 0.01) -> tuple[float, np.ndarray, np.ndarray, dict[int, float]]:
    """Prior, accuracies, couplings and posteriors from counts of vote masks.

    P(votes | class) is proportional to exp(a[class] . votes + sum of coupling x vote x vote over ``edges``);
    its normaliser is summed over all 2**voters votes, so the fit is exact.
    """
    masks = np.array(sorted(kinds), np.int64)
    share = np.array([kinds[m] for m in masks.tolist()], float)
    share /= max(1.0, share.sum())
    every = np.arange(1 << voters)
    bits = (every[:, None] >> np.arange(voters) & 1).astype(float)
    x = np.concatenate([bits, *[bits[:, i : i + 1] * bits[:, j : j + 1] for i, j in edges]], axis=1)
    m, e = voters, len(edges)
    a = np.stack([np.full(m, np.log(0.02 / 0.98)), np.full(m, np.log(0.4 / 0.6))])
    phi, prior = np.zeros(e), 0.1

    def states(y: int) -> tuple[np.ndarray, float]:
        z = x @ np.concatenate([a[y], phi])
        top = z.max()
        p = np.exp(z - top)
        return p / p.sum(), float(top + np.log(p.sum()))

    post = np.zeros(len(masks))
    for _ in range(rounds if len(masks) else 0):
        odds = np.log(prior / (1 - prior)) + x[masks, :m] @ (a[1] - a[0]) - states(1)[1] + states(0)[1]
        post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        weight = np.stack([share * (1 - post), share * post])
        prior = float(np.clip(weight[1].sum(), 1e-4, 0.5))
        for _ in range(4):  # Newton steps of the maximisation
            grad, hess = np.zeros(2 * m + e), np.zeros((2 * m + e, 2 * m + e))
            for y in (0, 1):
                at = np.r_[y * m : y * m + m, 2 * m : 2 * m + e]
                p, _ = states(y)
                mean = p @ x
                r = weight[y].sum()
                seen = (weight[y] @ x[masks] + 1e-5 * 0.1) / (r + 1e-5 * 0.2)  # a trace of evidence for either side
                grad[at] += r * (seen - mean)
                hess[np.ix_(at, at)] += r * ((x * p[:, None]).T @ x - np.outer(mean, mean))
            grad[2 * m :] -= penalty * phi
            hess += np.diag(np.r_[np.full(2 * m, 1e-6), np.full(e, penalty)])
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 2 / (np.abs(step).max() + 1e-9))
            a = np.clip(a + step[: 2 * m].reshape(2, m), -12, 12)
            phi = np.clip(phi + step[2 * m :], -12, 12)
        against = a[1] < a[0]
        a[:, against] = a[:, against].mean(0)  # a voter against its own sense says nothing
    rate = np.stack([states(y)[0] @ bits for y in (0, 1)])
    return prior, rate, phi, dict(zip(masks.tolist(), post.tolist(), strict=True))


def linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weighted ridge logistic regression on soft labels, by Newton's method; the bias is free."""
    beta = np.zeros(x.shape[1])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge @ beta
        hess = (x * (w * np.clip(p * (1 - p), 1e-4, None))[:, None]).T @ x + ridge
        step = np.linalg.solve(hess, grad)
        beta = beta + step * min(1.0, 5 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-5:
            break
    return beta


def mine(docs: DataFrame, labels: DataFrame, per_class: int, most_features: int) -> dict[int, list[str]]:
    """For each half of the labelled sample the entries that stand out in its toxic rows, the strongest first."""
    seen = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picks = [seen.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(picks[0].unionByName(picks[1]))  # 2 × per_class rows
    texts = docs.select("doc_id", "text").join(sample, "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text"))

    def count():
        def f(batch):
            found: dict[tuple[int, str], list[int]] = {}
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                half = xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) & 1
                for n in {"", *(n for w in set(WORD.findall(t.lower())) for n in names(w))}:  # the empty name counts rows
                    found.setdefault((half, n), [0, 0])[int(y > 0)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int32()), pa.array([k[1] for k in found]), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], ["half", "entry", "clean", "toxic"])

        return f

    # texts stay in the tasks that read them; what is shuffled are entries' counts
    counts = common.stage(common.arrow_map(texts, count, "half int, entry string, clean long, toxic long").groupBy("half", "entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-entries")
    out = {}
    for r in counts.filter("entry = ''").collect():
        n0, n1 = r.clean, r.toxic
        if not n1:
            continue
        lift = ((F.col("toxic") + 0.5) / (n1 + 1)) / ((F.col("clean") + 0.5) / (n0 + 1))
        # an entry must be in five toxic rows or, where there are fewer than ten, in half of them, and in two
        least = max(2, min(max(5, n1 // 250), (n1 + 1) // 2))
        best = counts.filter((F.col("half") == r.half) & (F.col("entry") != "") & (F.col("toxic") >= least) & (lift >= 20))
        out[r.half] = [x.entry for x in best.orderBy((F.col("toxic") * F.log(lift)).desc(), "entry").limit(most_features).collect()]
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4096, most_features: int = 256, per_kind: int = 256, train: "F.Column | None" = None) -> Model:
    """Learn from ``docs (doc_id, text)``; ``labels (doc_id, toxic)`` has training rows only.

    ``per_class`` bounds the labelled rows of each class that lexicons are mined from, ``most_features``
    the entries of each half, ``per_kind`` the rows (of those where ``train`` holds) of each kind of votes
    that the classifier is fitted to; the label model sees the votes of all of ``docs``.
    """
    features = lexicons(mine(docs, labels, per_class, most_features))
    schema = "mask long, n long, hash long, hits array<int>, words long"

    def cast(batches):
        reader = Reader(features)
        count: dict[int, int] = {}
        rows: dict[int, dict[int, tuple[list[int], int]]] = {}
        for b in (x for whole in batches for x in common.small(whole)):
            for t, usable in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hits, m, words = reader(t or "")
                count[m] = count.get(m, 0) + 1
                if usable:
                    kept = rows.setdefault(m, {})
                    kept[xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1] = hits, words
                    if len(kept) >= 4 * per_kind:
                        rows[m] = dict(sorted(kept.items())[:per_kind])
        out = [(m, n, None, None, None) for m, n in count.items()]
        out += [(m, None, h, *kept[h]) for m, kept in rows.items() for h in sorted(kept)[:per_kind]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()), strict=True)], ["mask", "n", "hash", "hits", "words"])

    votes = common.stage(docs.select("text", (F.lit(True) if train is None else train).alias("usable")).mapInArrow(cast, schema), "votes")
    kinds = {r.mask: r.n for r in votes.filter("n IS NOT NULL").groupBy("mask").agg(F.sum("n").alias("n")).collect()}  # 2**VOTERS rows at most
    prior, rate, coupling, post = label_model(kinds)
    known = votes.filter("n IS NULL").dropDuplicates(["mask", "hash"]).withColumn("salt", F.pmod("hash", F.lit(256)))
    for keys in (("mask", "salt"), ("mask",)):  # a frequent kind has rows from all tasks: they are thinned in 256 shares first
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
        known = known.withColumn("nth", nth).filter(F.col("nth") <= per_kind)
    known = known.collect()  # per_kind rows a kind
    n = len(features.entries)
    weights = np.zeros(n + VOTERS - PATTERNS + 3)
    if known:
        of: dict[int, int] = {}
        for r in known:
            of[r.mask] = of.get(r.mask, 0) + 1
        known.sort(key=lambda r: (r.mask, r.hash))
        x = np.stack([vector(r.hits, r.mask, r.words, n) for r in known])
        y = np.array([post[r.mask] for r in known])
        # a row stands for the documents that voted as it does
        w = np.array([kinds[r.mask] / of[r.mask] for r in known])
        weights = linear(x, y, w * len(known) / w.sum())
    return Model(features, weights, prior, rate, coupling, post)


def scorer(model: Model):
    """text -> (score, vote mask)."""
    reader, n = Reader(model.features), len(model.features.entries)

    def score(text: str | None) -> tuple[float, int]:
        hits, mask, words = reader(text or "")
        z = float(vector(hits, mask, words, n) @ model.weights)
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z)))), mask

    return score


def predict(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted, votes`` for every row; ``docs`` has ``doc_id, held_out, text``."""

    def make():
        score = scorer(model)

        def f(batch):
            got = [score(t) for t in batch.column(2).to_pylist()]
            s = np.array([g[0] for g in got])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([g[1] for g in got], pa.int32())], ["doc_id", "held_out", "score", "predicted", "votes"])

        return f

    return common.arrow_map(docs, make, "doc_id long, held_out boolean, score double, predicted int, votes int")


def held_out() -> "F.Column":
    return common.crc_mod(F.col("doc_id"), 4) == 2


def learnable() -> "F.Column":
    return F.col("doc_id").isNotNull() & ~held_out()


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labelled rows that are not held out; score all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows.select("doc_id", held_out().alias("held_out"), "text"), fit(rows, labels.select("doc_id", "toxic").filter(~held_out()), train=learnable()))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, columns as they were: one map pass, no join."""
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "toxic").filter(~held_out()), train=learnable())
    at = docs.columns.index("text")

    def make():
        score = scorer(model)

        def f(batch):
            yield batch.filter(pa.array([score(t)[0] < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return f

    return common.arrow_map(docs, make, docs.schema)
