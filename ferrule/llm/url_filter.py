"""URL filter: rules first, then naive Bayes over segmented host and path tokens.

Host labels are concatenated names, so a unigram model cuts them into words by
Viterbi.  Its counts come from all pages' text and from host labels that their
owners cut themselves (hyphens).  They are exact at any size: only substrings of
labels are ever asked for, so the distinct hosts' substrings are joined with the
table of counts, and each host is cut once, with the counts that came for it; labels
of any length and number are cut whole, into words of up to ``LONGEST`` characters.
A multinomial naive Bayes model over hashed tokens then learns from all urls: those
with a seed word among the words of their host are examples of the class to block,
all others of the class to allow.  What it learns are the other words of such hosts
and paths, so that a host without any seed word is blocked for the company it keeps.

Defined cases: a null url or one without ``://`` has empty host and path and no
tokens, which the prior decides (allow); nothing is learned from it.  Equal urls
are judged alike, row by row; a null page_id is an id like any other.  Columns other than page_id, url, html are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path): the host and all its subdomains, paths that start so.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words that mark a host as one to block.
SEEDS = ("casino", "poker", "bets", "lottery", "pills", "viagra", "adult", "porn", "xxx", "spam", "ads", "warez")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word in a host has at most as many characters as a label of the domain name system may have.
COUNT_BITS, TOKEN_BITS, LONGEST = 18, 18, 63
TAG, TEXT_WORD, LABEL_WORD, PATH_TOKEN = re.compile(r"<[^>]*>"), re.compile(r"[^\W\d_]{2,}"), re.compile(r"[^\W_]+"), re.compile(r"[^\W_]+")


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _slots(word: str, bits: int) -> tuple[int, int]:
    h = xxhash.xxh3_64_intdigest(word)
    return h & ((1 << bits) - 1), (h >> 32) & ((1 << bits) - 1)


@dataclass
class Unigrams:
    """Unigram costs and cuts, with a count-min table of word counts (:class:`Words` has exact ones)."""

    rows: np.ndarray  # 2 × 2**COUNT_BITS
    total: int

    def count(self, word: str) -> int:
        a, b = _slots(word, COUNT_BITS)
        return int(min(self.rows[0, a], self.rows[1, b]))

    def cost(self, word: str) -> float:
        n = self.count(word)
        return math.log((self.total + 1) / n) if n else math.log(self.total + 1) + 2.3 * len(word)

    def segment(self, name: str) -> list[str]:
        """The cheapest cut of ``name``; of equal ones, that with the longest last word."""
        best, back = [0.0], [0]
        for i in range(1, len(name) + 1):
            c, j = min((best[j] + self.cost(name[j:i]), j) for j in range(max(0, i - LONGEST), i))
            best.append(c)
            back.append(j)
        out, i = [], len(name)
        while i:
            out.append(name[back[i] : i])
            i = back[i]
        return out[::-1]


class Words(Unigrams):
    """Exact counts, of the words that one host can hold."""

    def count(self, word: str) -> int:
        return self.rows.get(word, 0)


def labels(host: str) -> list[str]:
    return LABEL_WORD.findall(host)


def path_tokens(path: str) -> list[str]:
    return ["0" if t.isdigit() else t for t in PATH_TOKEN.findall(path.lower())]


def counted(pages: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``pages (host, html)``."""

    def count(batches):
        found: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = [w for label in host.split(".") if "-" in label for w in LABEL_WORD.findall(label)]
                for w in own + TEXT_WORD.findall(TAG.sub(" ", html or "").lower()):
                    found[w] = found.get(w, 0) + 1
                if len(found) > 300_000:
                    yield out()
                    found = {}
        if found:
            yield out()

    return pages.select("host", "html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def host_words(pages: DataFrame, seeds=SEEDS) -> DataFrame:
    """``host, words``: the cut of every distinct host of ``pages (host, html)``."""
    counts = common.stage(counted(pages), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    extra = 1 + total // 100_000  # seed words are words, however rare
    hosts = common.stage(pages.select("host").distinct(), "hosts")

    def spans(batches):
        for b in batches:
            for host in b.column(0).to_pylist():
                subs = {x[i:j] for x in labels(host) for i in range(len(x)) for j in range(i + 1, min(len(x), i + LONGEST) + 1)}
                subs = list(subs)
                for k in range(0, len(subs), 10_000):
                    part = subs[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([host] * len(part), pa.string()), pa.array(part, pa.string())], ["host", "word"])

    known = hosts.mapInArrow(spans, "host string, word string").join(counts, "word").groupBy("host").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def cut(batches):
        for b in batches:
            out = []
            for host, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = {k["word"]: k["n"] for k in known or ()}
                rows.update((s, rows.get(s, 0) + extra) for s in seeds)
                words = Words(rows, total)
                out.append([w for x in labels(host) for w in words.segment(x)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], ["host", "words"])

    return hosts.join(known, "host", "left").select("host", "known").mapInArrow(cut, "host string, words array<string>")


def bayes(urls: DataFrame, seeds=SEEDS) -> np.ndarray:
    """Counts of hashed tokens (2 classes × 2**TOKEN_BITS) and, in a last column, of urls; from all of ``urls (host, path, words)``."""
    seeds = frozenset(seeds)

    def count(batches):
        rows = np.zeros((2, 1 << TOKEN_BITS), np.int64)
        n = np.zeros(2, np.int64)
        for b in batches:
            for host, path, h in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if host or path:
                    y = 0 if seeds.isdisjoint(h) else 1
                    n[y] += 1
                    for t in (*h, *path_tokens(path)):
                        rows[y, _slots(t, TOKEN_BITS)[0]] += 1
        yield common.array_rows({"0": rows[0], "1": rows[1], "n": n})

    got = common.gathered(urls.select("host", "path", "words").mapInArrow(count, "name string, part int, data binary"), {"0": 1 << TOKEN_BITS, "1": 1 << TOKEN_BITS, "n": 2})
    return np.concatenate([np.stack([got["0"], got["1"]]), got["n"][:, None]], axis=1)


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row of ``pages (page_id, url, html)``; score: log-odds to block."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    spark = pages.sparkSession
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    asked = rows.select(F.col("page_id").cast("long").alias("page_id"), "host", "path", rule.alias("rule"), verdict.alias("fixed"))
    asked = common.stage(asked.join(host_words(rows, seeds), "host").select("page_id", "host", "path", "rule", "fixed", "words"), "cut")
    counts = bayes(asked, seeds)
    n, counts = counts[:, -1], counts[:, :-1]
    logs = np.log(counts + 0.01) - np.log(counts.sum(1, keepdims=True) + 0.01 * counts.shape[1])
    odds = spark.sparkContext.broadcast(((logs[1] - logs[0]).astype(np.float32), float(np.log((n[1] + 1) / (n[0] + 1)))))

    def make():
        weight, prior = odds.value

        def f(batch):
            score = []
            for p, h in zip(batch.column(2).to_pylist(), batch.column(5).to_pylist(), strict=True):
                score.append(prior + float(sum(weight[_slots(t, TOKEN_BITS)[0]] for t in (*h, *path_tokens(p)))))
            verdict = ["block" if s > 0 else "allow" for s in score]
            final = [v or w for v, w in zip(batch.column(4).to_pylist(), verdict, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(final), pa.array(score)], ["page_id", "host", "path", "rule", "verdict", "score"])

        return f

    return common.arrow_map(asked, make, "page_id long, host string, path string, rule string, verdict string, score double")
