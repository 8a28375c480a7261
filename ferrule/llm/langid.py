"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training folds each task's texts into one count matrix (languages × buckets),
adds the matrices by slices of buckets, and broadcasts the log-probabilities:
its size is languages × ``2**bits`` × 4 bytes whatever the corpus, and more than
``most_languages`` are an error (raise the parameter), never a choice among them.  Scoring hashes a batch of texts at once and
adds log-probabilities by segment, in numpy.

Defined cases: text that is null or has no letter is ``und`` with score 0;
rows with a null language do not train; with no training rows everything is
``und``; ties go to the language that sorts first; the score is the winner's
posterior per-character-tempered, in 0 to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UND = "und"
SLICE = 1 << 12


def hashed(texts: list[str], orders: tuple[int, ...], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram order the bucket at each start, text after text; starts of each text.

    Texts are lower-cased and all that is no letter becomes a space.  A text has a gram
    at each character and at its end, all read as if spaces followed, never into another text.
    """
    low = [t.lower() for t in texts]
    pad = " " * max(orders)
    p = _letters(np.frombuffer(pad.join([*low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")).astype(np.uint64)
    lens = np.fromiter(map(len, low), np.int64, len(low)) + 1
    n = len(p)
    own = np.ones(n, bool)  # a text's characters and the first of the spaces after it
    ends = np.cumsum(lens + len(pad) - 1)
    for k in range(1, len(pad)):
        own[ends - k] = False
    ext = np.concatenate([p, np.full(max(orders), 32, np.uint64)])
    out, h = [], np.zeros(n, np.uint64)
    for k in range(max(orders)):
        h = (h + ext[k : n + k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
        if k + 1 in orders:
            out.append(((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int32)[own])
    return out, lens


_table: list[np.ndarray] = []


def _letters(points: np.ndarray) -> np.ndarray:
    """Code points with all but letters replaced by a space."""
    if not _table:
        _table.append(np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000))
    return _table[0][points]


def fit(docs: DataFrame, orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, most_languages: int = 512) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities from all rows of ``docs (text, lang)`` with a language."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for b in (x for whole in batches for x in common.small(whole)):
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for begin, run in common.slices(texts):
                names = langs[begin : begin + len(run)]
                for lang in set(names):
                    grams, _ = hashed([t for t, x in zip(run, names, strict=True) if x == lang], orders, bits)
                    total = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                    for g in grams:
                        total += np.bincount(g, minlength=1 << bits)
                if len(counts) > most_languages:
                    raise ValueError(f"more than {most_languages} languages")
        for lang, total in counts.items():
            parts = [total[k : k + SLICE].tobytes() for k in range(0, 1 << bits, SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["lang", "part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(x, np.int64)
        return pa.table({"lang": table.column("lang").slice(0, 1), "part": table.column("part").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.filter("lang IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, part int, counts binary")
    rows = rows.groupBy("lang", "part").applyInArrow(add, "lang string, part int, counts binary").collect()  # languages × 2**bits × 8 bytes
    langs = sorted({r.lang for r in rows})
    counts = np.zeros((len(langs), 1 << bits))
    for r in rows:
        counts[langs.index(r.lang), r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.counts, np.int64)
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)) if langs else counts
    return langs, logs.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], orders: tuple[int, ...] = (1, 2, 3), bits: int = 16, held_out: Column | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs (doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0], np.ascontiguousarray(model[1].T)))

    def make():
        langs, logs = shared.value

        def f(batch):
            texts = batch.column(2).to_pylist()
            for begin, run in common.slices(texts):
                m = len(run)
                known = [bool(langs) and any(c.isalpha() for c in t) for t in run]
                if langs:
                    grams, lens = hashed(run, orders, bits)
                    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                    total = np.zeros((m, len(langs)))
                    for g in grams:
                        for at in range(len(langs)):
                            total[:, at] += np.add.reduceat(logs[:, at][g].astype(np.float64), starts)
                    best = total.argmax(1)
                    tempered = (total - total.max(1, keepdims=True)) / np.sqrt(lens)[:, None]
                    score = 1 / np.exp(tempered).sum(1)
                else:
                    best, score = np.zeros(m, int), np.zeros(m)
                pred = [langs[k] if ok else UND for k, ok in zip(best.tolist(), known, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, m), batch.column(1).slice(begin, m), pa.array(pred), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(False) if held_out is None else held_out).alias("held_out"), "text")
    return common.arrow_map(rows, make, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` whose crc32(doc_id) mod 5 is not 0; judge all of them."""
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    return predict(docs, fit(docs.filter(~held)), held_out=held)
