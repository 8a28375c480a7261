"""Exact deduplication by content-defined chunk recipes.

A text, less its white space, is cut where a rolling hash of its own bytes says
so; each distinct chunk gets one verified identifier, and two documents are the
same exactly when their ordered identifier lists are.  Texts are read once, by
the map tasks that cut them: what is shuffled is 36 bytes a chunk.

Skew: rows with the same recipe fold into one row on the map side before any
shuffle, so a text that holds a third of all rows moves once a task.  A chunk
shared by many recipes meets them in a sort-merge join that adaptive execution
can split.

Defined cases: null text counts as empty; all empty texts are one group; equal
``doc_id`` rows are separate rows (``__row`` breaks the tie and exactly one row
stays); null ``doc_id`` sorts after every other; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WHITE = bytes([0x20, *range(0x09, 0x0E)])
SIGNATURE = "__row long, doc_id long, n_chars long, text_sha256 string, recipe binary, shas array<binary>, sizes array<int>"


def cut_points(data: bytes, bits: int = 11, least: int = 256, most: int = 16384) -> list[int]:
    """Ends of content-defined chunks: a cut where the hash of the last 8 bytes has ``bits`` zero bits."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    h = np.zeros(n - 7, np.uint64)
    for k in range(8):
        h = h * np.uint64(0x9E3779B97F4A7C15) + b[k : n - 7 + k] + np.uint64(1)
    h ^= h >> np.uint64(29)
    ends = (np.flatnonzero((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits) == 0) + 8).tolist()
    cuts, at = [], 0
    for e in [*ends, n]:
        while e - at > most:
            at += most
            cuts.append(at)
        if e - at >= least or e == n and e > at:
            cuts.append(e)
            at = e
    return cuts


def signatures(docs: DataFrame) -> DataFrame:
    """One row a document: length, hash of the normalised text, and its chunks' SHA-256 and sizes."""

    def make():
        def f(batch):
            rows, ids, texts = (batch.column(i).to_pylist() for i in range(3))
            for begin, run in common.slices(texts):
                out = []
                for t in run:
                    raw = t.encode("utf-8", "surrogatepass").translate(None, WHITE)
                    cuts = cut_points(raw)
                    parts = [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]
                    shas = [hashlib.sha256(p).digest() for p in parts]
                    sizes = [len(p) for p in parts]
                    recipe = hashlib.sha256(b"".join(s + n.to_bytes(4, "little") for s, n in zip(shas, sizes, strict=True))).digest()
                    out.append((len(t), hashlib.sha256(raw).hexdigest(), recipe, shas, sizes))
                end = begin + len(run)
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[begin:end], pa.int64()), pa.array(ids[begin:end], pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.binary())), pa.array(cols[4], pa.list_(pa.int32()))],
                    ["__row", "doc_id", "n_chars", "text_sha256", "recipe", "shas", "sizes"],
                )

        return f

    return common.arrow_map(common.with_row(docs, F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SIGNATURE)


def groups(docs: DataFrame) -> DataFrame:
    """``__row, doc_id, keep_row, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    sig = common.stage(signatures(docs), "recipes")
    # the longest original, then the smallest id, then the first row, as one orderable value
    rank = F.struct(F.col("n_chars"), (-F.col("doc_id")).alias("neg_id"), (-F.col("__row")).alias("neg_row"))
    recipes = sig.groupBy("recipe").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    chunks = recipes.select("recipe", (-F.col("best.neg_row")).alias("__row")).join(sig.select("__row", "shas", "sizes"), "__row")
    chunks = chunks.select("recipe", F.posexplode(F.arrays_zip("shas", "sizes")).alias("pos", "c")).select("recipe", "pos", F.col("c.shas").alias("sha"), F.col("c.sizes").alias("size"))
    # one identifier per distinct chunk: the first place it was seen in; SHA-256 and size together verify it
    known = chunks.groupBy("sha", "size").agg(F.min(F.struct("recipe", "pos")).alias("chunk_id"))
    lists = chunks.join(known, ["sha", "size"]).groupBy("recipe").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk_id"))).alias("ids"))
    same = Window.partitionBy("ids")
    classes = (
        recipes.join(lists, "recipe", "left")
        .withColumn("ids", F.coalesce("ids", F.array().cast(lists.schema["ids"].dataType)))
        .select("recipe", F.sum("n").over(same).alias("group_size"), F.max("best").over(same).alias("best"))
    )
    out = sig.select("__row", "doc_id", "recipe", "text_sha256").join(classes, "recipe")
    keep_row = -F.col("best.neg_row")
    return out.select("__row", "doc_id", keep_row.alias("keep_row"), (-F.col("best.neg_id")).alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("__row") == keep_row).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were."""
    return common.without(docs, groups(docs).filter(~F.col("kept")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""
