"""Shared helpers: the cluster's shared folder, staged tables, row keys, token caches.

Placement rules that every operator follows:

* data that one task writes and another reads goes to the folder named by
  ``spark.checkpoint.dir`` (:func:`shared_dir`), never to a local disk;
* only tables with a proven size bound go to the driver or into a broadcast.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

#: Texts of one Arrow batch are handled in slices of about so many characters.
SLICE_CHARS = 4_000_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir`` (:func:`ferrule.sources.files.shared_folder`)."""
    return f"{shared_folder(spark)}/ferrule/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing will read any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def with_row(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with ``__row``, a key that is unique even when doc_id is null or repeated.

    The key is the row's place in the scan, so ``docs`` must be a table or file
    scan (a staged table qualifies): scans of the same files give equal keys.
    """
    return docs.select(F.monotonically_increasing_id().alias("__row"), *columns)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows that ``dropped (__row)`` names, columns as they were, whatever their names."""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct("*").alias("__doc"))
    return rows.join(dropped.select("__row"), "__row", "left_anti").select("__doc.*")


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of bounded size; null counts as empty."""
    run: list[str] = []
    size = begin = 0
    for i, t in enumerate(texts):
        t = t or ""
        if run and size + len(t) > SLICE_CHARS:
            yield begin, run
            run, size, begin = [], 0, i
        run.append(t)
        size += len(t)
    if run:
        yield begin, run


def small(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in views of a few rows each, so that what Python makes of one stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """``mapInArrow`` where ``make()`` builds a task's state and returns its per-batch function."""

    def run(batches):
        f = make()
        for b in batches:
            for part in small(b):
                yield from f(part)

    return df.mapInArrow(run, schema)


def single_threaded() -> None:
    """Spark gives a task one core; keep the tokenizer's own pool from taking more."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordIds(dict):
    """Token ids of white-space separated chunks, as little-endian uint16 bytes, cached.

    The vocabulary's normaliser maps runs of white space to one space and its
    pre-tokenizer drops spaces, so a text's ids are the concatenation of its
    chunks' ids.  A chunk of plain letters is one piece for the model, which is
    then asked directly; all others take the library's whole way.  When ``cap``
    chunks are held, those not seen since the last time that happened go.
    """

    def __init__(self, path: str, cap: int = 400_000):
        single_threaded()
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tok, self.cap, self.old = Tokenizer.from_file(path), cap, {}
        if self.tok.get_vocab_size() > 1 << 16:
            raise ValueError("ids are packed in 16 bits; this vocabulary has more")
        self.model, self.letters = self.tok.model, byte_letters()
        self.ends = {c: self._whole(c) for c in ".,"}

    def _whole(self, chunk: str) -> bytes:
        return array("H", self.tok.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            word, tail = chunk.lower(), b""
            if word[-1] in self.ends:
                word, tail = word[:-1], self.ends[word[-1]]
            if not word.isalpha() or max(word) >= "\u0300":  # from there on normal forms may differ
                got = self._whole(chunk)
            elif word == chunk:
                text = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                got = array("H", [t.id for t in self.model.tokenize(text)]).tobytes()
            else:  # what follows from another entry is not held
                return self[word] + tail
        self[chunk] = got
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t in texts:
            if len(self) > self.cap:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            chunks = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(np.frombuffer(b"".join(map(self.__getitem__, chunks)), "<u2"))
        return out


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The cache of this worker process; workers are reused from task to task."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def ids_crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def sum_arrays(rows: DataFrame) -> DataFrame:
    """Add int64 arrays, held as bytes, of rows ``name string, part int, data binary`` with the same name and part."""

    def add(table: pa.Table) -> pa.Table:
        total = None
        for x in table.column("data").to_pylist():
            x = np.frombuffer(x, np.int64)
            total = x.copy() if total is None else total + x
        return pa.table({"name": table.column("name").slice(0, 1), "part": table.column("part").slice(0, 1), "data": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy("name", "part").applyInArrow(add, "name string, part int, data binary")


def array_rows(arrays: dict[str, np.ndarray], width: int = 1 << 14) -> pa.RecordBatch:
    """A task's share of some arrays, in slices that :func:`sum_arrays` adds."""
    names, parts, data = [], [], []
    for name, x in arrays.items():
        for k in range(0, len(x), width):
            if (part := x[k : k + width]).any():
                names.append(name)
                parts.append(k // width)
                data.append(part.astype(np.int64).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.int32()), pa.array(data, pa.binary())], ["name", "part", "data"])


def gathered(rows: DataFrame, size: dict[str, int], width: int = 1 << 14) -> dict[str, np.ndarray]:
    """Summed arrays on the driver; ``size`` bounds what comes: each array has a fixed length."""
    out = {k: np.zeros(n, np.int64) for k, n in size.items()}
    for r in sum_arrays(rows).collect():
        x = np.frombuffer(r.data, np.int64)
        out[r.name][r.part * width : r.part * width + len(x)] = x
    return out


def filesystem(url: str):
    """The store of a shared folder and the folder's path in it, for Python tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def read_part(folder: str, part: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows that task ``part`` wrote to a staged table: Spark names files by the task's number."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = filesystem(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
        if info.base_name.startswith(f"part-{part:05d}-") and info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(columns=columns, batch_size=64)


def each_part(spark: SparkSession, folder: str, parts: int, columns: list[str], run: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``run(part, rows)`` in a task for each part of a table that ``repartitionById(parts, ...)`` dealt and that was then written to ``folder``."""

    def go(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                yield from run(part, read_part(folder, part, columns))

    return spark.range(0, parts, 1, parts).mapInArrow(go, schema)
