"""File-system access for table metadata, through Hadoop's interface, so that any store Spark writes to will do."""

from __future__ import annotations

import contextlib
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

from ..errors import StorageError


#: Stores that rename by copying, one object over another.
COPYING = ("s3", "s3a", "s3n", "gs", "oss", "cos", "obs", "wasb", "wasbs", "swift")


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.gateway = spark.sparkContext._gateway
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def url(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def make(self, name: str) -> None:
        self.fs.mkdirs(self._path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(folder))) if self.exists(folder) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """A new file, whole or not at all as far as readers go; FileExistsError if the name is taken.

        The text goes to a file of its own first, which is then given the name: by a link on local
        disks, elsewhere by a rename that does not replace.  Object stores, whose renames are copies
        and replace what is there, are refused: two writers could both win.
        """
        if self.fs.getUri().getScheme() in COPYING:
            raise StorageError(f"{self.root}: this store's renames are not atomic; keep the tables on a file system")
        temp = f"_tmp/{uuid.uuid4().hex}"
        self.make("_tmp")
        if self.local:  # the kernel decides between two writers
            source, target = (self._path(n).toUri().getPath() for n in (temp, name))
            with open(source, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(source, target)
            finally:
                os.unlink(source)
            return
        with contextlib.closing(self.fs.create(self._path(temp), False)) as stream:
            stream.write(bytearray(text.encode()))
        try:
            plain = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._path(temp), self._path(name), plain)
        except Exception as e:
            self.delete(temp)
            if self.exists(name):
                raise FileExistsError(name) from e
            raise StorageError(f"cannot write {name}: {e}") from e

    def age(self, name: str) -> float:
        """Seconds since the file or folder changed; 0 if it is gone."""
        try:
            return max(0.0, time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000)
        except Exception:
            if self.exists(name):
                raise
            return 0.0

    def sync(self, folder: str) -> None:
        """Make the names in a folder durable (other stores than local disks do so by themselves)."""
        if self.local:
            handle = os.open(self._path(folder).toUri().getPath(), os.O_RDONLY)
            try:
                os.fsync(handle)
            finally:
                os.close(handle)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.  Unset, a temporary one is made, but only where driver and tasks share a machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise StorageError("spark.checkpoint.dir must name a folder that all of the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="ferrule-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
