"""File operations through Hadoop's file systems, so that local and remote paths work alike."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

from .errors import OptionError


class Files:
    def __init__(self, spark: SparkSession):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._path(path)
        fs = p.getFileSystem(self._conf)
        return fs, fs.makeQualified(p)

    def full(self, path: str) -> str:
        """The path with its scheme."""
        text = str(self._at(path)[1].toString())
        return "file://" + text[5:] if text.startswith("file:/") and not text.startswith("file://") else text

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make_dirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, source: str, target: str) -> None:
        """Rename; a file in the way is replaced."""
        fs, s = self._at(source)
        t = self._at(target)[1]
        if fs.exists(t):
            fs.delete(t, True)
        if not fs.rename(s, t):
            raise OSError(f"cannot move {source} to {target}")
        with contextlib.suppress(Exception):  # the checksum file that local file systems move along
            fs.delete(self._path(t.getParent(), f".{t.getName()}.crc"), False)

    def list(self, path: str) -> list[str]:
        """Files in a folder, by name."""
        fs, p = self._at(path)
        return sorted(str(x.getPath().toString()) for x in fs.listStatus(p) if x.isFile())

    def folders(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(str(x.getPath().toString()) for x in fs.listStatus(p) if x.isDirectory())


    def glob(self, pattern: str) -> list[str]:
        """Files that match a pattern of Hadoop's: * ? [...] {a,b}, within one folder level each."""
        fs, p = self._at(pattern)
        return sorted(self.full(x.getPath().toString()) for x in (fs.globStatus(p) or ()) if x.isFile())


def remote(path: str) -> bool:
    """Whether the path names a file system other than the local one."""
    return "://" in path and not path.startswith("file:")


def _store(path: str):
    return arrow_fs.FileSystem.from_uri(path)


def opened(path: str):
    """A file for reading, by path or URI."""
    if not remote(path):
        return open(local(path), "rb")
    store, at = _store(path)
    return store.open_input_file(at)


def size(path: str) -> int:
    """Bytes of a file; an error where there is none."""
    if not remote(path):
        return os.path.getsize(local(path))
    store, at = _store(path)
    found = store.get_file_info(at)
    if found.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return found.size


def local(path: str) -> str:
    """A file URI as a plain path; other paths as they are."""
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path where driver and executors can write: under spark.checkpoint.dir, or, on a local master alone, a local one where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise OptionError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.gettempdir()
    return Files(spark).full(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
