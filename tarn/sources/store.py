"""Files of a table: listing, reading, deleting, and commits that only one writer wins."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import SparkSession

LOG = "_delta_log"


#: Schemes of stores whose create and rename two writers can both win.
NOT_ATOMIC = ("s3", "s3a", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")
#: A setting that says that there is one writer only, so that such a store will do.
ONE_WRITER = "tarn.commits.oneWriter"
THREADS = 16


class CommitExists(Exception):
    """Another writer has this version."""


@dataclass(frozen=True)
class FileInfo:
    path: str  # relative to the table's root, not encoded
    size: int
    modified: int  # milliseconds


def uri_of(path: str) -> str:
    """How Spark's _metadata.file_path spells an absolute path: one slash, illegal ASCII characters percent-encoded."""
    path = path.removeprefix("file://").removeprefix("file:")
    scheme, _, rest = path.rpartition("://") if "://" in path else ("", "", path)
    coded = re.sub(r"[^A-Za-z0-9_\-!.~'()*,;:$&+=@/\x80-\U0010ffff]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), rest)
    return f"{scheme}://{coded}" if scheme else f"file:{coded}"


def encoded(path: str) -> str:
    """A relative path as the log spells it."""
    return re.sub(r"[^A-Za-z0-9_\-.~/=:+,@!$&'()*;]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)


def decoded(path: str) -> str:
    return unquote(path)


class Store:
    """A table's root through Hadoop's file systems; local roots directly, for atomic creation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.local = self.root.removeprefix("file://") if self.root.startswith(("/", "file:///")) else None
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def absolute(self, path: str) -> str:
        return path if path.startswith("/") or "://" in path else f"{self.local or self.root}/{path}"

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.absolute(path))

    @property
    def fs(self):
        return self._path("").getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return os.path.exists(self.absolute(path)) if self.local else self.fs.exists(self._path(path))

    def read(self, path: str) -> bytes:
        if self.local:
            with open(self.absolute(path), "rb") as f:
                return f.read()
        stream = self.fs.open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        """Write or replace a file."""
        if self.local:
            os.makedirs(os.path.dirname(self.absolute(path)), exist_ok=True)
            aside = f"{self.absolute(path)}.{uuid.uuid4().hex}.tmp"
            with open(aside, "wb") as f:
                f.write(data)
            os.replace(aside, self.absolute(path))
            return
        stream = self.fs.create(self._path(path), True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def create(self, path: str, data: bytes) -> None:
        """Write a file that must not exist, whole or not at all; raise CommitExists if it does.

        Local files are linked, and elsewhere renamed, which HDFS refuses where the target is there. Object stores don't,
        so that they are refused, unless the session's setting ONE_WRITER is true.
        """
        scheme = self.root.split("://")[0] if "://" in self.root else ""
        if scheme in NOT_ATOMIC and self.spark.conf.get(ONE_WRITER, "false") != "true":
            raise OSError(f"commits to {scheme} aren't safe between writers; set {ONE_WRITER} to true if there is one only")
        if self.local:
            target = self.absolute(path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            aside = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.tmp")
            with open(aside, "wb") as f:
                f.write(data)
            try:
                os.link(aside, target)
            except FileExistsError:
                raise CommitExists(path) from None
            finally:
                os.unlink(aside)
            return
        aside = self._path(f"{os.path.dirname(path)}/.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside, False)
        try:
            stream.write(data)
        finally:
            stream.close()
        if self.fs.exists(self._path(path)) or not self.fs.rename(aside, self._path(path)):
            self.fs.delete(aside, False)
            raise CommitExists(path)

    def delete(self, path: str) -> bool:
        if self.local:
            try:
                os.unlink(self.absolute(path))
                return True
            except FileNotFoundError:
                return False
        return self.fs.delete(self._path(path), False)

    def existing(self, paths: Iterable[str]) -> Iterable[str]:
        """Those of the paths that are there, in order."""
        paths = list(paths)
        with ThreadPoolExecutor(THREADS) as pool:
            return [p for p, there in zip(paths, pool.map(self.exists, paths), strict=True) if there]

    def delete_all(self, paths: Iterable[str]) -> None:
        """Delete files, several at a time."""
        with ThreadPoolExecutor(THREADS) as pool:
            for _ in pool.map(self.delete, paths):
                pass

    def list(self, path: str = "", recursive: bool = False) -> list[FileInfo]:
        """Files under a folder; none if it isn't there."""
        top = self.absolute(path) if path else (self.local or self.root)
        if self.local:
            found = []
            for folder, _, names in os.walk(top):
                for name in names:
                    full = os.path.join(folder, name)
                    try:
                        stat = os.stat(full)
                    except FileNotFoundError:
                        continue
                    found.append(FileInfo(os.path.relpath(full, self.local), stat.st_size, int(stat.st_mtime * 1000)))
                if not recursive:
                    break
            return found
        target = self._jvm.org.apache.hadoop.fs.Path(top)
        if not self.fs.exists(target):
            return []
        found, files = [], self.fs.listFiles(target, recursive)
        prefix = self._path("").toUri().getPath().rstrip("/") + "/"
        while files.hasNext():
            f = files.next()
            found.append(FileInfo(f.getPath().toUri().getPath().removeprefix(prefix), f.getLen(), f.getModificationTime()))
        return found
