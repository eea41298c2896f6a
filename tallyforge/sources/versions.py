"""A table in versions, with a pointer for each: a commit claims the next number, and only one writer can.

The data of a version lies in its own folder, written before the claim. The claim is a file made only where none is: by the file system's exclusive create.
A writer that lost reads the new state and tries again, a bounded number of times; nothing that another wrote is ever replaced unseen.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Raced(RuntimeError):
    """Other writers were faster each time."""


class Occupied(RuntimeError):
    """The table stands as another wrote it."""


class VersionedTable:
    """Versions 1, 2, ... of a table in a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, version: int) -> str:
        return f"{self.folder}/_pointers/{version:012d}"

    def version(self) -> int:
        """The latest version, 0 before the first."""
        path, files = self._hadoop(f"{self.folder}/_pointers")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def entry(self, version: int) -> dict:
        """What the pointer of a version says: data, owner, before."""
        path, files = self._hadoop(self._pointer(version))
        stream = files.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows, the latest by default; None before the first."""
        version = self.version() if version is None else version
        return self.spark.read.parquet(f"{self.folder}/{self.entry(version)['data']}") if version else None

    def _claim(self, version: int, text: str) -> bool:
        """Makes the pointer, and says whether it was this writer who did."""
        name = self._pointer(version)
        path, files = self._hadoop(name)
        files.mkdirs(path.getParent())
        if files.getUri().getScheme() == "file":
            # Hadoop's local file system looks before it creates; linking a whole file is one step
            local = path.toUri().getPath()
            half = f"{os.path.dirname(local)}/.{uuid.uuid4().hex}"
            with open(half, "w") as f:
                f.write(text)
            try:
                os.link(half, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(half)
        try:
            stream = files.create(path, False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def commit(self, rows: DataFrame, after: int, owner: str = "") -> int | None:
        """rows as the version after `after`; None if that number is taken, and then nothing of it is visible."""
        data = f"v{after + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        if self._claim(after + 1, json.dumps({"data": data, "owner": owner, "before": after})):
            return after + 1
        path, files = self._hadoop(f"{self.folder}/{data}")
        files.delete(path, True)
        return None

    def merge(self, change: Callable[[DataFrame | None], DataFrame], owner: str = "", tries: int = 4) -> int:
        """Swaps in change(the latest rows) where these still are the latest; else reads and changes anew, at most `tries` times, then raises Raced."""
        for _ in range(tries):
            now = self.version()
            done = self.commit(change(self.read(now)), now, owner)
            if done:
                return done
        raise Raced(f"{self.folder}: {tries} tries")

    def supersede(self, rows: DataFrame, owner: str) -> int:
        """Replaces the latest version where the owner wrote it, or the table is empty; raises Occupied where another did, Raced where one came between."""
        now = self.version()
        if now and self.entry(now)["owner"] != owner:
            raise Occupied(f"{self.folder}: version {now} is {self.entry(now)['owner'] or 'nobody'}'s")
        done = self.commit(rows, now, owner)
        if done is None:
            raise Raced(f"{self.folder}: version {now + 1}")
        return done
