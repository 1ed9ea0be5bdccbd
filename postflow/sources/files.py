"""Small files next to a store's tables, through the Hadoop file system: claims that
only one writer gets, and the manifest of a version."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _open(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._open(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._open(path)
        fs.delete(p, True)

    def matching(self, pattern: str) -> list[str]:
        """Paths that match a glob pattern, in order."""
        fs, p = self._open(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])

    def create(self, path: str, text: str) -> bool:
        """Create a file with its whole text, unless it exists: of writers that try at
        once, one gets True."""
        fs, p = self._open(path)
        fs.mkdirs(p.getParent())
        if fs.getScheme() == "file":
            # the local file system checks and then creates; a hard link does both at once
            target = p.toUri().getPath()
            draft = f"{target}.{uuid.uuid4().hex}"
            with open(draft, "w", encoding="utf-8") as f:
                f.write(text + "\n")
            try:
                os.link(draft, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        try:
            out = fs.create(p, False)
        except Exception as exc:  # noqa: BLE001 - py4j wraps what the file system throws
            if fs.exists(p):
                return False
            raise exc
        out.write(bytearray((text + "\n").encode()))
        out.close()
        return True

    def read(self, path: str, wait_seconds: float = 10.0) -> str:
        """The text of a file that `create` made; waits for a writer still at it."""
        end = time.monotonic() + wait_seconds
        while True:
            fs, p = self._open(path)
            stream = fs.open(p)
            try:
                text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return text[:-1]
            if time.monotonic() > end:
                raise TimeoutError(f"{path} was not written to its end")
            time.sleep(0.1)
