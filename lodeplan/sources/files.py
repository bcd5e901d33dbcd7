"""Small files on any file system that Spark reaches, through Hadoop's own interface."""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import EngineError


class Files:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        target = self.jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.conf)

    def list(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of the files in a folder; nothing for a folder that isn't there."""
        target, fs = self._at(path)
        try:
            found = fs.listStatus(target)
        except Py4JJavaError as error:
            if "FileNotFound" in str(error.java_exception.getClass()):
                return []
            raise EngineError("storage_error", str(error.java_exception)) from None
        return sorted((f.getPath().getName(), f.getLen()) for f in found if f.isFile())

    def folders(self, path: str) -> list[str]:
        """Names of the folders in a folder; none for one that isn't there."""
        target, fs = self._at(path)
        return sorted(f.getPath().getName() for f in fs.listStatus(target) if f.isDirectory()) if fs.exists(target) else []

    def walk(self, path: str) -> list[tuple[str, int]]:
        """Full paths and sizes of all Parquet files at or below a path."""
        target, fs = self._at(path)
        if not fs.exists(target):
            raise EngineError("not_found", f"nothing at {path}")
        out, found = [], fs.listFiles(target, True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet") and not f.getPath().getName().startswith(("_", ".")):
                out.append((f.getPath().toString(), f.getLen()))
        return sorted(out)

    def read(self, path: str) -> Any:
        target, fs = self._at(path)
        stream = fs.open(target)
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        except ValueError:
            raise EngineError("corruption", f"{path} is not a committed file") from None
        finally:
            stream.close()

    def commit(self, path: str, content: Any) -> None:
        """Create path with this content, all or nothing; the loser of a race gets storage_error.

        Where a rename doesn't replace a file (HDFS and its like) that decides the race; a local rename does
        replace, so there a hard link decides, which fails if the name is taken."""
        target, fs = self._at(path)
        temporary = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary, True)
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        stream.close()
        try:
            if fs.exists(target) or not self._placed(fs, temporary, target):
                raise EngineError("storage_error", f"{path} was committed by another writer; read again and retry")
        finally:
            fs.delete(temporary, False)

    def _placed(self, fs, temporary, target) -> bool:
        if fs.getUri().getScheme() != "file":
            return fs.rename(temporary, target)
        own, new = (self.jvm.java.io.File(p.toUri().getPath()).toPath() for p in (temporary, target))
        try:
            self.jvm.java.nio.file.Files.createLink(new, own)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass()):
                return False
            raise EngineError("storage_error", str(error.java_exception)) from None
        return True

    def delete(self, path: str) -> None:
        target, fs = self._at(path)
        fs.delete(target, True)

    def exists(self, path: str) -> bool:
        target, fs = self._at(path)
        return fs.exists(target)


class Log:
    """Numbered JSON commits in a folder; the last number wins."""

    def __init__(self, files: Files, path: str):
        self.files, self.path = files, path

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n, _ in self.files.list(self.path) if n.endswith(".json") and n[:-5].isdigit()]

    def entry(self, number: int) -> Any:
        return self.files.read(f"{self.path}/{number:08d}.json")

    def append(self, number: int, content: Any) -> None:
        self.files.commit(f"{self.path}/{number:08d}.json", content)

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.files.delete(f"{self.path}/{n:08d}.json")
