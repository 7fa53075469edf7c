"""Small files and renames through the file system that Spark uses for a path, local or shared."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path, self._jvm, self._conf = path.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def rename(self, old: str, new: str) -> None:
        """Give a file or folder a name that is free."""
        if self.exists(new):
            raise FileExistsError(self.at(new))
        self._fs.mkdirs(self._path(new).getParent())
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {self.at(old)} to {self.at(new)}")

    def put(self, name: str, value: object) -> None:
        """A small JSON file under a name that is free: written beside it, then renamed."""
        beside = f".{uuid.uuid4().hex}"
        out = self._fs.create(self._path(beside), True)
        try:
            out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            out.close()
        self.rename(beside, name)

    def get(self, name: str) -> object | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()
