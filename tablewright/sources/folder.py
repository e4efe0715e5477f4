"""Small metadata files next to the data, on any file system Spark can write to."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tablewright.errors import StorageError


class Folder:
    """A directory addressed through Hadoop's file system API, so it may be HDFS, S3 or local."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(conf)

    @staticmethod
    def files(spark: SparkSession, paths: list[str]) -> list[str]:
        """The files that paths, globs and folders name; hidden ones are passed over, as in any read."""
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        found = []
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            fs = at.getFileSystem(conf)
            matched = fs.globStatus(at) or []
            waiting = sorted(matched, key=lambda status: status.getPath().toString())
            while waiting:
                status = waiting.pop(0)
                if not status.isDirectory():
                    found.append(status.getPath().toString())
                    continue
                inside = [x for x in fs.listStatus(status.getPath()) if x.getPath().getName()[0] not in "_."]
                waiting = sorted(inside, key=lambda x: x.getPath().toString()) + waiting
        return found

    @staticmethod
    def first_line(spark: SparkSession, path: str) -> str:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(at)
        stream = at.getFileSystem(conf).open(at)
        try:
            plain = stream if codec is None else codec.createInputStream(stream)
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, "UTF-8"))
            return reader.readLine() or ""
        finally:
            stream.close()

    def child(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def url(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.url(name))

    def exists(self, name: str = ".") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        if not self.exists():
            return []
        listed = self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path))
        return sorted(status.getPath().getName() for status in listed)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def rename(self, name: str, to: str) -> bool:
        """One step on the file system; False when the file is gone or the target exists."""
        return self.exists(name) and not self.exists(to) and self._fs.rename(self._at(name), self._at(to))

    def create_json(self, name: str, value: dict) -> None:
        """Publish a file in one rename. Fails when it exists: somebody else was first."""
        if self.exists(name):
            raise StorageError(f"{self.url(name)} already exists")
        draft = f"_draft-{uuid.uuid4().hex}-{name}"
        stream = self._fs.create(self._at(draft), True)
        try:
            stream.write(bytearray(json.dumps(value).encode("utf-8")))
        finally:
            stream.close()
        if not self._fs.rename(self._at(draft), self._at(name)):
            raise StorageError(f"could not publish {self.url(name)}")
