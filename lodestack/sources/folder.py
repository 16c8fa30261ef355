"""A folder of small files on whatever file system Spark writes to: a disk, or storage that a cluster shares."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Files below a path. A path without a scheme is one of the working folder, as Spark takes it."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike) -> None:
        text = str(path)
        self.root = text.rstrip("/") if "://" in text or text.startswith("file:") else os.path.abspath(text)
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def make(self) -> None:
        self.fs.mkdirs(self._path(""))

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        """The text of a file; None if there is none."""
        try:
            stream = self.fs.open(self._path(name))
        except Py4JJavaError as error:
            if "FileNotFound" in error.java_exception.getClass().getName():
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """A new file; False if there is one."""
        try:
            self._write(name, text, False)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or self.exists(name):
                return False
            raise
        return True

    def replace(self, name: str, text: str) -> None:
        """A file that takes the place of another in one rename."""
        fresh = f"{name}.{uuid.uuid4().hex}"
        self._write(fresh, text, True)
        source, target = self._path(fresh), self._path(name)
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(self.conf).getUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.OVERWRITE.getClass(), 1)
        options[0] = rename.OVERWRITE
        files.rename(source, target, options)

    def move(self, name: str, to: str) -> bool:
        """Whether a file was there to be moved."""
        try:
            return self.fs.rename(self._path(name), self._path(to))
        except Py4JJavaError:
            return False

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self._path(""))]

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self._path(name)).getLength()
