"""Small files that the driver reads and publishes, in whatever store a path names.

Paths without a scheme and file: paths are local; all others go through Hadoop's file
systems, which Spark brings along. publish() is what commits rest on: it fails if the name
exists, whoever else tries at the same time (a link locally, a rename that overwrites
nothing elsewhere).
"""

from __future__ import annotations

import os
import shutil
import uuid
from abc import ABC, abstractmethod

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files(ABC):
    @abstractmethod
    def names(self, folder: str) -> list[str]: ...

    @abstractmethod
    def exists(self, path: str) -> bool: ...

    @abstractmethod
    def read(self, path: str) -> str: ...

    @abstractmethod
    def write(self, path: str, text: str) -> None:
        """All of the text or none; what was there is replaced."""

    @abstractmethod
    def publish(self, path: str, text: str) -> bool:
        """Write a file under a new name; False if it exists."""

    @abstractmethod
    def make(self, folder: str) -> None: ...

    @abstractmethod
    def delete(self, path: str) -> None: ...

    @abstractmethod
    def rename(self, path: str, to: str) -> None: ...

    @abstractmethod
    def copy(self, path: str, to: str) -> None:
        """A file or a folder with all in it."""

    @abstractmethod
    def size(self, folder: str) -> int:
        """Bytes of all files below."""

    @abstractmethod
    def free(self, folder: str) -> int: ...


class LocalFiles(Files):
    def names(self, folder):
        return sorted(os.listdir(_local(folder)))

    def exists(self, path):
        return os.path.exists(_local(path))

    def read(self, path):
        with open(_local(path)) as f:
            return f.read()

    def _written(self, path: str, text: str) -> str:
        tmp = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}"
        with open(tmp, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        return tmp

    def _sync(self, folder: str) -> None:
        fd = os.open(folder, os.O_RDONLY)
        os.fsync(fd)
        os.close(fd)

    def write(self, path, text):
        os.replace(self._written(_local(path), text), _local(path))

    def publish(self, path, text):
        path = _local(path)
        tmp = self._written(path, text)
        try:
            os.link(tmp, path)
        except FileExistsError:
            return False
        finally:
            os.unlink(tmp)
        self._sync(os.path.dirname(path))
        return True

    def make(self, folder):
        os.makedirs(_local(folder), exist_ok=True)

    def delete(self, path):
        path = _local(path)
        if os.path.isdir(path):
            shutil.rmtree(path)
        elif os.path.exists(path):
            os.unlink(path)

    def rename(self, path, to):
        os.rename(_local(path), _local(to))

    def copy(self, path, to):
        path, to = _local(path), _local(to)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        shutil.copytree(path, to, dirs_exist_ok=True) if os.path.isdir(path) else shutil.copy(path, to)

    def size(self, folder):
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(_local(folder)) for f in names if os.path.exists(f"{d}/{f}"))

    def free(self, folder):
        return shutil.disk_usage(_local(folder)).free


class HadoopFiles(Files):
    def __init__(self, spark: SparkSession):
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs_ = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils

    def _at(self, path: str):
        p = self.fs_.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, folder):
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p))

    def exists(self, path):
        p, fs = self._at(path)
        return fs.exists(p)

    def read(self, path):
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _written(self, path: str, text: str) -> str:
        tmp = f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        p, fs = self._at(tmp)
        stream = fs.create(p, True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        return tmp

    def _move(self, path: str, to: str, *options) -> None:
        kinds = self.gateway.new_array(self.fs_.Options.Rename, len(options))
        for i, x in enumerate(options):
            kinds[i] = x
        p, fs = self._at(path)
        self.fs_.FileContext.getFileContext(fs.getUri(), self.conf).rename(p, self.fs_.Path(to), kinds)

    def write(self, path, text):
        self._move(self._written(path, text), path, self.fs_.Options.Rename.OVERWRITE)

    def publish(self, path, text):
        tmp = self._written(path, text)
        try:
            self._move(tmp, path)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.delete(tmp)
            return False
        return True

    def make(self, folder):
        p, fs = self._at(folder)
        fs.mkdirs(p)

    def delete(self, path):
        p, fs = self._at(path)
        fs.delete(p, True)

    def rename(self, path, to):
        self._move(path, to)

    def copy(self, path, to):
        p, fs = self._at(path)
        q, other = self._at(to)
        other.mkdirs(q.getParent())
        self.fs_.FileUtil.copy(fs, p, other, q, False, self.conf)

    def size(self, folder):
        p, fs = self._at(folder)
        return fs.getContentSummary(p).getLength()

    def free(self, folder):
        p, fs = self._at(folder)
        return fs.getStatus(p).getRemaining()


def _local(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def files_of(spark: SparkSession, path: str) -> Files:
    return LocalFiles() if ":" not in path.split("/")[0] or path.startswith("file:") else HadoopFiles(spark)
