"""Small files and names on any file system that Spark can reach, by path or URI.

A path without a scheme is one of the mounted file system.  Only names and control files pass through
here; texts and tables are read and written by tasks.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

URI = r"[A-Za-z][A-Za-z0-9+.-]*://"
EXISTS = ("FileAlreadyExistsException", "already exists")


def is_uri(path: object) -> bool:
    return re.match(URI, str(path)) is not None


def reached(path: object) -> str:
    """``path`` as Spark's readers and writers need it, whatever their default file system is."""
    return "file://" + str(path) if str(path).startswith("/") else str(path)


def mounted(uri: object) -> str:
    """A file URI as the plain path that it means; others as they are."""
    return re.sub("^file:/+", "/", str(uri))


def joined(folder: object, *names: str) -> str:
    return "/".join([str(folder).rstrip("/"), *names])


def literal(path: object) -> str:
    """``path`` as a pattern that fits itself alone: brackets in names are no patterns."""
    return reached(re.sub(r"([\[\]{}*?\\])", r"\\\1", str(path)))


class Located(str):
    """The URI of a file, with the parts of its name that a pathlib path has."""

    @property
    def name(self) -> str:
        return self.rpartition("/")[2]

    @property
    def parent(self) -> Located:
        return Located(self.rpartition("/")[0])


class Store:
    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway, self.conf = spark._jvm, spark.sparkContext._gateway, spark._jsc.hadoopConfiguration()
        self.local = None
        self.fs_package = self.jvm.org.apache.hadoop.fs

    def at(self, path: object) -> tuple:
        """The file system of ``path`` and the path there; a local one without checksum files, as people edit what it holds."""
        found = self.fs_package.Path(reached(path))
        if mounted(path) == str(path) and is_uri(path):
            return found.getFileSystem(self.conf), found
        if self.local is None:
            self.local = self.fs_package.RawLocalFileSystem()
            self.local.initialize(self.jvm.java.net.URI("file:///"), self.conf)
        return self.local, found

    def exists(self, path: object) -> bool:
        fs, found = self.at(path)
        return fs.exists(found)

    def is_folder(self, path: object) -> bool:
        fs, found = self.at(path)
        return fs.exists(found) and fs.getFileStatus(found).isDirectory()

    def full(self, path: object) -> Located:
        """``path``, or one of Spark's default file system, with its scheme and authority, as readers name it; mounted ones without."""
        found = self.fs_package.Path(str(path))
        return Located(mounted(found.getFileSystem(self.conf).makeQualified(found).toString()))

    def names(self, folder: object) -> list[tuple[str, bool]]:
        """(name, whether it is a folder) of what ``folder`` holds; nothing where it does not exist."""
        fs, found = self.at(folder)
        return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(found)] if fs.exists(found) else []

    def found(self, pattern: str) -> list[str]:
        """The paths that fit a pattern, whose fixed part holds no pattern's characters."""
        fs, path = self.at(pattern)
        return [mounted(s.getPath().toString()) for s in fs.globStatus(path)]

    def make(self, folder: object) -> None:
        fs, found = self.at(folder)
        fs.mkdirs(found)

    def read(self, path: object) -> str:
        fs, found = self.at(path)
        if not fs.exists(found):
            raise FileNotFoundError(str(path))
        stream = fs.open(found)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8-sig")
        finally:
            stream.close()

    def beside(self, path: object, text: str) -> str:
        """``text`` in a new file in the folder of ``path``."""
        folder, _, name = str(path).rpartition("/")
        part = joined(folder, f".{name}-{uuid.uuid4().hex}") if folder else f".{name}-{uuid.uuid4().hex}"
        fs, found = self.at(part)
        stream = fs.create(found, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return part

    def write(self, path: object, text: str) -> None:
        """The whole text or nothing of it: written beside, then renamed."""
        self.move(self.beside(path, text), path)

    def create(self, path: object, text: str) -> bool:
        """Make a file with ``text``; False, and no change, where there is one already.  Of writers at one time one succeeds."""
        part = self.beside(path, text)
        fs, found = self.at(part)
        try:
            if fs.getUri().getScheme() == "file":
                files, of = self.jvm.java.nio.file.Files, lambda p: self.jvm.java.io.File(self.at(p)[1].toUri().getPath()).toPath()
                files.createLink(of(path), of(part))
            else:
                self.rename(part, path, "NONE")
        except Py4JJavaError as error:
            if not any(word in str(error.java_exception) for word in EXISTS):
                raise
            return False
        finally:
            fs.delete(found, False)
        return True

    def rename(self, old: object, new: object, how: str) -> None:
        fs, found = self.at(old)
        if fs.getUri().getScheme() == "file":  # one call of the system, which puts the new file in the place of an old one
            if not fs.rename(found, self.fs_package.Path(reached(new))):
                raise OSError(f"cannot rename {old} to {new}")
            return
        rename = getattr(self.fs_package, "Options$Rename")
        options = self.gateway.new_array(rename, 1)
        options[0] = getattr(rename, how)
        context = self.fs_package.FileContext.getFileContext(found.toUri(), self.conf)
        context.rename(found, self.fs_package.Path(reached(new)), options)

    def move(self, old: object, new: object) -> None:
        """Put the file ``old`` in the place of ``new``, whole at any time where the file system renames atomically."""
        folder = str(new).rpartition("/")[0]
        if folder:
            self.make(folder)
        self.rename(old, new, "OVERWRITE")

    def copy(self, old: object, new: object) -> None:
        """Copy a file's bytes beside its new place, then rename."""
        folder, _, name = str(new).rpartition("/")
        part = joined(folder, f".{name}-{uuid.uuid4().hex}")
        self.make(folder)
        from_fs, from_ = self.at(old)
        to_fs, to = self.at(part)
        self.fs_package.FileUtil.copy(from_fs, from_, to_fs, to, False, self.conf)
        self.move(part, new)

    def remove(self, path: object) -> None:
        fs, found = self.at(path)
        fs.delete(found, True)
