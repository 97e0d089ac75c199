"""Folders that change in one step: versions beside each other, and a marker that readers follow.

A version is written whole into a hidden folder of its own. Only then is the marker, a small file
that names the version, replaced by one rename. Whoever reads before that sees the old
version, whoever reads later the new one; a write that fails leaves the old one as it is. The version
before is kept for readers that have begun, older ones go.

A plain folder or file, written by other tools, is read as it is until something is published over it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARKER = "_CURRENT"
VERSION = "_version-"
ASIDE = ".before-versions"


class Folder:
    """A path of the Hadoop file system, with the few operations that publishing needs."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.context = self.jvm.org.apache.hadoop.fs.FileContext
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._at().getFileSystem(self.conf)

    def _at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def is_file(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self._at()).isFile()

    def read(self, name: str) -> str | None:
        """The text of a small file; None if there is none."""
        if not self.exists(name):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a small file beside ``name`` and rename it over it, which the file system does in one step."""
        new = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(new), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options
        rename = self.jvm.java.lang.reflect.Array.newInstance(options.Rename.OVERWRITE.getClass(), 1)
        rename[0] = options.Rename.OVERWRITE
        at = self._at(new)
        self.context.getFileContext(at.toUri() if at.isUriPathAbsolute() and at.toUri().getScheme() else self.fs.getUri(), self.conf).rename(
            self.fs.makeQualified(at), self.fs.makeQualified(self._at(name)), rename
        )

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at())] if self.exists() else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def current(spark: SparkSession, path: str) -> str:
    """Where the data of ``path`` lies now: its published version, or the plain path."""
    folder = Folder(spark, path)
    if folder.is_file():
        return path
    version = folder.read(MARKER)
    if version is not None:
        return f"{folder.path}/{version.strip()}"
    if not folder.exists() and Folder(spark, folder.path + ASIDE).exists():
        return folder.path + ASIDE  # a plain file that was being replaced
    return path


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write(folder)`` write a new version of ``path``, and make it the current one; returns its folder.

    ``write`` may read ``path`` itself. Publishing twice at once is not lost data but a race: the
    later marker wins.
    """
    folder = Folder(spark, path)
    if folder.is_file():
        return _publish_over_file(spark, folder, write)
    before = folder.read(MARKER)
    version = VERSION + uuid.uuid4().hex
    write(f"{folder.path}/{version}")
    folder.replace(MARKER, version)
    keep = {MARKER, version, (before or "").strip()}
    for name in folder.names():
        if name.startswith((VERSION, MARKER + ".")) and name not in keep:
            folder.delete(name)
    return f"{folder.path}/{version}"


def _publish_over_file(spark: SparkSession, folder: Folder, write: Callable[[str], None]) -> str:
    """A file cannot hold versions: the folder is made whole beside it, the file moves aside, the folder takes its name.

    Between the two renames readers find the file where it was moved.
    """
    staged = f"{folder.path}.{uuid.uuid4().hex}"
    version = publish(spark, staged, write).rsplit("/", 1)[1]
    aside = Folder(spark, folder.path + ASIDE)
    if aside.exists():
        aside.delete("")
    folder.fs.rename(folder._at(), aside._at())
    folder.fs.rename(Folder(spark, staged)._at(), folder._at())
    aside.delete("")
    return f"{folder.path}/{version}"
