"""A folder of immutable segments and a manifest that names the live ones.

A segment is written under a name of its own and counts only once a manifest
lists it. Manifests are numbered; a new one is written aside and takes its number
by one rename, so a crash between any two steps leaves the state before or after
it, never a mixture. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

FORMAT = 1
KEPT_MANIFESTS = 2


class Folder:
    """The few file-system operations the log needs, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: object) -> str:
        return "/".join([self.root, *map(str, parts)])

    def _at(self, *parts: object):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(*parts))

    def names(self, *parts: object) -> list[str]:
        at = self._at(*parts)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def exists(self, *parts: object) -> bool:
        return self.fs.exists(self._at(*parts))

    def age_and_size(self, *parts: object) -> tuple[float, int]:
        """(last change, seconds since 1970; bytes) of what lies at a path."""
        at = self._at(*parts)
        return self.fs.getFileStatus(at).getModificationTime() / 1000, self.fs.getContentSummary(at).getLength()

    def move(self, source: tuple, target: tuple) -> None:
        self.fs.mkdirs(self._at(*target[:-1]))
        if self.fs.exists(self._at(*target)) or not self.fs.rename(self._at(*source), self._at(*target)):
            raise OSError(f"cannot rename {self.path(*source)} to {self.path(*target)}")

    def drop(self, *parts: object) -> None:
        self.fs.delete(self._at(*parts), True)

    def mark(self, *parts: object) -> None:
        self.fs.create(self._at(*parts), True).close()

    def write_text(self, text: str, *parts: object) -> None:
        out = self.fs.create(self._at(*parts), True)
        out.write(text.encode())
        out.close()

    def read_text(self, *parts: object) -> str:
        stream = self.fs.open(self._at(*parts))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Manifest:
    """The live segments below ``root``, oldest first, with a note for each."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.folder = Folder(spark, root)

    def _numbers(self) -> list[int]:
        return sorted(int(x) for x in self.folder.names("manifests") if x.isdigit())

    def live(self) -> dict[str, dict]:
        """Segment to note, in the order they were added. A manifest that can't be
        read, or of another format, gives way to the one before it."""
        for n in reversed(self._numbers()):
            try:
                said = json.loads(self.folder.read_text("manifests", n))
            except ValueError:
                continue
            if said.get("format") == FORMAT:
                return said["segments"]
        return {}

    def replace(self, segments: dict[str, dict]) -> None:
        """Makes ``segments`` the live ones, by one rename."""
        n = max([0, *self._numbers()]) + 1
        aside = f"_{uuid.uuid4().hex}"
        self.folder.write_text(json.dumps({"format": FORMAT, "segments": segments}), "manifests", aside)
        self.folder.move(("manifests", aside), ("manifests", n))

    def add(self, name: str, write: Callable[[str], None], **note: object) -> str:
        """Writes a segment (``write`` gets its path) and lists it. A live name
        stays as it is, so adding again after a crash or a replay changes nothing."""
        live = self.live()
        if name not in live:
            self.folder.drop("segments", name)
            write(self.folder.path("segments", name))
            self.replace({**live, name: note})
        return name

    def path(self, name: str) -> str:
        return self.folder.path("segments", name)

    def sweep(self) -> int:
        """Removes segments that no manifest lists, and old manifests. Readers of
        retired segments fail, so sweep when none are left. The number removed."""
        numbers = self._numbers()
        live = self.live()
        dead = [x for x in self.folder.names("segments") if x not in live]
        for x in dead:
            self.folder.drop("segments", x)
        for x in self.folder.names("manifests"):
            if not x.isdigit() or int(x) in numbers[:-KEPT_MANIFESTS]:
                self.folder.drop("manifests", x)
        return len(dead)


def fresh_name(label: str) -> str:
    """A segment name that no other writer or earlier run can have taken."""
    return f"{label}-{uuid.uuid4().hex[:16]}"
