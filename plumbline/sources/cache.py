"""Cached tables that know what they were made under.

A cache is a folder with a table in `rows` and a small file that states its identity: settings, hashes of inputs,
versions. It is reused under the same identity, moved aside under another one, and refused if it holds rows that no
identity vouches for. All steps are renames through the file system that Spark uses, so a crash leaves either the
old folder, the folder moved aside, or a new one that names its identity.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources.sinks import Refused

IDENTITY, ROWS, DONE = "_identity.json", "rows", "_SUCCESS"


class _Files:
    """The few file operations that caches need, on any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._io = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) or not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"cannot rename {old} to {new}")

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """A whole file or none: written beside and renamed."""
        aside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(aside), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.rename(aside, path)


def identity_text(identity: dict) -> str:
    return json.dumps(identity, sort_keys=True, separators=(",", ":"), allow_nan=False)


def opened(spark: SparkSession, path: str, identity: dict, fresh: bool = False) -> tuple[str, str | None]:
    """Make `path` a cache of this identity; returns (state, where an old one was moved).

    new: there was none, or only leftovers of a writer that died before it named its identity. same: it is this
    identity's and stays. moved: it was another's, or `fresh` was asked for; the whole folder was renamed to
    `path`.stale-<hash of its identity>, with a number if that is taken. A folder with rows and no identity is
    refused, as is one whose identity cannot be read: nothing is known of its rows.
    """
    files, want = _Files(spark, path), identity_text(identity)
    state, aside = "new", None
    names = [n for n in files.names(path) if not (n.startswith("_") and n.endswith(".tmp"))]
    if IDENTITY in names:
        text = files.read(f"{path}/{IDENTITY}")
        try:
            have = identity_text(json.loads(text))
        except ValueError as e:
            raise Refused(f"{path}/{IDENTITY} is no JSON") from e
        if have == want and not fresh:
            return "same", None
        state = "moved"
        aside = stem = f"{path}.stale-{hashlib.sha256(have.encode()).hexdigest()[:12]}"
        turn = 2
        while files.exists(aside):
            aside, turn = f"{stem}-{turn}", turn + 1
        files.rename(path, aside)
    elif names:
        raise Refused(f"{path} holds {', '.join(names[:3])} and no {IDENTITY}")
    files.write(f"{path}/{IDENTITY}", want)
    return state, aside


def cached(spark: SparkSession, path: str, identity: dict, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The cached table of this identity, made and written first if it is not there in whole.

    Rows count as there when their writer has committed them; a folder of rows without that mark is of a writer that
    died and is overwritten.
    """
    opened(spark, path, identity, fresh)
    files = _Files(spark, path)
    if DONE not in files.names(f"{path}/{ROWS}"):
        make().write.mode("overwrite").parquet(f"{path}/{ROWS}")
    return spark.read.parquet(f"{path}/{ROWS}")
