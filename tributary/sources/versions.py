"""Outputs published at once: versioned folders and one commit marker each.

A run writes below a folder of its own, ``versions/<number>-<attempt>``, which
no reader looks at.  Its last act is to create ``_commits/<number>``
exclusively, with the folder's name as its only line.  Readers take the
highest complete marker, so they see one whole version, the old or the new:

* a run that fails, at any point, leaves the version before it in place;
* of two runs that start from one version only the first to end is published,
  the other gets :class:`VersionTaken`;
* a marker whose writer died has no full line; it is passed over and its
  number is not used again.

How exclusive the create is follows from the file system (one operation on
HDFS; a check and a create on a local disk, as in tests).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

COMMITS = "_commits"
VERSIONS = "versions"


class VersionTaken(RuntimeError):
    """Another run has committed this number."""


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _marker(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/{COMMITS}/{number:012d}"


def marker_text(spark: SparkSession, root: str, number: int) -> str | None:
    """What the marker of ``number`` says; None without a marker or with an incomplete one."""
    p, fs = _path(spark, _marker(root, number))
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine()
    finally:
        stream.close()
    return line[:-1] if line and line.endswith(";") else None


def commit(spark: SparkSession, root: str, number: int, text: str) -> None:
    """Create the marker of ``number``; :class:`VersionTaken` if there is one."""
    p, fs = _path(spark, _marker(root, number))
    try:
        stream = fs.create(p, False)
    except Py4JJavaError as err:
        if fs.exists(p):
            raise VersionTaken(f"version {number} of {root} is committed by another run") from err
        raise
    try:
        stream.write(bytearray(f"{text};\n".encode()))
    finally:
        stream.close()


def numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers that have a marker, newest first."""
    return sorted((int(n) for n in _names(spark, f"{root.rstrip('/')}/{COMMITS}") if n.isdigit()), reverse=True)


def newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and text of the newest complete marker; None before the first."""
    for n in numbers(spark, root):
        text = marker_text(spark, root, n)
        if text is not None:
            return n, text
    return None


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the published version; None before the first."""
    found = newest(spark, root)
    return None if found is None else f"{root.rstrip('/')}/{VERSIONS}/{found[1]}"


@contextmanager
def publish(spark: SparkSession, root: str) -> Iterator[str]:
    """A new version: write below the folder this yields; it is published when
    the block ends, and not at all when the block raises."""
    number = max(numbers(spark, root), default=-1) + 1
    name = f"{number:012d}-{uuid.uuid4().hex}"
    yield f"{root.rstrip('/')}/{VERSIONS}/{name}"
    commit(spark, root, number, name)


def remove_old(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete folders of all but the newest ``keep`` published versions, and of
    attempts whose number is taken; names of what went.

    An attempt above the newest number may still run and stays.  Readers of a
    version older than ``keep`` refreshes lose it.
    """
    if keep < 1:
        raise ValueError("the published version itself is never removed")
    taken = numbers(spark, root)
    texts = [t for t in (marker_text(spark, root, n) for n in taken) if t is not None]
    gone = []
    for name in _names(spark, f"{root.rstrip('/')}/{VERSIONS}"):
        if name not in texts[:keep] and taken and int(name.split("-")[0]) <= taken[0]:
            p, fs = _path(spark, f"{root.rstrip('/')}/{VERSIONS}/{name}")
            fs.delete(p, True)
            gone.append(name)
    return sorted(gone)


def remove_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)
