"""Folder moves through the file system that Spark uses for a path."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

KEPT = ".kept"


def _at(spark: SparkSession, path: str):
    """File system and path object of a path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _at(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no such folder."""
    fs, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False when somebody has created it before."""
    fs, place = _at(spark, path)
    fs.mkdirs(place.getParent())
    if fs.exists(place):
        return False
    try:
        return bool(fs.createNewFile(place))
    except Exception:  # lost to a writer that came in between
        if fs.exists(place):
            return False
        raise


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, place = _at(spark, source)
    if not fs.rename(place, _at(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def drop(spark: SparkSession, path: str) -> None:
    fs, place = _at(spark, path)
    fs.delete(place, True)


def mended(spark: SparkSession, path: str) -> None:
    """Bring back what a replacement that was cut off had set aside."""
    path = path.rstrip("/")
    if not exists(spark, path) and exists(spark, path + KEPT):
        move(spark, path + KEPT, path)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Replace a folder by what ``write`` puts into a new one.

    All rows are written before the old files are touched, so they may be computed from
    the folder itself. The old files are set aside until the new ones stand.
    """
    path = path.rstrip("/")
    head, dot, kind = path.rpartition(".")
    new = f"{head}.{uuid.uuid4().hex}.{kind}" if dot and "/" not in kind else f"{path}.{uuid.uuid4().hex}"
    mended(spark, path)
    write(new)
    if exists(spark, path):
        drop(spark, path + KEPT)
        move(spark, path, path + KEPT)
    move(spark, new, path)
    drop(spark, path + KEPT)
