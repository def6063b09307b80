"""Small files in any folder that Spark reaches: local paths, or URIs such as those of a cluster's own store."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def place(path: str | Path) -> str | Path:
    """A URI as it is; anything else as a local path."""
    return str(path).rstrip("/") if "://" in str(path) else Path(path)


def uri(path: str | Path) -> str:
    path = place(path)
    return path if isinstance(path, str) else f"file://{path.resolve()}"


def _reached(path: str | Path):
    """(file system, path) of the active session."""
    context = SparkSession.active().sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(uri(path))
    return target.getFileSystem(context._jsc.hadoopConfiguration()), target


def exists(path: str | Path) -> bool:
    system, target = _reached(path)
    return system.exists(target)


def make_folder(path: str | Path) -> None:
    """A new folder; FileExistsError if there is one."""
    system, target = _reached(path)
    if system.exists(target):
        raise FileExistsError(str(path))
    system.mkdirs(target)


def folders(path: str | Path) -> list[str]:
    """Names of the folders in ``path``."""
    system, target = _reached(path)
    return [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []


def write_text(path: str | Path, text: str) -> None:
    """Written whole or not at all: another name first, then renamed."""
    system, target = _reached(path)
    _, other = _reached(f"{uri(path)}.{uuid.uuid4().hex}")
    out = system.create(other)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(target, False)
    if not system.rename(other, target):
        raise OSError(f"{path} could not be written")


def read_text(path: str | Path) -> str:
    system, target = _reached(path)
    stream = system.open(target)
    try:
        return SparkSession.active().sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
