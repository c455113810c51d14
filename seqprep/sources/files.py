"""Files and folders through Hadoop's file systems: any scheme that Spark reads."""

from __future__ import annotations

import contextlib
import gzip
import io
import os
import shutil
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class MultiPath:
    """protocol://root/path; / joins, - removes the first occurrence of another path."""

    prot: str
    root: str
    path: str

    @classmethod
    def parse(cls, text: str | MultiPath) -> MultiPath:
        if isinstance(text, MultiPath):
            return text
        text = str(text)
        if "://" not in text:
            return cls("", "", text)
        prot, rest = text.split("://", 1)
        if prot not in ("s3", "s3a", "file"):
            raise ValueError(f"unknown protocol {prot}")
        if prot == "file":
            return cls(prot, "", rest)
        root, _, path = rest.partition("/")
        return cls("s3", root, path)

    def __str__(self) -> str:
        return f"{self.prot}://{self.root}{'/' if self.root and self.path else ''}{self.path}" if self.prot else self.path

    @property
    def uri(self) -> str:
        """As Spark reads it."""
        return str(self).replace("s3://", "s3a://", 1) if self.prot == "s3" else str(self)

    @property
    def bucket(self) -> str:
        if self.prot != "s3":
            raise ValueError("not in an object store")
        return self.root

    @property
    def key(self) -> str:
        self.bucket  # noqa: B018
        return self.path

    def join(self, *more: str) -> MultiPath:
        return MultiPath(self.prot, self.root, "/".join([self.path.rstrip("/"), *(str(m).strip("/") for m in more)]) if self.path else "/".join(str(m).strip("/") for m in more))

    __truediv__ = join

    def __sub__(self, other: MultiPath | str) -> MultiPath:
        o = MultiPath.parse(other)
        if o.prot and (o.prot, o.root) != (self.prot, self.root):
            raise ValueError("paths in different places")
        return MultiPath(self.prot if not o.prot else "", self.root if not o.prot else "", self.path.replace(o.path, "", 1).lstrip("/"))

    def __eq__(self, other: object) -> bool:
        return isinstance(other, (str, MultiPath, os.PathLike)) and str(self) == str(MultiPath.parse(str(other)))

    def __hash__(self) -> int:
        return hash(str(self))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(MultiPath.parse(path).uri if "://" not in path or path.split("://")[0] in ("s3", "s3a", "file") else path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_dir(spark: SparkSession, path: str, raise_if_missing: bool = False) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        if raise_if_missing:
            raise FileNotFoundError(path)
        return False
    return fs.getFileStatus(p).isDirectory()


def is_file(spark: SparkSession, path: str, raise_if_missing: bool = False) -> bool:
    return not is_dir(spark, path, raise_if_missing) and exists(spark, path)


def list_files(spark: SparkSession, path: str, ignore_hidden: bool = True, include_dirs: bool = False, include_files: bool = True) -> Iterator[str]:
    """Everything below a folder; a file yields itself."""
    fs, p = _fs(spark, path)
    if not fs.getFileStatus(p).isDirectory():
        if include_files:
            yield path
        return
    for s in sorted(fs.listStatus(p), key=lambda s: s.getPath().toString()):
        name, full = s.getPath().getName(), s.getPath().toString()
        if ignore_hidden and name.startswith("."):
            continue
        if s.isDirectory():
            if include_dirs:
                yield full
            yield from list_files(spark, full, ignore_hidden, include_dirs, include_files)
        elif include_files:
            yield full


def copy_directory(spark: SparkSession, src: str, dst: str, ignore_hidden_files: bool = True, skip_if_empty: bool = False) -> None:
    fs, p = _fs(spark, src)
    base = fs.getFileStatus(p).getPath().toString()
    to, target = _fs(spark, dst)
    jvm = spark._jvm
    for f in list_files(spark, src, ignore_hidden_files):
        source = jvm.org.apache.hadoop.fs.Path(f)
        if skip_if_empty and not fs.getFileStatus(source).getLen():
            continue
        place = jvm.org.apache.hadoop.fs.Path(target.toString() + "/" + (f[len(base) :].lstrip("/") or source.getName()))
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, place, False, spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all in it."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(df: DataFrame, path: str, mode: str = "overwrite", skip_if_empty: bool = False, compression: str | None = None) -> None:
    if not (skip_if_empty and df.isEmpty()):
        df.write.mode(mode).text(path, compression=compression)


@contextlib.contextmanager
def decompress_stream(stream: io.BufferedIOBase, mode: str = "rt", encoding: str = "utf-8"):
    """A gzip or zlib stream as plain bytes or text."""
    data = io.BufferedReader(gzip.GzipFile(fileobj=stream)) if stream.peek(2)[:2] == b"\x1f\x8b" else io.BytesIO(zlib.decompress(stream.read()))
    yield data if "b" in mode else io.TextIOWrapper(data, encoding=encoding)


@contextlib.contextmanager
def compress_stream(stream: io.BufferedIOBase, mode: str = "wt", encoding: str = "utf-8"):
    with gzip.GzipFile(fileobj=stream, mode="wb") as z:
        out = z if "b" in mode else io.TextIOWrapper(z, encoding=encoding)
        yield out
        out.flush()


@contextlib.contextmanager
def upload_on_success(spark: SparkSession, remote_path: str, local_path: str, keep_local: bool = False):
    """Copy a driver-side folder to remote_path if the body ends well, then delete it; DataFrames are written in place instead."""
    os.makedirs(local_path, exist_ok=True)
    yield local_path
    copy_directory(spark, f"file://{os.path.abspath(local_path)}", remote_path)
    if not keep_local:
        shutil.rmtree(local_path)
