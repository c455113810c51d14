"""Rows from files whose paths are in a column, and from several datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any, ClassVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.core import ORDER, FieldError, Operator
from ..plans.storage import numbered


def _paths(df: DataFrame, field: str) -> list[str]:
    """The file list: read on the driver, as Spark itself does with lists of files."""
    c = F.explode(field) if isinstance(df.schema[field].dataType, T.ArrayType) else F.col(field)
    order = [ORDER] if ORDER in df.columns else []
    rows = df.select(*order, c.alias("path"))
    return [r.path for r in (rows.orderBy(ORDER) if order else rows).toLocalIterator()]


@dataclass(frozen=True, eq=False, repr=False)
class LoadCsv(Operator):
    """CSV files as rows of texts; headers names the columns of files without a header line. Compression by file suffix.

    Each file's cells go to the columns that its own header line names: files with one header line are one scan, the scans are united by name, and columns that a
    file lacks are null in its rows, like the missing cells of a short line. Cells beyond the header are dropped.
    """

    kind: ClassVar[str] = "G"
    paths_field: str
    headers: tuple[str, ...] | None = None
    encoding: str = "utf-8"
    delimiter: str = ","
    quotechar: str = '"'

    def inputs(self):
        return (self.paths_field,)

    def transform(self, df):
        read = df.sparkSession.read.options(sep=self.delimiter, quote=self.quotechar, escape=self.quotechar, multiLine=True, encoding=self.encoding, header=self.headers is None, inferSchema=False)
        if self.headers is not None:
            read = read.schema(T.StructType([T.StructField(h, T.StringType()) for h in self.headers]))
        files = listed_files(df.sparkSession, _paths(df, self.paths_field))
        if self.headers is not None:
            return _placed(df, read.csv(_readable(df.sparkSession, [f for f, _ in files])), files)
        groups: dict[str, list[str]] = {}
        for f, _ in files:
            groups.setdefault(_first_line(df.sparkSession, f), []).append(f)
        groups.pop("", None)  # files without a line
        if not groups:
            return _placed(df, read.csv(_readable(df.sparkSession, [f for f, _ in files])), files)
        out = None
        for names in groups.values():
            part = _placed(df, read.csv(_readable(df.sparkSession, names)), files)
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def outputs(self, df):
        return df.columns


def listed_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, int]]:
    """(URI, place) of all files of the paths (files, folders and patterns), in the order of the paths and, in a path, of the names."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place, found = {}, []
    for k, p in enumerate(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(conf).globStatus(path) or ():
            place.setdefault(status.getPath().toUri().getPath(), k)
            found.append(status.getPath().toString())
    out = []
    for name in set(spark.read.text(found or paths).inputFiles()):
        at = plain = jvm.java.net.URI(name).getPath()
        while at not in place and "/" in at.rstrip("/"):
            at = at.rstrip("/").rsplit("/", 1)[0] or "/"
        out.append((place.get(at, len(paths)), plain, name))
    return [(name, k) for k, (_, _, name) in enumerate(sorted(out))]


def _readable(spark: SparkSession, uris: list[str]) -> list[str]:
    """The paths of the URIs, as readers take them."""
    return [spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(u)).toString() for u in uris]


def _first_line(spark: SparkSession, file: str) -> str:
    """The first line of a file, decompressed by its suffix; read by the driver, as Spark reads a header."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        line = jvm.org.apache.hadoop.io.Text()
        jvm.org.apache.hadoop.util.LineReader(codec.createInputStream(stream) if codec is not None else stream).readLine(line)
        return bytes(line.copyBytes()).hex()
    finally:
        stream.close()


def _placed(old: DataFrame, new: DataFrame, files: list[tuple[str, int]], *lead: int) -> DataFrame:
    """new, read from the files, with the hidden order where old has it: place of the file, start of the block in it, row in the task, which reads a block from its start."""
    if ORDER not in old.columns:
        return new
    if not files:  # a source without files
        return new.withColumn(ORDER, F.array(*[F.lit(k).cast("long") for k in lead], F.monotonically_increasing_id()))
    same = lambda c: F.regexp_replace(c, "^([A-Za-z0-9+.-]+):/+", "$1:/")
    rows = new.select("*", same(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    places = old.sparkSession.createDataFrame(files, "file string, __place long").select(same(F.col("file")).alias("__file"), "__place")  # one row a file
    at = F.array(*[F.lit(k).cast("long") for k in lead], "__place", "__block", "__row")
    return rows.join(places, "__file").withColumn(ORDER, at).drop("__file", "__block", "__row", "__place")


@dataclass(frozen=True, eq=False, repr=False)
class LoadJsonl(Operator):
    """One JSON object a line; a malformed line is an error. schema: DDL, else inferred from all files.

    ragged: each line is one variant in that field, so lines may have other fields and types than others have; ExtractPath reads it.
    """

    kind: ClassVar[str] = "G"
    paths_field: str
    encoding: str = "utf-8"
    schema: str | None = None
    ragged: str | None = None

    def __post_init__(self):
        if self.schema and self.ragged:
            raise ValueError("give schema or ragged")

    def inputs(self):
        return (self.paths_field,)

    def transform(self, df):
        read = df.sparkSession.read.options(mode="FAILFAST", encoding=self.encoding)
        files = listed_files(df.sparkSession, _paths(df, self.paths_field))
        if self.ragged:
            read = read.option("singleVariantColumn", self.ragged)
        return _placed(df, (read.schema(self.schema) if self.schema else read).json(_readable(df.sparkSession, [f for f, _ in files])), files)

    def outputs(self, df):
        return df.columns


def concatenate(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def interleave(frames: Sequence[DataFrame], order_by: Sequence[str]) -> DataFrame:
    """Rows of the frames in turn until the first frame ends; order_by gives each frame's order. The place is in column __turn."""
    rows = [numbered(f, [F.col(c) for c in order_by], "__n").withColumn("__s", F.lit(k)) for k, f in enumerate(frames)]
    least = min(f.count() for f in rows)
    return concatenate([f.where(F.col("__n") < least) for f in rows]).withColumn("__turn", F.col("__n") * len(frames) + F.col("__s")).drop("__n", "__s")


@dataclass(frozen=True, eq=False, repr=False)
class LoadDatasets(Operator):
    """Each row describes a dataset: path, format (parquet if missing) and options; they are concatenated or interleaved."""

    kind: ClassVar[str] = "G"
    combine_strategy: str = "interleave"
    fields_to_keep: tuple[str, ...] | None = None
    order_by: tuple[str, ...] = ()

    def __post_init__(self):
        if self.combine_strategy not in ("interleave", "concatenate"):
            raise ValueError("combine_strategy is interleave or concatenate")

    def inputs(self):
        return ("path",)

    def transform(self, df):
        frames = []
        for row in (df.orderBy(ORDER).drop(ORDER) if ORDER in df.columns else df).collect():  # descriptions of datasets, not data
            r: dict[str, Any] = row.asDict(recursive=True)
            f = df.sparkSession.read.format(r.get("format") or "parquet").options(**(r.get("options") or {})).load(r["path"])
            if self.fields_to_keep:
                missing = [c for c in self.fields_to_keep if c not in f.columns]
                if missing:
                    raise FieldError(f"no {missing[0]} in {r['path']}")
                f = f.select(*self.fields_to_keep)
            frames.append(f)
        if len(frames) == 1 or self.combine_strategy == "concatenate":
            return concatenate([_placed(df, f, [(n, i) for i, n in enumerate(sorted(f.inputFiles()))], k) for k, f in enumerate(frames)])
        out = interleave(frames, self.order_by or frames[0].columns)
        return out.withColumn(ORDER, F.array("__turn")).drop("__turn") if ORDER in df.columns else out.drop("__turn")

    def outputs(self, df):
        return df.columns
