"""Segments of a pipeline that are kept: computed once, later read from a table keyed by input and operators.

The input is known by its plan and its files as they are now; where some of it is no file (tables made of local data, other sources), by a hash of its rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.core import Operator
from ..plans.storage import shared_dir


@dataclass(frozen=True, eq=False, repr=False)
class StartCaching(Operator):
    """Start of a kept segment. cache_dir: a folder that the cluster shares; by default in spark.checkpoint.dir."""

    cache_dir: str | None = None

    def outputs(self, df):
        return df.columns


@dataclass(frozen=True, eq=False, repr=False)
class EndCaching(Operator):
    def outputs(self, df):
        return df.columns


def run_segments(operators: tuple[Operator, ...], df: DataFrame, remove_columns: bool, watch: Callable[[int, DataFrame], DataFrame] = lambda _, df: df) -> DataFrame:
    """The operators in turn; watch gets the number of each operator (of a kept segment's last) and its result, and gives the result to go on with."""
    at = 0
    while at < len(operators):
        o = operators[at]
        if isinstance(o, EndCaching):
            raise ValueError("EndCaching without StartCaching")
        if not isinstance(o, StartCaching):
            df = watch(at, o.apply(df, remove_columns))
            at += 1
            continue
        end = next((k for k in range(at + 1, len(operators)) if isinstance(operators[k], (EndCaching, StartCaching))), None)
        if end is None or isinstance(operators[end], StartCaching):
            raise ValueError("StartCaching without EndCaching")
        df = watch(end, _kept(df, operators[at + 1 : end], o.cache_dir, remove_columns))
        at = end + 1
    return df


def _kept(df: DataFrame, segment: tuple[Operator, ...], folder: str | None, remove_columns: bool) -> DataFrame:
    if df.isStreaming:
        raise ValueError("streams can't be kept")
    spark = df.sparkSession
    key = hashlib.sha1((f"{identity(df)}{remove_columns}" + "".join(o.fingerprint for o in segment)).encode()).hexdigest()
    path = f"{folder or shared_dir(spark) + '/seqprep-cache'}/{key}"
    to, written = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}-{uuid.uuid4().hex}"))
    files = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(to):
        out = df
        for o in segment:
            out = o.apply(out, remove_columns)
        out.write.parquet(written.toString())
        # a table appears whole or not at all; where another driver was first, its table holds
        if files.exists(to) or not files.rename(written, to):
            files.delete(written, True)
    return spark.read.parquet(path)


def identity(df: DataFrame) -> str:
    """Plan and file versions, or where some rows are of no file, a hash of the rows."""
    return f"{df._jdf.queryExecution().analyzed().canonicalized().toString()}{_versions(df.sparkSession, df.inputFiles())}" if _of_files(df) else content_hash(df)


def _of_files(df: DataFrame) -> bool:
    """Whether all rows come from files (or ranges), so that plan and files tell them."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = []
    for k in range(leaves.size()):
        kind = leaves.apply(k).getClass().getSimpleName()
        kinds.append(leaves.apply(k).relation().getClass().getSimpleName() if kind == "LogicalRelation" else kind)
    return set(kinds) <= {"HadoopFsRelation", "Range"}


def content_hash(df: DataFrame) -> str:
    """A hash of the schema and the rows as a multiset, whatever their order and partitioning: count and sums of two hashes of each row, in one aggregate.

    A row is hashed as JSON with its nulls, so a null and a missing neighbour, or a number and its text, differ. Columns that are named alike are told apart by place.
    """
    row = df.toDF(*[f"c{k}" for k in range(len(df.columns))]) if df.columns else df
    text = F.to_json(F.struct(*row.columns), {"ignoreNullFields": "false"}) if df.columns else F.lit("")
    digest = F.sha2(text, 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    got = row.agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(16).alias("b")).first()
    return hashlib.sha1(f"{df.schema.json()}{got.n},{got.a},{got.b}".encode()).hexdigest()


def _versions(spark: SparkSession, names: list[str]) -> list[tuple]:
    """Path, length and modification time of the files: one listing for each folder."""
    jvm, out = spark._jvm, []
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(x)) for x in names]
    wanted = {p.toUri().getPath() for p in paths}
    for folder in {p.getParent().toString(): p.getParent() for p in paths}.values():
        for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder):
            name = f.getPath().toUri().getPath()
            if name in wanted:
                out.append((name, f.getLen(), f.getModificationTime()))
    return sorted(out)
