"""Shared helpers: unique row ids, boxed rows, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cleanup, new_path, numbered, shared_dir, table

__all__ = ["boxed", "chosen", "cleanup", "components", "files_of", "lookup", "new_path", "numbered", "old_ids", "partitions", "shared_dir", "table", "unique_ids"]


#: Keys that more than one in HOT rows has are at most HOT - 1.
HOT = 1024


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined with found: one row a key, with n, how many of the rows have it. Keys that hold more than one in HOT rows are looked up
    by broadcast (fewer than HOT rows), the others by a shuffle, so no key makes a large task. Both tables are read twice: give written ones."""
    least = (found.agg(F.sum(n)).first()[0] or 0) // HOT
    hot = F.broadcast(found.where(F.col(n) > least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(found.where(F.col(n) <= least), keys)
    return rows.join(hot, keys).unionByName(rest)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers in a file.
FILE_ROWS = 100_000


def files_of(spark: SparkSession, rows: int) -> int:
    """Files for so many small rows: at most one for each shuffle partition."""
    return max(1, min(partitions(spark), -(-rows // FILE_ROWS)))


def unique_ids(df: DataFrame, key: str, *more: str) -> tuple[DataFrame, DataFrame | None]:
    """(df with a unique, not null long id in key, None), or (df renumbered in key's order, the table of _seq and the old key).

    Operators compare and join rows by id. Where ids are null or repeat, each row becomes a row of its own, numbered by
    (key, nulls last, then the hash of more), so a repeated row counts as the later copy of the first.
    """
    bad = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col(key).isNull() | (F.col("_n") > 1)).limit(1).count()
    if not bad:
        return df, None
    rows = table(numbered(df, [F.col(key).asc_nulls_last(), F.xxhash64(*more), *[F.col(c).asc_nulls_last() for c in more]]))
    return rows.drop(key).withColumnRenamed("_seq", key), rows.select(F.col("_seq"), F.col(key).alias("_old"))


def old_ids(result: DataFrame, names: DataFrame | None, columns: list[str]) -> DataFrame:
    """The columns that hold ids of unique_ids() with the ids that the input had."""
    if names is None:
        return result
    order = result.columns
    for c in columns:
        result = result.join(names.withColumnRenamed("_seq", "_s"), F.col(c) == F.col("_s")).drop(c, "_s").withColumnRenamed("_old", c)
    return result.select(*order)


def boxed(docs: DataFrame, *more: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, text, more and row, a struct of all columns; the names of unique_ids()): joins can't meet clashing names, and row.* is the input."""
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(column("doc_id").cast("long").alias("doc_id"), column("text").cast("string").alias("text"), *map(column, more), F.struct(*map(column, docs.columns)).alias("row"))
    return unique_ids(rows, "doc_id", "text")


def chosen(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The input rows of boxed() whose id is in ids, a table of one column."""
    ids = ids.toDF("chosen_id")
    return rows.join(ids, F.col("doc_id") == F.col("chosen_id"), "left_semi").select("row.*")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges(u, v): component is the smallest id that links reach.

    Large-star and small-star in turn: each round is a grouped minimum with map-side combine and a join that
    adaptive execution can split for hubs; the number of rounds grows with the logarithm of the longest chain. A round is written
    as a file for FILE_ROWS edges that there were at first, not as one for each shuffle partition.
    """
    e = table(edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).where("a <> b").distinct())
    files = files_of(e.sparkSession, e.count())
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        e = table(small.union(low.select(F.col("m").alias("a"), "b")).distinct().coalesce(files))
        ends = e.select(F.col("a").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("up")).union(e.select(F.col("b").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("up")))
        unsettled = ends.groupBy("x").agg(F.sum("n").alias("n"), F.max("up").alias("up")).where("n > 1 or (n = 1 and up = 1)").limit(1).count()
        if not unsettled:
            return e.select(F.col("b").alias("id"), F.col("a").alias("component")).union(e.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
