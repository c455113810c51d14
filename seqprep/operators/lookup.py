"""Leaves replaced by their entries in a table of any size."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..plans.core import FieldError, Operator
from ..plans.storage import table as written
from .cache import identity

_HOT = 1024
#: Bytes of entries that are looked up within a row, and entries that share a hash there.
_WITHIN, _SHARE = 16 << 20, 4


@dataclass(frozen=True, eq=False, repr=False)
class LookupTable(Operator):
    """Each leaf of a field (a value, or lists of any depth) replaced by its entry in a table: value where key equals the leaf.

    The distinct leaves are counted before anything is shuffled and joined with the table once; a leaf without an entry, or with two, is an error. In lists the most frequent
    leaves, up to 16 MB of entries and broadcast_bytes, are looked up within the row, by maps of a few entries each that all tasks get; only the other places become
    rows, are joined with their entries and put back by the row's number and the place in it. For values and lists of lists, entries that are needed
    go to all tasks if their measured size is at most broadcast_bytes; else leaves of over 1/1024 of all (fewer than 1,024) are looked up by broadcast and the
    rest by a shuffled join. Null leaves, null lists and empty lists stay as they are, an entry may be
    null, keys that are null match nothing.
    """

    field_name: str
    table: DataFrame
    key: str
    value: str
    broadcast_bytes: int = 64 << 20

    def inputs(self):
        return (self.field_name,)

    def outputs(self, df):
        return [self.field_name]

    @property
    def fingerprint(self) -> str:
        return hashlib.sha1(f"{self.name} {self.field_name} {self.key} {self.value} {self.broadcast_bytes} {identity(self.table)}".encode()).hexdigest()

    def transform(self, df):
        if df.isStreaming:
            raise ValueError("leaves of streams can't be counted")
        kind, names = df.schema[self.field_name].dataType, df.columns
        if isinstance(A.leaf_type(kind), (T.StructType, T.MapType, T.VariantType)):
            raise FieldError(f"{self.field_name} has leaves of {A.leaf_type(kind).simpleString()}")
        rows = df.withColumnRenamed(self.field_name, "__v")
        if isinstance(kind, T.ArrayType):
            rows = written(rows.withColumn("__row", F.monotonically_increasing_id()))  # the numbers of the rows must stay as they are
        found, total, small = self._entries(rows, kind)
        if A.depth(kind) == 1:
            out = _within(rows, found, min(_WITHIN, self.broadcast_bytes))
        else:
            out = _replaced(rows, ["__row"], kind, found, total, small)
        return out.select(*[F.col("__v").alias(c) if c == self.field_name else F.col(c) for c in names])

    def _entries(self, rows: DataFrame, kind: T.DataType) -> tuple[DataFrame, int, bool]:
        """(leaf, its entry and its number of places), the number of places, and whether the entries are small; all entries are there."""
        leaf = A.leaf_type(kind)
        each = F.col("__v")
        places = rows.select(each.alias("__k"))
        while isinstance(kind, T.ArrayType):
            places, kind = places.select(F.explode("__k").alias("__k")), kind.elementType
        counts = places.where(F.col("__k").isNotNull()).groupBy("__k").agg(F.count("*").alias("__n"))
        entries = self.table.select(F.col(self.key).cast(leaf).alias("__k"), F.col(self.value).alias("__to")).where(F.col("__k").isNotNull())
        entries = entries.groupBy("__k").agg(F.first("__to").alias("__to"), F.count("*").alias("__e"))
        found = written(counts.join(entries, "__k", "left"))
        missing = F.col("__e").isNull()
        seen = found.agg(
            F.count_if(missing).alias("missing"),
            F.min(F.when(missing, F.col("__k").cast("string"))).alias("one"),
            F.min(F.when(F.col("__e") > 1, F.col("__k").cast("string"))).alias("twice"),
            F.coalesce(F.sum("__n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum(_bytes()), F.lit(0)).alias("bytes"),
        ).first()
        if seen.missing:
            raise KeyError(f"no entry for {seen.missing} leaves, one is {seen.one}")
        if seen.twice is not None:
            raise ValueError(f"two entries for {seen.twice}")
        return found.drop("__e"), seen.n, seen.bytes <= self.broadcast_bytes


def _bytes():
    text = lambda c: F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    return text("__k") + text("__to")


def _within(rows: DataFrame, found: DataFrame, limit: int) -> DataFrame:
    """rows with the items of the lists __v replaced: frequent ones in place, from maps by the item's hash; the others as rows, each joined with its entry."""
    times = F.floor(F.log2("__n")).alias("times")  # entries that are alike in their number of places, up to a factor of 2
    frequent, taken, entries, rest = None, 0, 0, 0
    for r in sorted(found.groupBy(times).agg(F.sum(_bytes()).alias("bytes"), F.count("*").alias("n")).collect(), reverse=True):
        taken += r.bytes
        if taken <= limit:
            frequent, entries = r.times, entries + r.n
        else:
            rest += r.n
    to = found.schema["__to"].dataType
    each = F.struct(F.col("__to").alias("to"))
    if frequent is None:
        known = lambda m, x: F.lit(None).cast(T.StructType([T.StructField("to", to)]))
        maps = F.lit(0)
    else:
        n = max(1, entries // _SHARE)
        part = lambda x: F.pmod(F.hash(x), F.lit(n))
        some = found.where(F.floor(F.log2("__n")) >= frequent).groupBy(part(F.col("__k")).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("__k", each))).alias("m"))
        every = found.sparkSession.range(n).select(F.col("id").cast("int").alias("id")).join(some, "id", "left")
        maps = every.agg(F.array_sort(F.collect_list(F.struct("id", "m")), lambda a, b: a["id"] - b["id"]).alias("all")).select(F.transform("all", lambda x: x["m"])).scalar() if n > 1 else some.select(F.array("m")).scalar()
        known = lambda m, x: F.get(m, part(x))[x]
    marked = A.bound(F.col("__m"), lambda m: F.transform("__v", lambda x, i: F.struct(i.alias("i"), F.when(x.isNotNull(), known(m, x)).alias("e"), x.alias("x"))))
    plain = rows.withColumn("__m", maps).withColumn("__v", marked).drop("__m")  # Spark allows no subquery in a loop, but puts it there: no row holds the maps
    if not rest:
        return plain.withColumn("__v", F.transform("__v", lambda p: p["e"]["to"]))
    is_rest = lambda p: p["x"].isNotNull() & p["e"].isNull()
    seldom = plain.select("__row", F.explode(F.filter("__v", is_rest)).alias("p")).select("__row", F.col("p.i").alias("i"), F.col("p.x").alias("__k"))
    less = found if frequent is None else found.where(F.floor(F.log2("__n")) < frequent)
    back = seldom.join(less.select("__k", "__to"), "__k").groupBy("__row").agg(F.collect_list(F.struct("i", F.col("__to").alias("to"))).alias("__b"))
    out = plain.withColumn("__v", F.transform("__v", lambda p: p["e"]["to"])).join(back, "__row", "left")

    def merged(places):
        start = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(places, j - 1)["i"] + 1)
        parts = F.transform(places, lambda p, j: F.concat(F.slice("__v", start(j) + 1, p["i"] - start(j)), F.array(p["to"])))
        last = start(F.size(places))
        return F.concat(F.flatten(parts), F.slice("__v", last + 1, F.size("__v") - last))

    put = A.bound(F.array_sort("__b", lambda a, b: a["i"] - b["i"]), merged)
    return out.withColumn("__v", F.when(F.col("__b").isNull(), F.col("__v")).otherwise(put)).drop("__b")


def _replaced(rows: DataFrame, ids: list[str], kind: T.DataType, found: DataFrame, total: int, small: bool) -> DataFrame:
    """rows with the leaves of __v replaced; ids name a row, where __v is a list."""
    if not isinstance(kind, T.ArrayType):
        entry = found.select("__k", "__to")
        rest = [c for c in rows.columns if c != "__v"]
        if small:
            return rows.join(F.broadcast(entry), F.col("__v") == F.col("__k"), "left").select(*rest, F.col("__to").alias("__v"))
        hot = F.col("__n") * _HOT > total
        often = F.broadcast(found.where(hot).select("__k", F.col("__to").alias("__hot"), F.lit(True).alias("__is")))
        first = rows.join(often, F.col("__v") == F.col("__k"), "left").drop("__k")
        done = first.where(F.col("__is") | F.col("__v").isNull()).select(*rest, F.col("__hot").alias("__v"))
        seldom = first.where(F.col("__is").isNull() & F.col("__v").isNotNull()).join(found.where(~hot).select("__k", "__to").hint("shuffle_hash"), F.col("__v") == F.col("__k"))
        return done.unionByName(seldom.select(*rest, F.col("__to").alias("__v")))
    place = f"__p{len(ids)}"
    inner = rows.select(*ids, F.posexplode("__v").alias(place, "__v"))
    made = _replaced(inner, [*ids, place], kind.elementType, found, total, small)
    back = made.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct(place, "__v"))).alias("__b"))
    out = rows.withColumn("__size", F.size("__v")).withColumn("__null", F.col("__v").isNull()).drop("__v").join(back, ids, "left")
    values = F.transform("__b", lambda x: x["__v"])
    return out.withColumn("__v", F.when(~F.col("__null"), F.when(F.col("__size") > 0, values).otherwise(F.slice(F.array(F.lit(None).cast(_element(made))), 1, 0)))).drop("__b", "__size", "__null")


def _element(made: DataFrame) -> T.DataType:
    return made.schema["__v"].dataType
