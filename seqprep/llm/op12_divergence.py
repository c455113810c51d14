"""How the sources of a language differ in their words: smoothed chi-square divergences of all pairs of sources, and the terms that mark each source.

Divergence sums over all kept terms of a language, of which a source has few. Inclusion and exclusion over the supports gives the sum without looking at the others: with
p0 and q0 the probabilities of a term with no occurrence, and A and B the sets of terms that the two sources have,

    sum f(p, q) = sum over A of f(p, q0) + sum over B of f(p0, q) + (V - |A| - |B|) f(p0, q0) + sum over A and B of (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)).

The first two sums come from each group's histogram of counts (terms with one count have one price), the third is a constant for each pair, and the last is a
join of the sparse postings on the term, summed in map-side combine. A term has one posting for each source at most. All sums are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lookup, partitions, table

#: Documents of its language that a kept term is in, at least; scale of the probabilities; ranks of the part `term`.
LEAST, SCALE, TOP = 3, 1_000_000_000, 200
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of docs(lang, source, text), without nulls: occurrences and documents of each term in each group; and for each group a row with a null term."""
    w = F.array_remove(F.split(F.translate("text", _UPPER, _LOWER), r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"), "")
    cut = docs.select("lang", "source", w.alias("w"))
    # a null for the group, each occurrence, then each different term once
    entries = cut.select("lang", "source", F.size("w").alias("size"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "w", F.array_distinct("w"))).alias("at", "term"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0).cast("long"))
    return entries.groupBy("lang", "source", "term").agg(one((F.col("at") > 0) & (F.col("at") <= F.col("size"))).alias("n"), one(F.col("at") > F.col("size")).alias("d"))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    dec = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", dec(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), dec(total + terms))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _pairs(groups: DataFrame) -> DataFrame:
    """Ordered pairs of different groups of a language. This is one row a result; the first groups are dealt over salts, to which the second are copied."""
    salts = partitions(groups.sparkSession)
    a = groups.select("lang", *[F.col(c).alias(f"a_{c}") for c in ("gid", "source", "p0", "size")], "terms", F.pmod("gid", F.lit(salts)).alias("salt"))
    b = groups.select("lang", *[F.col(c).alias(f"b_{c}") for c in ("gid", "source", "p0", "size")], F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
    return a.join(b, ["lang", "salt"]).where("a_gid <> b_gid").drop("salt")


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: for each group (lang, source) and each other source of the language, the divergence over all kept terms (0 without any). Part `term`: the
    terms of a group likelier in it than in the language, by their share of the divergence, ranks to top. Ranks count from 1 in a group and part, by value
    descending, then item. Kept are terms in at least `least` documents of the language; each row is a document. Null texts, languages and sources are empty
    strings. Groups without kept terms have pairs only; no documents: no rows. Other columns are ignored.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counts = term_counts(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")))
    same = Window.partitionBy("lang", "term")  # as many rows as the term has sources
    seen = counts.withColumns({"df": F.sum("d").over(same), "in_lang": F.sum("n").over(same), "k": F.row_number().over(same.orderBy("source"))})
    kept = table(seen.where((F.col("df") >= least) | F.col("term").isNull()).select("lang", "source", "term", "n", "in_lang", "k"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("size"))
    langs = kept.where("term is not null").groupBy("lang").agg(F.count_if(F.col("k") == 1).alias("terms"), F.sum(F.when(F.col("k") == 1, F.col("in_lang"))).alias("lang_total"))
    groups = groups.join(langs, "lang", "left").na.fill(0, ["terms", "lang_total"])
    zero = F.when(F.col("terms") > 0, probability(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    groups = table(groups.withColumns({"p0": zero.cast("long"), "gid": F.monotonically_increasing_id()}))

    posts = lookup(kept.where("term is not null"), groups, ["lang", "source"], "size")
    posts = table(posts.select("lang", "source", "gid", "term", "n", "in_lang", "lang_total", "terms", "p0", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p")))

    q = probability(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = posts.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", price(F.col("p"), F.col("q")).alias("value"))
    marks = marks.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)  # cut to the first ones before the shuffle, too

    pairs = table(_pairs(groups))
    histogram = posts.groupBy("gid", "p").agg(F.count("*").alias("cnt"))
    priced = histogram.join(pairs.select(F.col("a_gid").alias("gid"), "b_gid", "b_p0"), "gid").groupBy("gid", "b_gid").agg(
        F.sum(F.col("cnt") * price(F.col("p"), F.col("b_p0"))).alias("mine"), F.sum(F.col("cnt") * price(F.col("b_p0"), F.col("p"))).alias("theirs")
    )
    c = F.col
    side = lambda x: posts.select("lang", "term", *[F.col(k).alias(f"{x}_{k}") for k in ("gid", "p", "p0")])
    over = lambda p, p0, q, q0: F.sum(price(p, q) - price(p, q0) - price(p0, q) + price(p0, q0))
    both = side("a").join(side("b"), ["lang", "term"]).where("a_gid < b_gid").groupBy("a_gid", "b_gid")
    both = both.agg(over(c("a_p"), c("a_p0"), c("b_p"), c("b_p0")).alias("ab"), over(c("b_p"), c("b_p0"), c("a_p"), c("a_p0")).alias("ba"))
    added = pairs.where("terms > 0").select("a_gid", "b_gid", ((c("terms") - c("a_size") - c("b_size")) * price(c("a_p0"), c("b_p0"))).alias("value"))
    ways = lambda df, a, b, x, y: df.select(F.explode(F.array(*[F.struct(c(i).alias("a_gid"), c(j).alias("b_gid"), c(v).alias("value")) for i, j, v in ((a, b, x), (b, a, y))])).alias("x")).select("x.*")
    sums = added.union(ways(priced, "gid", "b_gid", "mine", "theirs")).union(ways(both, "a_gid", "b_gid", "ab", "ba")).groupBy("a_gid", "b_gid").agg(F.sum("value").alias("value"))
    values = pairs.join(sums, ["a_gid", "b_gid"], "left").select("lang", c("a_source").alias("source"), F.lit("pair").alias("part"), c("b_source").alias("item"), F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return values.withColumn("rank", F.row_number().over(first)).unionByName(marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    prob = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({total} + terms))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grp AS (SELECT DISTINCT lang, source FROM d),
occ AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM occ GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST}),
lang_sums AS (SELECT lang, count(*) AS terms, sum(n)::BIGINT AS lang_total FROM kept GROUP BY lang),
cnt AS (SELECT o.lang, source, o.term, count(*) AS n FROM occ o SEMI JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, coalesce(sum(n), 0)::BIGINT AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
full_p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {prob("coalesce(c.n, 0)", "total")} AS p, {prob("k.n", "lang_total")} AS q
 FROM totals g JOIN kept k USING (lang) JOIN lang_sums USING (lang) LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair_sums AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM full_p a JOIN full_p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
marks AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM full_p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM marks))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""


SQL = _sql()
