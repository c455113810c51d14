"""Toxicity by two class-conditional Kneser-Ney models with shared backoff.

The context of a word is its class (toxic or ordinary). A class counts a word once for each different word before it (continuation counts, so copies of a text add
nothing), discounts each count and gives the freed mass to its model of six-byte stems, that to its model of four-byte stems, and that to the corpus: continuation counts over all
documents, shared by both classes. A freed mass is passed on in proportion to the shared counts below a stem, so the probabilities of a class add up to one. The discounts of counts of 1, 2 and
3 or more are estimated for each class and level from the counts of counts (modified Kneser-Ney), so every word keeps a part of its own count. Words before a
word are counted over the corpus by sketches (LEVELS bitmaps of BITS bits, each with half the words of the one above; exact for a few words, off by about an eighth for many, with no ceiling).

A word's evidence is the difference of its two log-likelihoods. A document has, for each grade of how often the classes have seen a word (EDGES), the sum of the evidence by its length in
words and the highest such sum over a passage; a logistic fit weighs them, so how far rare words can be trusted is learnt, not set. The fit uses every document of the sample, each
scored by a model of the other folds only; the scores come from the model of all folds. Held-out labels enter neither.

Labels come from a sample of at most SAMPLE documents, half of each class at most (the smallest hashes of labelled ids; the fit weighs the classes as they are
among all labels), corpus counts from all documents. The class tables hold the words of the sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .textkernel import SPACE, Text, _U, flat, mix, pieces, signed, trimmed

#: Labelled documents of which the models and the fit are made, at most.
SAMPLE = 16_000
#: Parts of the sample that are scored by models of the others, for the fit.
FOLDS = 4
#: Grades of a word's count over both classes: 0, 1, 2, 3 to 4, 5 to 8, 9 to 16, more.
EDGES = (0, 1, 2, 4, 8, 16)
#: Bitmaps of a word's sketch, bits of each, and bits set beyond which a bitmap is too full to be read.
LEVELS, BITS, FULL = 28, 32, 24
#: Words in a passage.
PASSAGE = 8
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


class _Words:
    """Lower-case words of the rows of a slice: runs of letters and digits; hashes of words, and their first six and four bytes as numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.text = Text(np.where(_SEPARATOR[data], np.uint8(32), data), offsets)
        t = self.text
        self.word = t.word_hashes()
        six = np.zeros(len(t.starts), np.int64)
        padded = np.concatenate([t.data, np.zeros(6, np.uint8)])
        for k in range(6):
            six = (six << 8) | np.where(t.starts + k < t.ends, padded[t.starts + k], 0)
        self.stems = [six, six >> 16]

    def before(self) -> np.ndarray:
        """The word before each word in its text, 0 for the first."""
        out = np.zeros_like(self.word)
        same = self.text.row[1:] == self.text.row[:-1]
        out[1:][same] = self.word[:-1][same]
        return out


def _slices(batch: pa.RecordBatch, most: int = 1 << 19):
    column = pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), ""))
    data, offsets = flat(column)
    for a, b in pieces(offsets, most):
        yield a, b, _Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


assert not _SEPARATOR[list(b"az09")].any() and SPACE[32]
_PLANES = [f"p{k}" for k in range(LEVELS * BITS // 64)]


def _sketched(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(level, bit) of each word before in a sketch: level k has a share of 2^-(k + 1) of the words, the last level the rest."""
    x = mix(before + _U(1))
    low = (x & _U((1 << (LEVELS - 1)) - 1)) | _U(1 << (LEVELS - 1))
    return np.bitwise_count((low & (~low + _U(1))) - _U(1)).astype(_U), _U(1) << (x >> _U(64 - 5))


#: Words that a task packs at once, and packed rows that it holds before they go out.
PACK, HELD = 250_000, 400_000


def _corpus_counts(batches):
    """For each task and word: its first bytes and the sketch of the words before it, two bitmaps in a long. A row a word and HELD packed rows, whatever the words' counts."""
    words, rows = [], 0
    packed, held = [], 0

    def pack(parts):
        h, six, level, bits = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        o = np.argsort((h & ~_U(31)) | level)
        h, level = h[o], level[o]
        s = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (level[1:] != level[:-1])))
        return h[s], six[o][s], level[s], np.bitwise_or.reduceat(bits[o], s)

    def out(h, six, level, bits):
        o = np.argsort(h, kind="stable")
        h, six, level, bits = h[o], six[o], level[o].astype(np.int64), bits[o]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        for a in range(0, len(first), 1 << 14):
            e = min(a + (1 << 14), len(first))
            lo, hi = first[a], first[e] if e < len(first) else len(h)
            planes = np.zeros((len(_PLANES), e - a), _U)
            for odd in (0, 1):
                at = lo + np.flatnonzero(level[lo:hi] % 2 == odd)
                planes[level[at] // 2, word[at] - a] |= bits[at] << _U(BITS * odd)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[first[a:e]])), pa.array(six[first[a:e]]), *(pa.array(signed(x)) for x in planes)], names=["h", "six", *_PLANES])

    for batch in batches:
        for _, _, w in _slices(batch):
            if not len(w.word):
                continue
            words.append((w.word, w.stems[0], *_sketched(w.before())))
            rows += len(w.word)
            if rows > PACK:
                packed.append(pack(words))
                rows = 0
                held += len(packed[-1][0])
                if held > HELD:
                    packed.append(pack(packed))
                    held = len(packed[-1][0])
                    if held > HELD // 2:  # few words come again
                        yield from out(*packed.pop())
                        held = 0
    if words:
        packed.append(pack(words))
    if packed:
        yield from out(*pack(packed))


def _distinct():
    """Words in a sketch: linear counting from the first level after the last too full one."""
    n = [F.bit_count(F.shiftrightunsigned(_PLANES[k // 2], BITS * (k % 2)).bitwiseAND((1 << BITS) - 1)) for k in range(LEVELS)]
    first = F.greatest(F.lit(0), *[F.when(n[k] > FULL, k + 1).otherwise(0) for k in range(LEVELS - 1)])
    counted = [F.when(first <= k, F.when(n[k] > 0, BITS * F.log(BITS / F.greatest(BITS - n[k], F.lit(0.5)))).otherwise(0.0)).otherwise(0.0) for k in range(LEVELS)]
    return F.pow(F.lit(2.0), first) * sum(counted[1:], counted[0])


def word_counts(docs: DataFrame) -> DataFrame:
    """h, six (first bytes), shared (continuation count over all rows of docs(text), from sketches) of each word."""
    sketches = docs.select("text").mapInArrow(trimmed(_corpus_counts), "h long, six long, " + ", ".join(f"{p} long" for p in _PLANES))
    return sketches.groupBy("h").agg(F.max("six").alias("six"), *[F.bit_or(p).alias(p) for p in _PLANES]).select("h", "six", _distinct().alias("shared"))


def _class_pairs(batches):
    for batch in batches:
        kind, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("class", "fold"))
        for a, b, w in _slices(batch):
            if len(w.word):
                yield pa.RecordBatch.from_arrays([pa.array(x[a:b][w.text.row]) for x in (kind, fold)] + [pa.array(signed(w.word)), pa.array(w.stems[0]), pa.array(signed(w.before()))], names=["class", "fold", "h", "six", "before"])


def class_counts(sample: DataFrame) -> DataFrame:
    """h, six and c<class>_<k> of each word of sample(text, class, fold): exact continuation counts in a class without fold k, and (k = FOLDS) in all."""
    pairs = sample.select("class", "fold", "text").mapInArrow(trimmed(_class_pairs), "class int, fold int, h long, six long, before long")
    pairs = pairs.groupBy("class", "h", "six", "before").agg(F.bit_or(F.expr("shiftleft(1, fold)")).alias("folds"))
    found = lambda c, k: F.count_if((F.col("class") == c) & (F.col("folds").bitwiseAND(~(1 << k)) != 0)).cast("int").alias(f"c{c}_{k}")
    return pairs.groupBy("h", "six").agg(*[found(c, k) for c in (0, 1) for k in range(FOLDS + 1)])


class Model:
    """Log-ratios (toxic over ordinary) of the words in the tables, else of the longest stem there, and the grade of each word; one of each for each of the models that share the tables."""

    def __init__(self, keys: list[np.ndarray], ratios: list[list[np.ndarray]], grades: list[np.ndarray], unseen: list[float]):
        self.keys, self.ratios, self.grades, self.unseen = keys, ratios, grades, unseen

    def only(self, k: int) -> Model:
        return Model(self.keys, [self.ratios[k]], [self.grades[k]], [self.unseen[k]])

    def of(self, levels: list[np.ndarray], k: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(log-ratio, grade) of each word by the k-th model."""
        out, grade = np.full(len(levels[0]), self.unseen[k]), np.zeros(len(levels[0]), np.int8)
        left = np.arange(len(out))
        for level, (h, keys, ratios) in enumerate(zip(levels, self.keys, self.ratios[k], strict=True)):
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, h[left]), len(keys) - 1)
            hit = keys[at] == h[left]
            out[left[hit]] = ratios[at[hit]]
            if not level:
                grade[left[hit]] = self.grades[k][at[hit]]
            left = left[~hit]
        return out, grade


def discounts(counts: np.ndarray) -> np.ndarray:
    """What each count gives away: discounts of 1, 2 and 3 or more by the counts of counts, within (0, 1), (0, 2) and (0, 3); 0.75 where they tell nothing."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(float)
    d = np.full(3, 0.75)
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        for k in range(3):
            d[k] = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.75
        d = np.clip(d, 0.05, [0.95, 1.95, 2.95])
    return np.where(counts > 0, np.minimum(d[np.clip(counts, 1, 3).astype(np.int64) - 1], counts), 0.0)


def _exact(x: np.ndarray) -> np.ndarray:
    """Multiples of 2^-20: their sums are exact, in any order."""
    return np.round(x * 2**20) / 2**20


def _fitted(of_six, of_four, counts, shared, stems, total) -> tuple[list[np.ndarray], np.ndarray, float]:
    """(ratios of words, six- and four-byte stems, grades of the words, ratio of what no level knows) of one model."""
    (six_keys, six_shared), (four_keys, four_shared) = stems
    grade = np.searchsorted(EDGES, counts.sum(axis=0), "left").astype(np.int8)
    mass = counts.sum(axis=1)
    if not mass.all():
        return [np.zeros(len(x)) for x in (shared, six_keys, four_keys)], grade, 0.0
    c6 = np.array([np.bincount(of_six, c, minlength=len(six_keys)) for c in counts])
    c4 = np.array([np.bincount(of_four, c, minlength=len(four_keys)) for c in c6])
    p, ratios, backoff = None, [], []
    for c, low, above in ((c4, four_shared / total, None), (c6, six_shared / four_shared[of_four], of_four), (counts, shared / six_shared[of_six], of_six)):
        given = np.array([discounts(x) for x in c])
        freed = given.sum(axis=1) / mass
        p = (c - given) / mass[:, None] + freed[:, None] * (low if p is None else p[:, above] * low)
        ratios.append(np.log(p[1]) - np.log(p[0]))
        backoff.append(float(np.log(freed[1]) - np.log(freed[0])))
    four, six, words = backoff  # what a level doesn't know has the ratio of the level below, and that of the masses freed to it
    return [_exact(ratios[2]), _exact(ratios[1] + words), _exact(ratios[0] + six + words)], grade, float(_exact(np.array(four + six + words)))


def fit(h: np.ndarray, six: np.ndarray, counts: np.ndarray, shared: np.ndarray, stems: list[tuple[np.ndarray, np.ndarray]], total: float) -> Model:
    """The words of both classes: hash, first bytes, (models, 2, words) counts and shared counts; (ascending keys, shared counts) of their six- and four-byte stems; sum of all shared counts."""
    o = np.argsort(h)
    h, six, counts, shared = h[o], six[o], counts[:, :, o], shared[o]
    of_six, of_four = np.searchsorted(stems[0][0], six), np.searchsorted(stems[1][0], stems[0][0] >> 16)
    found = [_fitted(of_six, of_four, c.astype(float), shared, stems, total) for c in counts]
    return Model([h, stems[0][0], stems[1][0]], *(list(x) for x in zip(*found, strict=True)))


def learn(sample: DataFrame, words: DataFrame) -> Model | None:
    """The models of sample(text, class, fold) without each fold, and of all, over the corpus counts words; None where a class has no words. To the driver: the words and stems of the sample."""
    seen = table(class_counts(sample))
    rows = seen.join(words.select("h", "shared"), "h").toArrow()
    h, six, shared = (rows.column(c).to_numpy() for c in ("h", "six", "shared"))
    counts = np.array([[rows.column(f"c{c}_{k}").to_numpy() for c in (0, 1)] for k in range(FOLDS + 1)])
    del rows
    if not len(h) or not counts[FOLDS].sum(axis=1).all():
        return None
    sums = table(words.groupBy("six").agg(F.sum("shared").alias("shared")))
    four = F.shiftright("six", 16).alias("four")
    stems = []
    for name, all_, some in (("six", sums, seen.select("six")), ("four", sums.groupBy(four).agg(F.sum("shared").alias("shared")), seen.select(four))):
        got = all_.join(some.distinct(), name, "left_semi").toArrow()
        key, n = got.column(name).to_numpy(), got.column("shared").to_numpy()
        o = np.argsort(key)
        stems.append((key[o], n[o]))
    return fit(h.view(_U), six, counts, shared, stems, sums.agg(F.sum("shared")).first()[0])


#: Two for each grade.
FEATURES = 2 * (len(EDGES) + 1)


def _features(w: _Words, rows: int, model: Model, k: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """((rows, FEATURES): for each grade, the sum of log-ratios by the words of the document, and the highest over a passage; (rows, 2): the same over all grades); shorter documents count as filled up with unknown words."""
    t = w.text
    out, plain = np.zeros((rows, FEATURES)), np.zeros((rows, 2))
    has = np.flatnonzero(t.n_words)
    if not len(has):
        return out, plain
    x, grade = model.of([w.word, *w.stems], k)
    first, n = t.first[:-1], t.n_words
    end = np.minimum(np.arange(len(x)) + PASSAGE, (first + n)[t.row])
    for g in range(-1, FEATURES // 2):
        v = x if g < 0 else np.where(grade == g, x, 0.0)
        sums = np.concatenate([[0.0], np.cumsum(v)])
        to, at = (plain, 0) if g < 0 else (out, 2 * g)
        to[has, at + 1] = (sums[first[has] + n[has]] - sums[first[has]]) / np.maximum(n[has], PASSAGE)
        to[has, at] = np.maximum.reduceat((sums[end] - sums[:-1]) / PASSAGE, first[has])
    return out, plain


def _sampled(shared):
    """Of sample rows (class, fold, text): class, and the features by the model without the row's fold."""

    def run(batches):
        model = shared.value[0]
        for batch in batches:
            f, fold = np.zeros((batch.num_rows, FEATURES)), batch.column("fold").to_numpy(zero_copy_only=False)
            for a, b, w in _slices(batch):
                for k in np.unique(fold[a:b]):
                    mine = fold[a:b] == k
                    f[a:b][mine] = _features(w, b - a, model, int(k))[0][mine]
            yield pa.RecordBatch.from_arrays([batch.column("class"), *(pa.array(x) for x in f.T.copy())], names=["class", *(f"f{k}" for k in range(FEATURES))])

    return run


def _score(shared):
    def run(batches):
        model, weights = shared.value
        for batch in batches:
            f, plain = np.zeros((batch.num_rows, FEATURES)), np.zeros((batch.num_rows, 2))
            for a, b, w in _slices(batch):
                f[a:b], plain[a:b] = _features(w, b - a, model)
            p = 1 / (1 + np.exp(-np.clip(f @ weights[1:] + weights[0], -30, 30))) if weights is not None else np.zeros(len(f))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(plain[:, 0].copy()), pa.array(plain[:, 1].copy()), pa.array(p)], names=["doc_id", "passage", "whole", "score"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights (intercept first) of a logistic fit of weighted rows with a small ridge on columns of unit variance, by Newton's steps."""
    scale = np.append(1.0, np.where((sd := x.std(axis=0)) > 0, sd, 1.0))
    x = np.column_stack([np.ones(len(x)), x]) / scale
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w / scale


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", cut: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the log-ratios passage and whole (over all grades: the highest mean over a passage, the mean).

    labels: id_col and label_col (0 or 1; other values and null ids are ignored, the higher of repeated labels holds). Labels of held-out
    ids are never used. Null and empty texts get the score of a text without evidence. Where the sample lacks one of the classes,
    all scores are 0 (or 1, if all labels are toxic). Ids may be null or repeat: each row is scored alone. No rows: no rows.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("l_id"), F.col(label_col).cast("int").alias("class")).where("l_id is not null and class in (0, 1)").where(~held_out(F.col("l_id")))
    known = table(known.groupBy("l_id").agg(F.max("class").alias("class")))
    sizes = {r[0]: r[1] for r in known.groupBy("class").agg(F.count("*")).collect()}
    some = [known.where(F.col("class") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(max(1, sample // 2)) for c in (0, 1)]
    picked = table(some[0].union(some[1]))  # sample rows at most
    ids = picked.withColumn("fold", F.pmod(F.xxhash64("l_id", F.lit(7)), F.lit(FOLDS)).cast("int"))
    rows = base.join(F.broadcast(ids), base.doc_id == ids.l_id).select("class", "fold", "text")
    model = learn(rows, table(word_counts(base))) if len(sizes) == 2 else None
    weights = None
    if model is not None:
        shared = spark.sparkContext.broadcast((model, None))
        got = rows.mapInArrow(trimmed(_sampled(shared)), "class int, " + ", ".join(f"f{k} double" for k in range(FEATURES))).toPandas()  # numbers of the sample's rows
        shared.unpersist()
        y = got["class"].to_numpy(float)
        if 0 < y.sum() < len(y):
            share = {c: sizes[c] / min(sizes[c], max(1, sample // 2)) for c in sizes}
            weights = _logistic(got[[f"f{k}" for k in range(FEATURES)]].to_numpy(), y, np.where(y == 1, share[1], share[0]))
    only = 1.0 if set(sizes) == {1} else 0.0
    model = model.only(FOLDS) if model else Model([np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)], [[np.zeros(0)] * 3], [np.zeros(0, np.int8)], [0.0])
    shared = spark.sparkContext.broadcast((model, weights))
    scored = base.mapInArrow(trimmed(_score(shared)), "doc_id long, passage double, whole double, score double")
    score = F.col("score") if weights is not None else F.lit(only)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= cut).cast("int").alias("predicted"), "passage", "whole")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
