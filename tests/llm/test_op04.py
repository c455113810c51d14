import random
import zlib

import numpy as np

from seqprep.llm import op04_toxicity as o4


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(400)]
    stems = ["slurry", "grimble", "nastor"]
    rows, labels = [], []
    for d in range(n):
        toxic = rng.random() < 0.15
        text = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(stems) + rng.choice(["", "s", "ish", f"x{rng.randrange(99)}"]))  # many forms are rare
        rows.append((d, " ".join(text)))
        labels.append((d, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in o4.toxicity(docs, marks).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    out = [(y, got[d].predicted) for d, y in labels if got[d].held_out]
    right = sum(y and p for y, p in out)
    assert right / sum(y for y, _ in out) > 0.95 and right / max(1, sum(p for _, p in out)) > 0.9


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(600, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 4 == 2 else y) for d, y in labels]
    one, two = ({r.doc_id: r.score for r in o4.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, flipped))
    assert one == two


def test_edges(spark):
    rows, labels = corpus(300, 3)
    schema = "doc_id long, text string, score string, class int"
    odd = [(d, t, "", 0) for d, t in rows] + [(5, rows[5][1], None, None), (None, "slurry slurry", "", 0), (900, None, "", 0), (901, "", "", 0), (902, "plain " * 60_000, "", 0)]
    marks = spark.createDataFrame([*labels, (None, 1), (5, 0), (900, None), (901, 7)], "doc_id long, toxic int")
    got = o4.toxicity(spark.createDataFrame(odd, schema), marks).collect()
    assert len(got) == len(odd)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[5][0] == by[5][1] and by[900] == by[901]
    none = o4.toxicity(spark.createDataFrame(odd, schema), marks.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    assert o4.toxicity(spark.createDataFrame([], schema), marks).collect() == []


def brute(sample, shared):
    """Log-ratios of a word by plain class-conditional Kneser-Ney; sample: (text, class), shared: {word: corpus count}."""
    import re

    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower())
    pairs = {(c, a, b) for t, c in sample for a, b in zip([None, *words(t)], words(t), strict=False)}
    cut = {0: lambda w: w, 1: lambda w: w.encode()[:6], 2: lambda w: w.encode()[:4]}
    count = [{}, {}, {}]
    corpus = [{}, {}, {}]
    for k in range(3):
        for c, _, w in pairs:
            count[k].setdefault(cut[k](w), [0, 0])[c] += 1
        for w, n in shared.items():
            corpus[k][cut[k](w)] = corpus[k].get(cut[k](w), 0) + n
    mass = [sum(v[c] for v in count[0].values()) for c in (0, 1)]

    def given(k, c):
        """Discount of each count, by the counts of counts."""
        n = [sum(v[c] == i for v in count[k].values()) for i in range(5)]
        if not n[1] or not n[2]:
            return lambda x: min(x, 0.75)
        y = n[1] / (n[1] + 2 * n[2])
        d = [0.0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i] if n[i] else 0.75, 0.05), i - 0.05) for i in (1, 2, 3))]
        return lambda x: min(x, d[min(x, 3)])

    discount = [[given(k, c) for c in (0, 1)] for k in range(3)]
    freed = [[sum(discount[k][c](v[c]) for v in count[k].values()) / mass[c] for c in (0, 1)] for k in range(3)]

    def p(w, k, c):
        key = cut[k](w)
        below = corpus[k][key] / sum(corpus[k].values()) if k == 2 else p(w, k + 1, c) * corpus[k][key] / corpus[k + 1][cut[k + 1](w)]
        seen = count[k].get(key, (0, 0))[c]
        return (seen - discount[k][c](seen)) / mass[c] + freed[k][c] * below

    assert all(abs(sum(p(w, 0, c) for w in shared) - 1) < 1e-9 for c in (0, 1))  # a distribution for each class
    return words, {w: np.log(p(w, 0, 1) / p(w, 0, 0)) for w in shared}


def test_scores_equal_brute_force(spark):
    rows, labels = corpus(200, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in o4.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    h = lambda w: int(o4._Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).word.view(np.int64)[0])
    estimates = {r.h: r.shared for r in o4.word_counts(docs).collect()}
    before: dict = {}
    for _, t in rows:
        w = t.split()
        for a, b in zip([None, *w], w, strict=False):
            before.setdefault(b, set()).add(a)
    shared = {w: estimates[h(w)] for w in before}
    error = [shared[w] / len(b) - 1 for w, b in before.items()]
    assert len(shared) == len(estimates) and abs(np.mean(error)) < 0.05 and np.std(error) < 0.15
    # the documents that the models are made of: labelled, not held out
    sample = [(rows[d][1], c) for d, c in labels if zlib.crc32(str(d).encode()) % 4 != 2]
    words, ratio = brute(sample, shared)
    for d, t in rows:
        x = [ratio[w] for w in words(t)]
        assert abs(got[d].whole - sum(x) / max(len(x), o4.PASSAGE)) < 1e-5
        assert abs(got[d].passage - max(sum(x[k : k + o4.PASSAGE]) / o4.PASSAGE for k in range(len(x)))) < 1e-5


def stem(w):
    return int.from_bytes(w.encode()[:6].ljust(6, b"\0"), "big")


def fitted(words, counts, shared):
    """The model of all folds, of words with these (2, words) counts."""
    h, six = np.arange(1, len(words) + 1).astype(np.uint64), np.array([stem(w) for w in words])
    six_keys = np.unique(six)
    four_keys = np.unique(six_keys >> 16)
    six_shared = np.bincount(np.searchsorted(six_keys, six), shared).astype(float)
    four_shared = np.bincount(np.searchsorted(four_keys, six_keys >> 16), six_shared)
    counts = np.array([counts] * (o4.FOLDS + 1))
    model = o4.fit(h, six, counts, np.array(shared, float), [(six_keys, six_shared), (four_keys, four_shared)], float(sum(shared)))
    return lambda word, text: model.of([np.array([word], np.uint64), np.array([stem(text)]), np.array([stem(text) >> 16])], o4.FOLDS)


def test_backoff_is_shared():
    """A rare form is judged by its stem, beside what no level knows."""
    words = ["grimbles", "grimbly", "plain", "other", *(f"x{k}" for k in range(40))]
    one = [k % 3 == 0 for k in range(40)]
    of = fitted(words, [[0, 0, 400, 200, *(1 + (k % 2) for k in range(40))], [30, 10, 50, 40, *map(int, one)]], [3, 1, 45, 24, *([2] * 40)])
    unknown = of(99, "unknown")[0][0]
    assert of(99, "grimblesque")[0][0] > unknown + 1 and of(99, "grimace")[0][0] > unknown + 0.5 and of(2, "grimbly")[0][0] > 1 > of(3, "plain")[0][0]
    assert of(99, "unknown")[1][0] == 0 and of(3, "plain")[1][0] == len(o4.EDGES)


def test_rare_words_weigh():
    """Words that only the toxic class has count for it, from the first occurrence on."""
    rng = np.random.default_rng(4)
    words = [f"{chr(97 + k % 26)}{k}" for k in range(600)]
    ordinary, toxic = np.zeros(600, int), np.zeros(600, int)
    ordinary[:500] = rng.geometric(0.5, 500)
    toxic[400:600] = rng.geometric(0.5, 200)
    toxic[590:594] = (1, 2, 3, 8)
    of = fitted(words, [ordinary, toxic], [3] * 600)
    ratios = [of(k + 1, words[k])[0][0] for k in (590, 591, 592, 593)]
    assert min(ratios) > 0 and max(ratios) == ratios[3]
    assert [int(of(k + 1, words[k])[1][0]) for k in (590, 591, 592, 593)] == [1, 2, 3, 4]


def test_discounts_stay_below_their_counts():
    for counts in ([0, 0], [1], [1, 1, 2], [1] * 50 + [2] * 20 + [3] * 30 + [4] * 2, [5, 9, 70], [1, 2, 3, 4, 4, 4, 4, 4]):
        given = o4.discounts(np.array(counts))
        assert all((0 < g < min(c, 3)) if c else g == 0 for g, c in zip(given, counts, strict=True))


def test_classes_are_sampled_alike(spark):
    """Few labelled documents are toxic: all of them enter, however small the sample."""
    rows, labels = corpus(1200, 6)
    kept = [x for x in labels if not x[1]] + [x for x in labels if x[1]][:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in o4.toxicity(docs, spark.createDataFrame(kept, "doc_id long, toxic int"), sample=160).collect()}
    out = [(y, got[d].predicted) for d, y in labels if got[d].held_out]
    assert sum(y and p for y, p in out) > 0.8 * sum(y for y, _ in out) and sum(p for _, p in out) < 1.3 * sum(y for y, _ in out)


def test_backoff_counts_have_no_ceiling(spark):
    """A word with 20,000 different words before it counts about as many, in any number of tasks; rare words count nearly exactly."""
    rows = [(" ".join(f"w{k} common" for k in range(a, a + 100)),) for a in range(0, 20_000, 100)] + [("few rare few rare",), ("some rare",)]
    names = {n: int(o4._Words(np.frombuffer(n.encode(), np.uint8), np.array([0, len(n)])).word.view(np.int64)[0]) for n in ("common", "rare", "w7")}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "text string").repartition(parts)
        got = {r.h: r for r in o4.word_counts(df).collect()}
        assert len(got) == 20_004
        assert 14_000 < got[names["common"]].shared < 26_000
        assert 1.5 < got[names["rare"]].shared < 2.5 and 0.9 < got[names["w7"]].shared < 1.1
        assert all(r.six > 0 for r in got.values())


def test_class_counts_are_exact(spark):
    df = spark.createDataFrame([("few rare few rare", 0, 0), ("some rare", 1, 1), ("few rare", 0, 3)], "text string, class int, fold int")
    got = o4.class_counts(df).collect()
    assert sorted((r.c0_4, r.c1_4) for r in got) == [(0, 1), (1, 1), (2, 0)]
    assert sorted((r.c0_0, r.c1_0) for r in got) == [(0, 1), (1, 0), (1, 1)]  # without the first
    assert sorted((r.c0_1, r.c1_1) for r in got) == [(0, 0), (1, 0), (2, 0)] and sorted((r.c0_3, r.c1_3) for r in got) == [(0, 1), (1, 1), (2, 0)]
