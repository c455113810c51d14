import random
import re

from seqprep.llm.op01_ngram_join import ngram_join


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: grams(t) for d, t in rows}
    ids = sorted(sets)
    links = {d: set() for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) * 10 >= 8 * len(x | y):
                links[a].add(b)
                links[b].add(a)
    comp = {}
    for d in ids:
        if d not in comp:
            todo = [d]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = d
                    todo += links[x]
    return {d: (comp[d], len(links[d])) for d in ids}


def corpus(seed):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(4000)}" for _ in range(k)]
    rows, base = [], make(120)
    for d in range(250):
        k = d % 5
        words = make(rng.randrange(0, 80))
        if k == 1:
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(999)}"
        if k == 2 and rows:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.5:
                words[0] = "changed"
        rows.append((d, " ".join(words)))
    return rows


def test_matches_brute_force(spark, monkeypatch):
    from seqprep.llm import op01_ngram_join as m

    rows = corpus(5)
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for grams_, sets in ((m.PART_GRAMS, m.PART_SETS), (1500, m.PART_SETS), (m.PART_GRAMS, 5)):  # one block, then several size classes and parts
        monkeypatch.setattr(m, "PART_GRAMS", grams_)
        monkeypatch.setattr(m, "PART_SETS", sets)
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df).collect()}
        assert got == want


def test_edges(spark):
    schema = "doc_id long, text string, kept int, class_id string"
    assert ngram_join(spark.createDataFrame([], schema)).collect() == []
    text = "one two three four five six"
    rows = [(3, text, 1, ""), (3, text, 1, ""), (None, text, None, None), (1, None, 1, ""), (2, "", 1, ""), (4, "short", 1, ""), (6, "short", 1, ""), (7, "z " * 50_000, 0, "")]
    got = sorted(ngram_join(spark.createDataFrame(rows, schema)).select("doc_id", "class_id", "n_links", "kept").collect(), key=str)
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(3, 3, 2), (None, 3, 2), (1, 1, 0), (2, 2, 0), (4, 4, 1), (6, 4, 1), (7, 7, 0)}
    assert sum(r.kept for r in got) == 5


def test_blocks_pair_each_two_sets_once(spark, monkeypatch):
    """Any two sets of a component whose sizes allow a link meet in exactly one block, on different sides or in a block of one part."""
    from seqprep.llm import op01_ngram_join as m

    monkeypatch.setattr(m, "PART_SETS", 7)
    rng = random.Random(3)
    rows = [(d, d % 3, 1 + int(rng.random() ** 3 * 400), 1) for d in range(240)] + [(1000 + d, 9, 50, 1) for d in range(7)]
    met = {}
    blocks = {}
    for r in m.block_pairs(spark.createDataFrame(rows, "doc_id long, component long, size int, copies long"), 0.8).collect():
        blocks.setdefault((r.component, r.p, r.q), []).append((r.doc_id, r.side))
    for (_, p, q), some in blocks.items():
        assert len(some) <= 40
        for i, (a, x) in enumerate(some):
            for b, y in some[:i]:
                if p == q or x != y:
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    assert set(met.values()) == {1}
    for i, (a, c, n, _) in enumerate(rows):
        for b, e, k, _ in rows[:i]:
            if c == e and min(n, k) >= 0.8 * max(n, k):
                assert frozenset((a, b)) in met


def test_many_short_texts_of_one_component(spark):
    """Boilerplate with one word changed: 12,000 small sets that meet in bands and don't link; and 30,000 that are too small to link at all."""
    rows = [(d, f"one two three four five six seven eight w{d}") for d in range(12_000)] + [(50_000 + d, f"a b c d e u{d}") for d in range(30_000)]
    rows += [(90_000, "one two three four five six seven eight nine ten eleven twelve"), (90_001, "one two three four five six seven eight nine ten eleven")]
    got = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    assert {(r.doc_id, r.class_id, r.n_links) for r in got.where("n_links > 0").collect()} == {(90_000, 90_000, 1), (90_001, 90_000, 1)}
    assert got.where("kept").count() == len(rows) - 1
