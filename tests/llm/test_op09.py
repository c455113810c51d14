import random

from seqprep.llm import op09_packing as o9


def plain_best_fit(lengths, sizes, least):
    rooms, where = [], []
    for n in lengths:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            room = min(fits)[0]
            k = max(k for r, k in fits if r == room and True)
        else:
            rooms.append(min([s for s in sizes if s >= n and s >= least]))
            k = len(rooms) - 1
        rooms[k] -= n
        where.append(k)
    return rooms, where


def test_best_fit_fills_like_a_plain_search():
    rng = random.Random(4)
    for _ in range(30):
        lengths = sorted((rng.randrange(1, 100) for _ in range(60)), reverse=True)
        where, opened = o9.best_fit(lengths, [50, 100], 50)
        rooms, _ = plain_best_fit(lengths, [50, 100], 50)
        left = [o - sum(n for n, k in zip(lengths, where, strict=True) if k == b) for b, o in enumerate(opened)]
        assert sorted(left) == sorted(rooms) and min(left) >= 0


def test_cheapest_policy_and_downsizing():
    where, final = o9.pack([60, 40, 30, 20, 5], [32, 64, 128], 4)
    filled = [sum(n for n, k in zip([60, 40, 30, 20, 5], where, strict=True) if k == b) for b in range(len(final))]
    assert all(f <= s for f, s in zip(filled, final, strict=True))
    assert all(min(x for x in (32, 64, 128) if x >= f) == s for f, s in zip(filled, final, strict=True))
    costs = []
    for least in (32, 64, 128):
        w, opened = o9.best_fit([60, 40, 30, 20, 5], [32, 64, 128], least)
        fill = [sum(n for n, k in zip([60, 40, 30, 20, 5], w, strict=True) if k == b) for b in range(len(opened))]
        costs.append(sum(min(x for x in (32, 64, 128) if x >= f) + 4 for f in fill))
    assert sum(final) + 4 * len(final) == min(costs)


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(o9, "SHARD", 64)
    rng = random.Random(5)
    items = [(k, rng.randrange(0, 3000)) for k in range(400)] + [(7, 50), (None, 9000), (1001, None), (1002, -5)]
    df = spark.createDataFrame(items, "doc_id long, length long").withColumnRenamed("length", "n").selectExpr("*", "'x' capacity", "1 piece")
    rows = o9.best_fit_packing(df, length_col="n").collect()
    total = {}
    for r in rows:
        total.setdefault(r.doc_id, []).append(r.length)
    want = {}
    for d, n in items:
        want.setdefault(d, []).append(max(n or 0, 0))
    assert {d: sum(x) for d, x in total.items()} == {d: sum(x) for d, x in want.items()}
    bins = {}
    for r in rows:
        if r.bin_id is None:
            assert r.length == 0
            continue
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        b.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in b] == [sum(x.length for x in b[:k]) for k in range(len(b))]
        used = sum(r.length for r in b)
        assert {r.capacity for r in b} == {min(s for s in o9.LENGTHS if s >= used)}
    used = sum(r.length for r in rows)
    assert used / sum(b[0].capacity for b in bins.values()) > 0.9
    assert o9.best_fit_packing(df.limit(0), length_col="n").collect() == []


def test_lengths(spark):
    df = spark.createDataFrame([(1, "a b  c", 1), (2, None, 1), (None, "", 1)], "doc_id long, text string, length int")
    got = {r.doc_id: r.length for r in o9.token_lengths(df).collect()}
    assert got[1] >= 3 and got[2] == got[None] == 0 and len(got) == 3


def test_rows_alike_are_spread(spark, monkeypatch):
    """Null ids of one length, the hottest key there is: shards are even."""
    monkeypatch.setattr(o9, "SHARD", 1000)
    df = spark.range(16_000).selectExpr("cast(null as long) doc_id", "100L length")
    got = o9.best_fit_packing(df).selectExpr("shiftright(bin_id, 32) shard").groupBy("shard").count().collect()
    assert len(got) == 16 and max(r["count"] for r in got) < 1300


def test_packing_equals_brute_force(spark):
    """One shard: the cost of the whole is the least of the plain searches over all opening policies."""
    rng = random.Random(6)
    items = [(k, rng.randrange(1, 4096)) for k in range(300)]
    bins = {}
    for r in o9.best_fit_packing(spark.createDataFrame(items, "doc_id long, length long")).collect():
        bins[r.bin_id] = r.capacity
    costs = []
    for least in o9.LENGTHS:
        lengths = sorted((n for _, n in items), reverse=True)
        rooms, where = plain_best_fit(lengths, o9.LENGTHS, least)
        fill = [0] * len(rooms)
        for n, k in zip(lengths, where, strict=True):
            fill[k] += n
        costs.append(sum(min(s for s in o9.LENGTHS if s >= f) + o9.OVERHEAD for f in fill))
    assert sum(bins.values()) + o9.OVERHEAD * len(bins) == min(costs)


def test_sequences_hold_all_tokens(spark):
    rows = [(1, "a b c " * 4000), (1, "a b c " * 4000), (None, "x y"), (2, None), (3, "")]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, token_ids string, length int")
    got = o9.packed_sequences(df).collect()
    table = o9.encode(spark.createDataFrame([(7, rows[0][1]), (8, "x y")], "doc_id long, text string"), 1).collect()
    ids = {r.doc_id: r.ids for r in table}
    by = {}
    for r in sorted(got, key=lambda r: (r.row_id, r.piece)):
        assert r.length == len(r.token_ids)
        by.setdefault((r.row_id, r.doc_id), []).extend(r.token_ids)
    assert sorted((str(d), len(x)) for (_, d), x in by.items()) == sorted([("1", len(ids[7]))] * 2 + [("None", len(ids[8])), ("2", 0), ("3", 0)])
    assert all(x == {1: ids[7], None: ids[8]}.get(d, []) for (_, d), x in by.items())
    assert len({(r.bin_id, r.bin_start) for r in got if r.length}) == sum(r.length > 0 for r in got)
    assert o9.packed_sequences(df.limit(0)).collect() == []
