import duckdb
import numpy as np

from seqprep.llm import op06_embedding_dedup as o6

SF = "/root/testdata/sf0.01"


def brute(rows):
    units = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        units[i] = (label, len(v), np.array(v, float) / np.linalg.norm(np.array(v, float)))
    links = {i: set() for i, _, _ in rows}
    for i, (a, m, x) in units.items():
        for j, (b, n, y) in units.items():
            if i != j and a == b and m == n and x @ y >= 0.98:
                links[i].add(j)
    out = {}
    for i in sorted(links):
        seen, todo = set(), [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen.add(k)
                todo += links[k]
        out[i] = (len(links[i]), min(seen))
    return out


def rows_(seed=1, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 24))
    rows = []
    for i in range(n):
        kind = i % 4
        v = rng.standard_normal(24) if kind == 0 else centres[i % 20] + rng.standard_normal(24) * (0.05, 0.12, 0.16)[kind - 1]
        rows.append((i, [float(x) for x in np.float32(v)], int(i % 3) if i % 50 else None))
    rows[8] = (8, None, 1)
    rows[9] = (9, [0.0] * 24, 0)
    rows[10] = (10, [float("nan")] + [1.0] * 23, 1)
    rows[11] = (11, [None] + [1.0] * 23, 1)
    rows[12] = (12, [1.0] * 5, 0)
    rows[15] = (15, [2.0] * 5, 0)
    rows[16] = (16, rows[13][1], rows[13][2])
    rows[17] = (17, [], 0)
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = rows_()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute(rows)
    for part in (512, 7):
        monkeypatch.setattr(o6, "PART", part)
        got = {r.vec_id: (r.n_links, r.component_id) for r in o6.embedding_dedup(df).collect()}
        assert got == want


def test_list_decoding_is_complete():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = o6.codewords(10, 12, 1)
    for v, got in zip(x, o6.decode(x, 12, 1.5, 1), strict=True):
        scores = (v[:5] @ a)[:, None] + (v[5:] @ b)[None, :]
        assert got.tolist() == (np.flatnonzero(scores.ravel() >= 1.5) + 144).tolist()


def test_repeated_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int, kept string, n_links int"
    assert o6.embedding_dedup(spark.createDataFrame([], schema)).collect() == []
    v = [1.0, 2.0, 3.0]
    rows = [(4, v, 1, "", 0), (4, v, 1, "", 0), (None, v, 1, None, None), (2, v, 2, "", 0)]
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in o6.embedding_dedup(spark.createDataFrame(rows, schema)).collect())
    assert sorted(got) == sorted([("2", 0, 2, True), ("4", 2, 4, True), ("4", 2, 4, False), ("None", 2, 4, False)]) or sum(g[3] or False for g in got) == 2


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(f"select vec_id, n_links, component_id, kept from ({o6.SQL}) order by 1").fetchall()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in o6.query(spark, SF).collect()) == want


def test_packed_differences():
    rng = np.random.default_rng(7)
    lists = [np.sort(rng.integers(0, 1 << 40, n)) for n in (5, 0, 1, 300)] + [np.arange(3), np.array([0])]
    ends = np.cumsum([len(v) for v in lists])
    data, places = o6.packed(o6.differences(np.concatenate(lists), ends))
    places = np.concatenate([[0], places])
    for v, end in zip(lists, ends, strict=True):
        whole = data[places[end - len(v)] : places[end]]
        assert o6.unpacked(whole).tolist() == v.tolist()
        assert o6.unpacked(data[places[end - len(v)] : places[end - len(v) + len(v) // 2]]).tolist() == v[: len(v) // 2].tolist()
    codes = [o6.packed(o6.differences(v, np.array([len(v)])))[0] for v in (np.array([1, 5, 900]), np.array([2, 900]), np.array([3, 4]), np.array([], np.int64))]
    assert o6.shared(codes, np.array([0, 0, 1, 0]), np.array([1, 2, 2, 3])).tolist() == [True, False, False, False]


def test_recall_with_many_filters(spark):
    """20,000 vectors of one label: 56 codewords a block, so blocks are cut from rows of filters; 3,000 planted neighbours near the limit."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((20_000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[17_000:] = x[:3_000] + rng.standard_normal((3_000, 48)) * 0.18 / np.sqrt(48)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.98).sum(axis=1) - 1 for k in range(0, len(u), 1000)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(8)
    got = np.array([r.n_links for r in o6.embedding_dedup(df).orderBy("vec_id").collect()])
    assert 1_000 < want.sum() and (got <= want).all() and got.sum() >= 0.98 * want.sum()
