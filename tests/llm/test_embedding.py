import numpy as np

from wirelake.llm.op03_embedding import PROBES, RECALL, THRESHOLD, cells, decode, duplicates, plan


def brute(vectors, threshold=THRESHOLD):
    m = np.array(list(vectors.values()))
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    ids = list(vectors)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(np.triu(m @ m.T >= threshold, 1))):
        x, y = sorted((find(ids[a]), find(ids[b])))
        root[y] = x
    return {i: find(i) for i in ids if find(i) != i}


def test_against_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(600, 64))
    vectors = {i: v for i, v in enumerate(base)}
    for k in range(500):  # copies at cosines around and above the threshold
        noise = r.uniform(0.02, 0.4)
        vectors[1000 + k] = base[k % 200] + noise * r.normal(size=64)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["duplicate_of"] for r in duplicates(df).collect()}
    want = brute({i: np.float32(v).astype(float) for i, v in vectors.items()})
    assert len(want) > 300 and sum(got.get(i) == j for i, j in want.items()) >= 0.95 * len(want)
    assert all(i in want for i in got)  # nothing that isn't near


def test_lattice_points_are_nearest():
    r = np.random.default_rng(3)
    x = r.normal(size=(200, 8)) * 2
    p = decode(x)
    assert np.allclose(p * 2, np.rint(p * 2)) and np.all(np.isclose(p.sum(1) % 2, 0) | np.isclose(p.sum(1) % 2, 2))
    from wirelake.llm.op03_embedding import ROOTS

    assert len(ROOTS) == 240 and all(((x[:, None] - p[:, None] - ROOTS) ** 2).sum(-1).min(1) >= ((x - p) ** 2).sum(1) - 1e-9)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, v), (2, v), (None, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, [None, 1.0]), (6, [None, 1.0]), (7, [nan]), (8, [inf, 1.0]), (9, []), (10, []), (11, [0.0, 0.0]), (12, [0.0, 0.0]), (13, [1.0, 2.0]), (14, [-1.0, -2.0, -3.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, node int, unit int, bucket int")
    got = sorted(((r["vec_id"] is None, r["vec_id"]), r["duplicate_of"]) for r in duplicates(df).collect())
    assert got == [((False, 2), 1), ((False, 2), 1), ((False, 3), 1), ((False, 6), 5), ((False, 10), 9), ((False, 12), 11), ((True, None), 1)]
    assert duplicates(df.limit(0)).count() == 0


def test_large_group(spark):
    r = np.random.default_rng(4)
    c = r.normal(size=64)
    rows = [(i, [float(x) for x in c + 0.02 * r.normal(size=64)]) for i in range(1500)]
    got = duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 1499 and {r["duplicate_of"] for r in got} == {0} and {r["group_size"] for r in got} == {1500}


def test_unrelated_vectors_meet_rarely_however_many_there_are():
    """Candidates of a vector, counted in full: about as many among five times the vectors."""
    r = np.random.default_rng(5)
    x = r.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    each, keys = [], []
    for n in (4_000, 20_000):
        p = plan(x[:1000], n)
        met = 0
        entered = cells(x[:n], p.tables, p.blocks, PROBES, 1.0)
        for t in range(p.tables):
            _, k = np.unique(entered[:, t], return_counts=True)
            met += (k * (k - 1) // 2).sum()
        each.append(met / n)
        keys.append(p.tables * (1 + PROBES))
    assert each[1] < 2 * each[0] + 5 and keys[1] < 2 * keys[0]


def test_recall_at_the_threshold():
    r = np.random.default_rng(6)
    x = r.normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = THRESHOLD * x + np.sqrt(1 - THRESHOLD**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    for n in (1_000, 100_000):
        p = plan(x, n)
        a, b = (cells(v, p.tables, p.blocks, PROBES, 1.0) for v in (x, y))
        assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > RECALL - 0.015


def test_a_dense_topic_among_many_vectors(spark):
    """A third of the vectors lie within a cosine of 0.8 of one another, below the threshold: nothing groups but the planted copies."""
    r = np.random.default_rng(7)
    topic = r.normal(size=64)
    topic /= np.linalg.norm(topic)
    v = r.normal(size=(3_000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[:1_000] = 0.9 * topic + np.sqrt(0.19) * v[:1_000]
    rows = [(i, [float(e) for e in x]) for i, x in enumerate(v)] + [(10_000 + i, [float(e) for e in v[i] + 0.01 * r.normal(size=64)]) for i in range(0, 3_000, 10)]
    got = {x["vec_id"]: x["duplicate_of"] for x in duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {10_000 + i: i for i in range(0, 3_000, 10)}
