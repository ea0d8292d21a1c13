import numpy as np

from tripleflow.llm import ann

SCHEMA = "id long, v array<float>, rep string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)


def clustered(n, dim, seed):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(12, dim))
    v = centres[dice.integers(0, 12, n)] * dice.uniform(0.3, 1.2, (n, 1)) + dice.normal(size=(n, dim))
    near = dice.choice(n, n // 8, replace=False)
    v = np.concatenate([v, v[near] * dice.uniform(0.1, 9, (len(near), 1)) + dice.normal(size=(len(near), dim)) * 0.05])
    return [(i + 1, x) for i, x in enumerate(v.astype(np.float32))]


def cosines(rows):
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m @ m.T


def test_pairs_against_brute_force(spark):
    rows = clustered(900, 32, 1)
    rows += [(5000 + k, rows[0][1]) for k in range(4)] + [(6000, -rows[1][1])]
    c, ids = cosines(rows), [i for i, _ in rows]
    want = {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(c >= 0.9)) if i != j}
    got = [tuple(r) for r in ann.similar_pairs(ann.usable(frame(spark, rows), "id", "v", 32)).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(got) >= 0.99 * len(want)


def test_unusable_vectors_take_no_part(spark):
    good = [1.0] * 8
    rows = [(1, good), (2, good), (3, None), (4, []), (5, [0.0] * 8), (6, [1.0] * 7), (7, [float("nan")] + [1.0] * 7), (8, [None] + [1.0] * 7), (9, [float("inf")] + [1.0] * 7), (10, [2.0] * 8)]
    got = {tuple(r) for r in ann.similar_pairs(ann.usable(frame(spark, rows), "id", "v", 8)).collect()}
    assert got == {(1, 2), (1, 10), (2, 10)}
    assert ann.similar_pairs(ann.usable(frame(spark, rows[2:4]), "id", "v", 8)).count() == 0


def test_lists_in_blocks_lose_nothing(spark, monkeypatch):
    rows = clustered(300, 16, 3)
    vectors = ann.usable(frame(spark, rows), "id", "v", 16)
    whole = {tuple(r) for r in ann.similar_pairs(vectors).collect()}
    monkeypatch.setattr(ann, "CHUNK", 20)
    assert {tuple(r) for r in ann.similar_pairs(vectors).collect()} == whole


def test_top_k_recall(spark):
    rows = clustered(1500, 32, 2)
    vectors = ann.usable(frame(spark, rows), "id", "v", 32)
    c, ids = cosines(rows), np.array([i for i, _ in rows])
    np.fill_diagonal(c, -2)
    got: dict[int, list[int]] = {}
    for r in ann.most_similar(vectors, vectors.where("id % 20 = 0"), 10).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert set(got) == {int(ids[k]) for k in asked} and all(len(v) == 10 for v in got.values())
    hits = sum(len(set(got[int(ids[k])]) & set(ids[np.argsort(-c[k])[:10]].tolist())) for k in asked)
    assert hits / (10 * len(asked)) >= 0.9


def test_posted_lists_hold_every_pair():
    """Two vectors with a cosine of 0.8 are in one cell, or one of them is posted in the other's."""
    rows = clustered(600, 24, 4)
    v = ann.unit(np.array([x for _, x in rows]))
    pivots = v[:40].astype(np.float32)
    cell = (v.astype(np.float32) @ pivots.T).argmax(axis=1)
    order = np.argsort(cell, kind="stable")
    block = ann.Block(cell[order].astype(np.int32).tobytes(), np.arange(len(v))[order].tobytes(), v[order].astype(np.float32).tobytes())
    posted = block.posted(pivots, block, np.sqrt(2 - 2 * 0.8) / 2)
    met = posted[:, block.at]
    c = block.v @ block.v.T
    assert (met | met.T)[c >= 0.8].all() and not met.all()


def crowd(n, dim, seed, noise):
    """A third of all rows around one centre, the others anywhere."""
    dice = np.random.default_rng(seed)
    v = dice.normal(size=(n, dim))
    v[: n // 3] = dice.normal(size=dim) + dice.normal(size=(n // 3, dim)) * noise
    return [(i + 1, x) for i, x in enumerate(v.astype(np.float32))]


def test_pairs_in_a_crowd_are_all_found(spark):
    rows = crowd(2400, 128, 5, 0.33)
    c, ids = cosines(rows), [i for i, _ in rows]
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(c >= 0.9, 1)))}
    got = [tuple(r) for r in ann.similar_pairs(ann.usable(frame(spark, rows), "id", "v", 128)).collect()]
    assert len(want) > 100_000 and len(got) == len(set(got)) and set(got) == want


def test_top_k_in_a_crowd_is_exact(spark):
    rows = crowd(6000, 128, 6, 0.33)
    c, ids = cosines(rows), np.array([i for i, _ in rows])
    np.fill_diagonal(c, -2)
    vectors = ann.usable(frame(spark, rows), "id", "v", 128)
    got: dict[int, list[int]] = {}
    for r in ann.most_similar(vectors, vectors.where("id % 50 = 0"), 10).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {int(ids[k]): ids[np.argsort(-c[k], kind="stable")[:10]].tolist() for k, i in enumerate(ids) if i % 50 == 0}


def test_top_k_shows_copies(spark):
    rows = [(i, x) for i, (_, x) in zip(range(100, 140), clustered(35, 16, 7))]
    rows += [(i, rows[3][1]) for i in (5, 200, 201)] + [(i, rows[4][1]) for i in range(300, 320)]
    c, ids = cosines(rows), np.array([i for i, _ in rows])
    vectors = ann.usable(frame(spark, rows), "id", "v", 16)
    got: dict[int, list[int]] = {}
    for r in ann.most_similar(vectors, vectors, 6).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got == {int(i): [int(ids[j]) for j in np.lexsort((ids, -np.round(c[k], 12))) if j != k][:6] for k, i in enumerate(ids)}
    assert got[200][:3] == [5, 103, 201] and got[310] == [104, 300, 301, 302, 303, 304]
