import numpy as np
import pytest

from tierstone.operators import lsh, vectors


@pytest.fixture
def made(spark):
    def make(rows, name="vec_id"):
        return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<float>")

    return make


def exact(rows, asked, k):
    rows = [(i, np.float64(np.float32(v))) for i, v in rows if v is not None and np.any(v)]
    out = set()
    for q, w in asked:
        if w is None or not np.any(w):
            continue
        w = np.float64(np.float32(w))
        scored = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 12), i) for i, v in rows)
        out |= {(q, i, r) for r, (_, i) in enumerate(scored[:k], 1)}
    return out


def found(df):
    return {(r["query_id"], r["vec_id"], r["rank"]) for r in df.collect()}


def clustered(n=4000, dim=32, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, dim))
    return [(i, centres[i % 40] + 0.4 * draw.normal(size=dim)) for i in range(n)]


def test_recall_of_clustered_and_of_random_vectors(made, capsys):
    draw = np.random.default_rng(2)
    for name, rows in (("clustered", clustered()), ("random", [(i, draw.normal(size=32)) for i in range(4000)])):
        asked = rows[::40]
        got = found(lsh.nearest_by_planes(made(rows), made(asked, "query_id"), 5, "vec_id", "embedding", bucket_rows=64))
        wanted = exact(rows, asked, 5)
        recall = len({(q, i) for q, i, _ in got} & {(q, i) for q, i, _ in wanted}) / len(wanted)
        with capsys.disabled():
            print(f"\n{name}: recall {recall:.3f}")
        assert recall >= 0.9 and len(got) == len(wanted)


def test_few_probes_look_at_few_vectors(made, spark):
    rows = clustered()
    planes = lsh.Planes.draw(32, 6, 6)
    corpus, asked = made(rows), made(rows[::40], "query_id")
    probes, reached = lsh.fit_probes(corpus, asked, planes, 5, "vec_id", "embedding", "query_id", 0.95)
    assert reached >= 0.95 and probes <= 16
    keys, probed = planes.keys(np.array([v for _, v in rows])), planes.probes(np.array([v for _, v in rows[::40]]), probes)
    share = np.mean([np.isin(keys, p).any(axis=1).mean() for p in probed])
    assert share < 0.5


def test_probing_every_bucket_is_exact(made):
    rows = clustered(600)
    asked = [(i, v) for i, v in rows[::30]]
    got = found(lsh.nearest_by_planes(made(rows), made(asked, "query_id"), 7, "vec_id", "embedding", tables=2, bucket_rows=32, probes=1 << 10))
    assert got == exact(rows, asked, 7)


def test_blocks_of_a_hot_bucket(made, monkeypatch):
    """Half of all vectors are one vector, which is one bucket of every table; ties go by id."""
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(500)] + [(500 + i, v[:4]) for i, (_, v) in enumerate(clustered(500))]
    monkeypatch.setattr(lsh, "BLOCK_ROWS", 64)
    monkeypatch.setattr(lsh, "BLOCK_QUERIES", 3)
    asked = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(10)] + [(99, [-1.0, 0.5, 0.0, 2.0])]
    got = found(lsh.nearest_by_planes(made(rows), made(asked, "query_id"), 4, "vec_id", "embedding", bucket_rows=64, probes=1 << 10))
    assert got == exact(rows, asked, 4)


def test_odd_vectors_and_no_vectors(made):
    rows = [(1, None), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    asked = [(1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0])]
    got = found(lsh.nearest_by_planes(made(rows), made(asked, "query_id"), 5, "vec_id", "embedding"))
    assert got == {(1, 3, 1), (1, 4, 2)}
    for corpus, queries in ((rows[:1], asked), (rows, asked[1:]), ([], []), (rows, [])):
        assert lsh.nearest_by_planes(made(corpus), made(queries, "query_id"), 5, "vec_id", "embedding").collect() == []


def test_exact_search_of_a_set_in_parts(made, monkeypatch):
    rows = clustered(300)
    asked = rows[::7]
    whole = found(vectors.top_k_of_each(made(rows), made(asked, "query_id"), 3, "vec_id", "embedding"))
    monkeypatch.setattr(vectors, "MAX_QUERIES", 16)
    assert found(vectors.top_k_of_each(made(rows), made(asked, "query_id"), 3, "vec_id", "embedding")) == whole == exact(rows, asked, 3)


def test_a_task_holds_a_bounded_number_of_similarities():
    import tracemalloc

    draw = np.random.default_rng(4)
    rows, wanted = draw.integers(-3, 4, size=(4096, 8)).astype(float), draw.integers(-3, 4, size=(4000, 8)).astype(float)
    tracemalloc.start()
    got = {int(q): None for _, number, _ in vectors.nearest_in_batch(rows, wanted, 5) for q in number}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 4000 and peak < 100 << 20  # one matrix of all similarities alone is 131 MB
    some = [(list(p), list(s)) for p, n, s in [[np.concatenate(x) for x in zip(*vectors.nearest_in_batch(rows, wanted[:300], 5), strict=True)]]]
    cosine = (rows @ wanted[:300].T) / np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(wanted[:300], axis=1)).clip(1e-300)
    for q in range(300):
        if wanted[q].any():
            left = np.where(rows.any(axis=1), np.round(cosine[:, q], 12), -9)
            assert some[0][0][5 * q : 5 * q + 5] == list(np.argsort(-left, kind="stable")[:5])
