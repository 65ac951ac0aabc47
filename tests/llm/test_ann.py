import numpy as np

from tideline.llm import ann
from tideline.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int, vid string, score string, ids string"


def brute(rows, every, k):
    known = {}
    for vec_id, v in rows:
        if vec_id is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            known[vec_id] = np.array(v, dtype=np.float32).astype(np.float64)
    ids = np.array(sorted(known))
    x = np.array([known[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        scores = (x @ known[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(known[q]))
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), scores[i]) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r.rank
    return out


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(i, [5.0, 5.0, 1.0]) for i in range(100, 180)]
    bad = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [nan, 1.0, 1.0]), (204, [inf, 1.0, 1.0]), (205, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (210, [1.0, 2.0])]
    again = rows[:5]
    frame = spark.createDataFrame([(*r, 0, "x", "x", "x") for r in rows + bad + again], SCHEMA)
    got, want = found(ann.nearest(frame, every=10)), brute(rows, 10, 5)
    assert got.keys() == want.keys()
    for q, near in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near], atol=1e-12)
    assert ann.nearest(frame.limit(0), every=10).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "", "", ""), (1, [0.0, 1.0], 0, "", "", "")], SCHEMA)
    assert found(ann.nearest(few, every=50)) == {0: [(1, 0.0)]}
    alone = spark.createDataFrame([(0, [1.0, 0.0], 0, "", "", "")], SCHEMA)
    assert ann.nearest(alone, every=50).count() == 0


def test_recall_with_many_buckets(spark):
    frame = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    got, want = found(ann.nearest(frame, bucket_rows=32)), brute(rows, 50, 5)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in near}) / len(near) for q, near in want.items()]
    assert np.mean(hits) >= 0.9


def test_narrow_windows_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([c + 0.01 * rng.standard_normal((40, 16)) for c in centres])
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(frame, every=20, bucket_rows=32))
    known = {i: np.array(v) for i, v in rows}
    hits = []
    for q in got:
        scores = {i: v @ known[q] / np.linalg.norm(v) / np.linalg.norm(known[q]) for i, v in known.items() if i != q}
        best = set(sorted(scores, key=scores.get)[-5:])
        hits.append(len(best & {i for i, _ in got[q]}) / 5)
    assert len(hits) == 120 and np.mean(hits) >= 0.9


def test_hilbert_is_a_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        key = ann.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(side**dims))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()
