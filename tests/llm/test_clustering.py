import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import values
from tideline.llm import clustering
from tideline.llm.common import table


def by_brute_force(rows, k=8, rounds=10, seed=3, size=64, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == i]
            if mine:
                centroids[i] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    total = {c: sum(d for _, d, o in last if o == c) for _, _, c in last}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), sha[c]) for i, d, c in last), key=repr)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit("x") for c in ("v", "cluster", "distance", "n", "ids", "label", "salt")})


def test_table_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SMALL, "embeddings").collect()]
    assert values(clustering.cluster(table(spark, SMALL, "embeddings")), *COLUMNS) == by_brute_force(rows)


def odd_rows(size):
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((5, size)) * 3
    rows = [(i, [float(np.float32(x)) for x in centres[i % 5] + rng.standard_normal(size) * 0.1]) for i in range(120)]
    rows += [(500 + i, rows[0][1]) for i in range(40)] + [rows[3]] * 4 + [(None, rows[5][1]), (None, rows[6][1])]
    odd = [float("nan"), float("inf"), None, -float("inf")]
    return rows + [(900 + i, [x] + [1.0] * (size - 1)) for i, x in enumerate(odd)] + [(910, None), (911, []), (912, [1.0] * (size + 1)), (913, [0.0] * size), (914, [-0.00001] * size)]


@pytest.mark.parametrize("size, k", [(64, 8), (3, 4), (1, 2), (64, 1000)])
def test_odd_rows(spark, size, k):
    rows = odd_rows(size)
    got = clustering.cluster(frame(spark, rows), k=k, rounds=4, size=size)
    assert values(got, *COLUMNS) == by_brute_force(rows, k, 4, size=size)


def test_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [1.0])]):
        empty = clustering.cluster(frame(spark, rows))
        assert empty.columns == list(COLUMNS) and empty.count() == 0


def test_boxes_leave_out_only_what_cannot_be_nearest():
    rng = np.random.default_rng(0)
    left_out = 0
    for _ in range(300):
        x = rng.integers(-50, 50, 4) + rng.integers(0, rng.integers(2, 40), (20, 4))
        centroids = rng.integers(-60, 90, (8, 4))
        able = clustering.candidates(x.min(0), x.max(0), centroids)
        best, _ = clustering.nearest(x, centroids)
        assert set(best) <= set(able)
        left_out += 8 - len(able)
    assert left_out > 300


def test_blocks_hold_every_vector_once_along_the_curve(spark):
    whole = clustering.whole_vectors(frame(spark, odd_rows(64)))
    blocks = clustering.zone_blocks(whole, block=16).collect()
    assert sum(r.n for r in blocks) == whole.count()
    for r in blocks:
        x = np.frombuffer(r.vecs, "<i4").reshape(r.n, -1)
        assert (x.min(0) == np.frombuffer(r.low, "<i4")).all() and (x.max(0) == np.frombuffer(r.high, "<i4")).all()


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(frame(spark, [(1, [1e30] * 64)])).count()
