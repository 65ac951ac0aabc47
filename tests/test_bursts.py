"""Bursts and sketches against plain Python."""

import datetime as dt
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import bursts

START = dt.date(2024, 3, 1)


def uses(seed=2):
    rng, out = np.random.default_rng(seed), []
    for d in range(25):
        if d in (7, 8):  # days without any term
            continue
        for term, rate in (("hot", 60), ("rising", 3 + 12 * (d == 20)), ("rare", 0.4), ("new", 9 * (d > 18))):
            out += [(START + dt.timedelta(days=d), term)] * int(rng.poisson(rate))
    return out


def plain(rows, k, decay, horizon, least):
    n = Counter(rows)
    total = defaultdict(int)
    for (day, _), c in n.items():
        total[day] += c
    out = {}
    for day in total:
        past = [p for p in total if 1 <= (day - p).days <= horizon]
        weight = {p: decay ** ((day - p).days - 1) for p in past}
        if not past:
            continue
        scored = []
        for (other, term), c in n.items():
            if other != day:
                continue
            share = sum(weight[p] * n[(p, term)] / total[p] for p in past) / sum(weight.values())
            e = max(share * total[day], least)
            if c > e:
                scored.append((-round(c * math.log(c / e) - (c - e), 6), term, c))
        out[day] = [(t, c, -s) for s, t, c in sorted(scored)[:k]]
    return {d: found for d, found in out.items() if found}


@pytest.mark.parametrize("k, decay, horizon", [(2, 0.8, 14), (5, 0.5, 3), (1, 1.0, 1)])
def test_bursts(spark, k, decay, horizon):
    rows = uses()
    frame = spark.createDataFrame([(d, [t]) for d, t in rows] + [(None, ["x"]), (START, None), (START, [None])], "day date, terms array<string>")
    found = bursts.bursts(bursts.daily_counts(frame, F.col("day"), F.col("terms")), k, decay, horizon)
    got = defaultdict(list)
    for r in found.orderBy("day", "rank").collect():
        got[r.day].append((r.term, r.n, r.score))
    want = plain(rows, k, decay, horizon, 0.5)
    assert set(got) == set(want)
    for day in want:
        assert [x[:2] for x in got[day]] == [x[:2] for x in want[day]]
        assert [x[2] for x in got[day]] == pytest.approx([x[2] for x in want[day]], abs=2e-6)


def test_no_counts(spark):
    assert bursts.bursts(spark.createDataFrame([], "day date, term string, n long"), 3).count() == 0


def test_combined_sketches_keep_their_bound(spark):
    rng = np.random.default_rng(1)
    rows = [("a", f"t{int(x)}") for x in rng.zipf(1.3, 20_000) % 5000] + [("a", "hot")] * 9000 + [("b", "one"), ("b", None)]
    frame = spark.createDataFrame(rows, "day string, term string")
    # Five batches, each with sketches of its own.
    batches = [bursts.sketches(part, ["day"], "term", 256) for part in frame.randomSplit([1.0] * 5, seed=3)]
    whole = batches[0]
    for other in batches[1:]:
        whole = whole.unionByName(other)
    true = Counter(rows)
    got = bursts.top_of_sketches(whole, ["day"], 5, 256).collect()
    assert {r.term for r in got if r.day == "b"} == {"one"}
    top = [r for r in got if r.day == "a"]
    assert len(top) == 5 and top[0].error > 0
    for r in top:
        assert abs(r["count"] - true[("a", r.term)]) <= r.error
    missed = max(c for (day, t), c in true.items() if day == "a" and t not in {r.term for r in top})
    assert missed <= min(true[("a", r.term)] for r in top) + 2 * top[0].error
