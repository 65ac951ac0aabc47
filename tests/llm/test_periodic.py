import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, values
from tideline.llm import periodic
from tideline.llm.common import table


def plain_runs(words, least=6, exponent=4):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            smaller = any(all(words[k] == words[k + r] for k in range(i, j + q - r)) for r in range(1, q)) if j > i and length >= exponent * q else True
            if j > i and length >= max(least, exponent * q) and not smaller:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, most=60):
    kinds, words = rng.randint(1, 4), []
    while len(words) < rng.randint(0, most):
        if rng.random() < 0.4:
            piece = [rng.randrange(kinds) for _ in range(rng.randint(1, 5))]
            words += (piece * rng.randint(1, 8))[: rng.randint(1, 40)]
        else:
            words.append(rng.randrange(kinds))
    return words


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (3, 3), (1, 5)])
def test_runs_by_brute_force(least, exponent):
    rng = random.Random(least)
    for _ in range(700):
        words = made(rng)
        assert periodic.runs_of(words, least, exponent) == plain_runs(words, least, exponent), words


def test_suffix_tree_answers_by_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        words = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        tree, n = periodic.SuffixTree(words), len(words)
        assert tree.rank[:n].argsort().tolist() == sorted(range(n), key=lambda i: words[i:])
        pairs = [(i, j) for i in range(n) for j in range(n) if i != j]
        if pairs:
            got = tree.extension(*map(np.array, zip(*pairs)))
            for (i, j), e in zip(pairs, got):
                same = next((k for k in range(n) if max(i, j) + k >= n or words[i + k] != words[j + k]), n)
                assert e == same


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def digests(doc_id, words, runs):
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_planted_rows_by_brute_force(spark):
    rng = random.Random(9)
    rows = [d for d in DOCS if d[0] != 7]
    rows += [(1000 + i, rng.choice([" ", "\n", "\t "]).join("abcdé世"[k] for k in made(rng, 90))) for i in range(400)]
    got = periodic.periodic_runs(periodic.with_repeats(docs_frame(spark, rows)))
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        want.append(digests(doc_id, words, plain_runs(words)))
    assert values(got, *COLUMNS) == sorted(want, key=repr)


def test_table_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = {r.doc_id: tuple(r) for r in periodic.periodic_runs(periodic.with_repeats(table(spark, SMALL, "documents"))).select(*COLUMNS).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        words = planted(doc_id, text)
        if len(words) < 1500:
            assert got[doc_id] == digests(doc_id, words, plain_runs(words))


def test_long_text_and_kept_runs(spark):
    rows = periodic.periodic_runs(docs_frame(spark), keep_text=True).collect()
    assert len(rows) == len(DOCS)
    long = next(r for r in rows if r.doc_id == 7)
    assert [tuple(r) for r in long.runs] == [(0, 120_000, 3)] and long.collapsed == "Word after word,"
    assert next(r for r in rows if r.doc_id == 9).collapsed == "a"
    assert periodic.periodic_runs(docs_frame(spark, [])).count() == 0


def test_stretches_hold_all_runs():
    rng = random.Random(11)
    for _ in range(300):
        words = np.array(made(rng) + [rng.randrange(2, 30) for _ in range(20)] + made(rng))
        parts = list(periodic.stretches(words))
        assert all(any(a <= s and s + n <= b for a, b in parts) for s, n, _ in plain_runs(words.tolist()))
