import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, values
from tideline.llm import simhash
from tideline.llm.common import table
from tideline.llm.components import connected


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words, now = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def by_brute_force(docs):
    fps = [plain_fingerprint(t or "") for _, t in docs]
    kinds = sorted(set(fps))
    edges = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if (a ^ b).bit_count() <= 2]
    root = components(kinds, edges)
    first = {}
    for (doc_id, _), fp in zip(docs, fps):
        ids = first.setdefault(root[fp], [])
        if doc_id is not None:
            ids.append(doc_id)
    return sorted(((d, f"{fp:016x}", min(first[root[fp]], default=None)) for (d, _), fp in zip(docs, fps)), key=repr)


def test_edges_of_the_input(spark):
    assert values(simhash.near_duplicates(docs_frame(spark)), "doc_id", "fingerprint", "component_id") == by_brute_force(DOCS)


def test_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = simhash.near_duplicates(table(spark, SMALL, "documents"))
    assert values(got, "doc_id", "fingerprint", "component_id") == by_brute_force(docs)


def signed(fp):
    return fp - (1 << 64) if fp >> 63 else fp


@pytest.mark.parametrize("bucket", [1, 4, 16, 1000])
def test_links_keep_components(spark, bucket):
    rng = random.Random(1)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            fps.add(fp)
            for bit in rng.sample(range(64), rng.randint(1, 3)):
                fp ^= 1 << bit
    # A crowd around one value: all its neighbours at one bit and some at two.
    crowd = rng.getrandbits(64)
    fps |= {crowd ^ (1 << i) for i in range(64)} | {crowd ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(i)}
    nodes = sorted(map(signed, fps))
    edges = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    frame = spark.createDataFrame([(n,) for n in nodes], "fp long")
    links = [tuple(r) for r in simhash.links(frame, bucket).collect()]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in links)
    assert components(nodes, links) == components(nodes, edges)


def test_connected(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(300)]
    loose = [(rng.randint(2000, 2400), rng.randint(2000, 2400)) for _ in range(250)] + [(5000, 5000)]
    edges = chain + star + loose
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    want = components({n for e in edges for n in e}, edges)
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each(spark):
    docs = docs_frame(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for _, _, c in by_brute_force(DOCS) if c is not None}
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted(want)
    lone = docs_frame(spark, [(None, "some words of no one"), (None, "some words of no one"), (None, "other words of someone else")])
    assert simhash.one_of_each(lone).count() == 2
    assert simhash.one_of_each(docs_frame(spark, [])).count() == 0


def test_one_id_with_texts_of_two_groups_stays_in_both(spark):
    one, two = "first text of it with words", "quite another thing that stands elsewhere"
    docs = docs_frame(spark, [(5, one), (5, two), (5, two), (6, one)])
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == sorted([one, two])


@pytest.mark.parametrize("names", [["_id", "_hash"], ["row", "text_hash", "text_check", "kept", "root", "fp"], ["a.b"]])
def test_one_of_each_takes_any_columns(spark, names):
    docs = spark.createDataFrame([(1, "a b c", *names), (2, "a b c", *names)], ["doc_id", "text", *names])
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c", *names)]


def test_other_distances_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs_frame(spark), max_bits=3)


def test_no_cross_join(spark):
    plan = simhash.links(spark.range(10).select(F.col("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
