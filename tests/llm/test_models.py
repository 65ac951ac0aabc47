import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, labels_frame, values
from tideline.llm import quality, rules, toxicity
from tideline.llm.boosting import fit_forest, fit_isotonic
from tideline.llm.common import table
from tideline.llm.samples import labelled_sample

BIG = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_forest_learns_and_survives_odd_input():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = fit_forest(x[:2000], y[:2000])
    assert auc(forest.score(x[2000:]), y[2000:]) > 0.98
    assert np.allclose(fit_forest(x, np.ones(len(x))).score(x), (len(x) + 1) / (len(x) + 2))
    assert np.allclose(fit_forest(np.empty((0, 4)), np.empty(0)).score(x), 0.5)
    assert np.isfinite(fit_forest(np.zeros((50, 4)), np.arange(50) % 2.0).score(x)).all()


def test_flat_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 5))
    forest = fit_forest(x, (x.sum(1) > 0).astype(float), trees=7, depth=3)
    for row, got in zip(x[:50], forest.margin(x[:50])):
        total = forest.base
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            while node < 7:
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - 7]
        assert abs(total - got) < 1e-12


def test_isotonic_rises():
    rng = np.random.default_rng(2)
    score = rng.random(500)
    curve = fit_isotonic(score, (rng.random(500) < score).astype(float))
    out = curve(np.linspace(-1, 2, 200))
    assert (np.diff(out) >= 0).all() and out.min() >= 0 and out.max() <= 1
    assert np.allclose(fit_isotonic(score, np.ones(500))(score), score)
    assert len(fit_isotonic(np.empty(0), np.empty(0))(score)) == 500


def held_out(df, label, mod, rest):
    labels = table(df.sparkSession, BIG, "labels").select("doc_id", label)
    rows = df.join(labels, "doc_id").toPandas()
    assert (rows["held_out"] == [zlib.crc32(str(d).encode()) % mod == rest for d in rows["doc_id"]]).all()
    rows = rows[rows["held_out"]]
    return rows["score"].to_numpy(), rows[label].to_numpy(), rows["predicted"].to_numpy()


def test_toxicity_on_held_out_rows(spark):
    scored = toxicity.toxicity(table(spark, BIG, "documents"), table(spark, BIG, "labels")).cache()
    assert scored.count() == 10_000
    score, y, predicted = held_out(scored, "toxic", 4, 2)
    assert auc(score, y) > 0.95 and (predicted == (score >= 0.3)).all()
    assert predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.03


def test_quality_on_held_out_rows(spark):
    scored = quality.quality(table(spark, BIG, "documents"), table(spark, BIG, "labels")).cache()
    assert scored.count() == 10_000
    score, y, predicted = held_out(scored, "quality", 5, 0)
    assert auc(score, y) > 0.9 and (predicted == (score >= 0.3)).all()
    assert predicted[y == 1].mean() > 0.97


def test_scores_of_edge_rows(spark):
    some = labels_frame(spark, [(i, i % 2, int(i % 3 == 0), "x") for i in range(12)] + [(None, 1, 1, "x"), (1, None, None, "x"), (1, 0, 1, "y")])
    for fit in (toxicity.toxicity, quality.quality):
        for labels in (some, labels_frame(spark)):
            rows = fit(docs_frame(spark), labels).collect()
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(d) for d, _ in DOCS)
            assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in rows)
            assert fit(docs_frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("toxic", [0, 2, 4, 8])
def test_few_toxic_labels_over_many_tasks(spark, toxic):
    rows = [(i, f"plain words number {i} here" if i >= toxic else f"you zork idiot number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < toxic)) for i in range(60)], "doc_id long, quality int, toxic int").repartition(16)
    scored = toxicity.toxicity(docs, labels).collect()
    assert len(scored) == 60 and all(0 <= r.score <= 1 for r in scored)


@pytest.mark.parametrize("fit", [toxicity.toxicity, quality.quality])
def test_smallest_table(spark, fit):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    rows = fit(docs, labels).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())


def test_copies_that_disagree_are_one_row_whatever_the_order(spark):
    rows = [(2 * i + b, f"text {i}", b) for i in range(100) for b in (0, 1)]
    got = []
    for order in (1, -1):
        docs = spark.createDataFrame([r[:2] for r in rows[::order]], "doc_id long, text string")
        labels = spark.createDataFrame([(r[0], r[2]) for r in rows[::order]], "doc_id long, toxic int")
        got.append(sorted(map(tuple, labelled_sample(docs, labels, "toxic").collect())))
    assert got[0] == got[1] and len(got[0]) > 50
    both = labelled_sample(spark.createDataFrame([(1, "t"), (2, "t")], "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"), "toxic")
    assert [r.y for r in both.collect()] == [1]


def plain_statistics(text):
    """The document statistics, character by character and word by word."""
    words, now = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [now] if now else []
            now = ""
        else:
            now += c
    n, chars = max(1, len(words)), max(1, len(text))
    sizes = [len(w) for w in words] or [0]
    lines = [x for x in text.split("\n") if not all(c.isspace() for c in x)]
    n_lines = max(1, len(lines))
    letter = [bool(re.match(r"[^\W\d_]", c)) for c in text]
    symbols, marks = "#*$%&|<>", ".,;:!?"
    bare = [w.strip(".,;:!?\"'()") for w in words]
    return [
        np.log(1 + len(text)), np.log(1 + len(words)), sum(sizes) / len(sizes), np.log(1 + max(sizes)), sum(s <= 3 for s in sizes) / len(sizes),
        len(set(words)) / n, max([words.count(w) for w in set(words)], default=0) / n,
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.log(1 + len(lines)), np.log(1 + len(words) / n_lines), 1 - len(set(lines)) / n_lines if lines else 0.0,
        np.log(1 + max([len(x) for x in lines], default=0)), 100 * sum(c in symbols for c in text) / chars,
        sum(not w.isalnum() and not b.isalnum() for w, b in zip(words, bare)) / n, sum(c == "|" for c in text) / n,
        sum("0" <= c <= "9" for c in text) / chars, sum("A" <= c <= "Z" for c in text) / max(1, sum(letter)), sum(letter) / chars,
        sum(w[0].isalpha() for w in words) / n, sum(c in marks for c in text) / n,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / n_lines, sum(ord(c) > 127 for c in text) / chars,
        sum(c == " " for c in text) / chars, sum(c == "." for c in text) / n,
    ]


def test_quality_statistics_by_brute_force(spark):
    texts = [t or "" for d, t in DOCS if d != 7] + [r.text for r in table(spark, SMALL, "documents").collect() if len(r.text) < 3000]
    assert np.allclose([quality.statistics(t) for t in texts], [plain_statistics(t) for t in texts], atol=1e-9)


def plain_toxicity(text, lexicon):
    """The features, worked out word by word."""
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
    weight = {w: max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k] + "*", 0.0) for k in range(3, 8) if k < len(w)]) for w in words}
    bad = [i for i, w in enumerate(words) if weight[w] > 0 or w in toxicity.INSULTS]
    you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = {w for w in words if weight[w] > 0}
    odd = re.findall(r"[^\W\d_]+[@$!0134*#.\-]+[^\W\d_]+(?:[@$!0134*#]+[^\W\d_]*)*", text)
    plain = ["".join(c for c in x.lower().translate(toxicity.LEET) if c.isalnum()) for x in odd]
    return [
        np.log(1 + len(words)), 100 * sum(w in toxicity.INSULTS for w in words) / n, 100 * sum(weight[w] for w in words) / n,
        np.log(1 + sum(weight[w] > 0 for w in words)), np.log(1 + len(kinds)), max([weight[w] for w in words], default=0.0),
        100 * sum(any(abs(i - j) <= 5 for j in you) for i in bad) / n, 100 * len(you) / n,
        sum("A" <= c <= "Z" for c in text) / chars, sum(len(x) >= 3 for x in re.findall(r"(?<!\w)[A-Z]+(?!\w)", text)) / n,
        100 * text.count("!") / chars, 100 * text.count("?") / chars, 100 * sum(c in "#$%&*|<>@" for c in text) / chars,
        len(odd) / n, np.log(1 + sum(p in toxicity.INSULTS or p in lexicon for p in plain)),
        len(re.findall(r"([^\W\d_])\1\1", text)) / n, len(kinds) / max(1, len(set(words))),
    ]


def test_toxicity_features_by_brute_force(spark):
    lexicon = {"zork": 2.0, "blah*": 1.5, "idi*": 1.0}
    texts = [t or "" for d, t in DOCS if d != 7] + [r.text for r in table(spark, SMALL, "documents").collect() if len(r.text) < 20_000]
    texts += ["You zork! BLAHBLAH sooo id!ot, st.upid you", "far " * 20 + "zork"]
    got = toxicity.Features(lexicon).matrix(texts)
    assert np.allclose(got, [plain_toxicity(t, lexicon) for t in texts], atol=1e-9)


def test_learned_terms(spark):
    rows = [(f"some text {i} " + ("zork{0} blah".format("abcdefgh"[i % 8]) if i % 3 == 0 else "fine blah"), int(i % 3 == 0), 0) for i in range(300)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int, part int"))
    assert "zork*" in lexicon and not {"blah", "text", "fine"} & lexicon.keys()


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n")]
    again = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(hit)


def test_base_counts(spark):
    sample = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    for rows in (sample, [d for d in DOCS if d[0] != 7]):
        want = []
        for doc_id, text in rows:
            c = plain_counts(text or "")
            want.append((doc_id, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
        got = rules.apply_rules(docs_frame(spark, rows), [])
        assert values(got, "doc_id", *rules.COUNTS, "base_failed") == sorted(want, key=repr)
        assert got.filter("kept = base_failed").count() == 0


def test_learned_list_keeps_good_documents(spark):
    learned = rules.fit_rules(table(spark, BIG, "documents"), table(spark, BIG, "labels"))
    assert learned and all(1 <= len(rule) <= 3 for rule in learned)
    rows = rules.apply_rules(table(spark, BIG, "documents"), learned).join(table(spark, BIG, "labels"), "doc_id").filter(~F.col("base_failed"))
    kept = {r.quality: r.kept for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.5


def test_list_is_ordered_and_plain(spark):
    made = [(rules.Test("symbols per word", True, 0.5),), (rules.Test("words", True, 10.0), rules.Test("letters per word", False, 1.5))]
    rows = spark.createDataFrame([(20, 20, 0, 0, 0), (20, 90, 11, 0, 0), (20, 90, 0, 0, 0)], ", ".join(f"{c} long" for c in rules.COUNTS))
    assert [r[0] for r in rows.select(rules.verdict(made)).collect()] == [False, False, True]
    assert "CASE WHEN" in rows.select(rules.verdict(made))._jdf.queryExecution().analyzed().toString()


def test_no_labels_no_rules(spark):
    assert rules.fit_rules(docs_frame(spark), labels_frame(spark)) == []
    assert rules.quality_rules(docs_frame(spark, []), labels_frame(spark)).count() == 0


def test_filters_keep_rows_and_columns(spark):
    docs = docs_frame(spark)
    text = "A plain sentence with many different words " + " ".join(f"word{i}" for i in range(60))
    docs = docs.unionByName(docs_frame(spark, [(77, text)]))
    kept = rules.kept_documents(docs, [])
    assert kept.columns == docs.columns and 77 in [r.doc_id for r in kept.collect()]
    assert kept.filter("text is null or text = ''").count() == 0
    model = quality.fit_quality(docs, labels_frame(spark))
    assert quality.good_documents(docs, model).count() == docs.count()
    assert quality.good_documents(docs, model).columns == docs.columns
