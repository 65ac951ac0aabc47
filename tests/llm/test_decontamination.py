import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.cases import DOCS, docs_frame, values
from tideline.llm import decontamination
from tideline.llm.common import table


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def by_brute_force(docs, items, window=10):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in sizes:
            for i in range(len(words) - n + 1):
                if (owners := windows.get(tuple(words[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= owners
        out.append((doc_id, len(words), len(hit), len(found), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def items_frame(spark, rows):
    df = spark.createDataFrame(list(rows), "item_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("win", "item", "words", "key", "doc_id", "n")})


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items", "contaminated")


@pytest.mark.parametrize("window, shingle", [(10, 5), (4, 2), (3, 5), (1, 1)])
def test_odd_items_and_documents(spark, window, shingle):
    rng = random.Random(window)
    letters = "a b c A é Σ 1".split()
    docs = [d for d in DOCS if d[0] != 7] + [(100 + i, rng.choice([" ", ", ", "\n"]).join(rng.choice(letters) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    items = [(1, "a a a a a a a a a a a"), (2, None), (3, ""), (4, "?!"), (None, "b c A"), (5, "The quick brown fox jumps over the lazy dog"), (10, "idiot"), (2, "b c a")]
    items += [(20 + i, " ".join(rng.choice(letters) for _ in range(rng.randint(1, 15)))) for i in range(40)]
    got = decontamination.decontaminate(docs_frame(spark, docs), items_frame(spark, items), window, shingle)
    assert values(got, *COLUMNS) == by_brute_force(docs, items, window)


def test_table_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    got = decontamination.decontaminate(table(spark, SMALL, "documents"), table(spark, SMALL, "benchmark"))
    want = by_brute_force(docs, items)
    assert values(got, *COLUMNS) == want and any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_long_text_full_of_one_passage(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = [(1, (passage + ". ") * 2000), (2, passage[:-4]), (3, passage.upper())]
    got = decontamination.decontaminate(docs_frame(spark, docs), items_frame(spark, [(9, passage)]))
    assert values(got, *COLUMNS) == by_brute_force(docs, [(9, passage)])


def test_nothing_to_compare(spark):
    docs, none = docs_frame(spark), items_frame(spark, [])
    assert decontamination.decontaminate(docs_frame(spark, []), items_frame(spark, [(1, "a b")])).count() == 0
    rows = decontamination.decontaminate(docs, none).collect()
    assert len(rows) == len(DOCS) and not any(r.contaminated or r.n_hit or r.items for r in rows)


def test_the_rarest_shingle_is_the_necessary_one(spark):
    common, rare = "a b c d e", "f g h i j"
    docs = docs_frame(spark, [(i, common) for i in range(30)] + [(100, f"{common} {rare}")])
    parts, _ = decontamination.item_windows(items_frame(spark, [(1, f"{common} {rare}")]))
    scanned = decontamination.occurrences(docs, parts)
    assert scanned.filter("size(found) > 0").count() == 31
    found = decontamination.contained_windows(scanned, parts)
    assert [(r.start, r.n) for r in found.collect()] == [(0, 10)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
