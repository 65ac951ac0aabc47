import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.cases import docs_frame
from tests.llm.test_models import plain_counts
from tests.llm.test_simhash import by_brute_force
from tests.llm.test_tokens import check_packed
from tideline.llm import quality, rules
from tideline.llm.common import table
from tools.check import TABLES, rows_of


def by_hand(spark, sf_dir):
    """The same stages over collected rows; only the fitted models are shared."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    learned = rules.fit_rules(docs, labels)
    names = list(rules.MEASURES)

    def keeps(text):
        c = plain_counts(text)
        n, letters, symbols, lines, repeated = c
        if n < 50 or 100 * repeated > 50 * n:
            return False
        seen = dict(zip(names, (100 * symbols / max(1, letters), symbols / n, letters / n, 100 * repeated / n, 100 * lines / n, n)))
        return not any(all((seen[t.measure] > t.threshold) == t.above for t in rule) for rule in learned)

    rows = [r for r in rows if keeps(r[1] or "")]
    score = quality.fit_quality(docs, labels).scorer()
    rows = [r for r, s in zip(rows, score([t or "" for _, t in rows])) if s >= 0.3]
    keep = {c for _, _, c in by_brute_force(rows)}
    return [r for r in rows if r[0] in keep]


def test_run_is_the_stages_by_hand(spark):
    got = corpus_pipeline.run(spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in by_hand(spark, SMALL)}
    sizes = {}
    for r in got:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == want
    check_packed(got, 2048)


@pytest.mark.parametrize("rows", [None, []])
def test_each_stage_takes_edge_rows(spark, rows):
    docs = docs_frame(spark) if rows is None else docs_frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= docs.count()


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash_dedup", "best_fit_packing"]
    assert "pipeline" in spark_entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in spark_entry.queries()}


@pytest.mark.parametrize("name", ["op1_chat_format", "op6_license_scan", "op11_decontamination", "op12_centroid_clusters"])
def test_sql_gives_the_same(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = spark_entry.queries()[name](spark, SMALL).toPandas()
    want = db.execute(spark_entry.oracle_sql()[name]).df()
    assert rows_of(got) == rows_of(want)
