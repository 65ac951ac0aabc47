"""Quality classifier: histogram boosted trees over document statistics, scored by flat arrays."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.boosting import Forest, fit_forest
from tideline.llm.common import crc_fold
from tideline.llm.samples import MAX_TRAIN, labelled_sample
from tideline.llm.toxicity import score_documents

THRESHOLD = 0.3
HELD_MOD, HELD_REST = 5, 0
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTERS = re.compile(r"[^\W\d_]+")
STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "short_words", "kinds", "commonest", "pairs_again",
    "lines", "words_a_line", "lines_again", "longest_line", "symbols", "symbol_words", "bars", "digits", "capitals",
    "letters", "letter_words", "marks", "ended_lines", "not_ascii", "spaces", "dots",
)


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all are finite, also for an empty one."""
    words = _WORD.findall(text)
    n, chars = max(1, len(words)), max(1, len(text))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    line_count = max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    letters = sum(map(len, _LETTERS.findall(text)))
    tally = {c: text.count(c) for c in "#*$%&|<>.,;:!?"}
    symbols = sum(tally[c] for c in "#*$%&|<>")
    digits = sum(map(len, re.findall("[0-9]+", text)))
    capitals = sum(map(len, re.findall("[A-Z]+", text)))
    ascii_only = len(text.encode("ascii", "ignore"))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), np.log1p(lengths.max()), (lengths <= 3).mean(),
        len(counts) / n, max(counts.values(), default=0) / n, 1 - len(pairs) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.log1p(len(lines)), np.log1p(len(words) / line_count), 1 - len(set(lines)) / line_count if lines else 0.0,
        np.log1p(max(map(len, lines), default=0)), 100 * symbols / chars,
        sum(c for w, c in counts.items() if not w.isalnum() and not w.strip(".,;:!?\"'()").isalnum()) / n,
        tally["|"] / n, digits / chars, capitals / max(1, letters), letters / chars,
        sum(c for w, c in counts.items() if w[0].isalpha()) / n, (sum(tally.values()) - symbols) / n,
        sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines) / line_count, (len(text) - ascii_only) / chars,
        text.count(" ") / chars, tally["."] / n,
    ]


@dataclass
class QualityModel:
    forest: Forest

    def scorer(self):
        def score(texts: list[str]) -> np.ndarray:
            x = np.array([statistics(t) for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))
            return self.forest.score(x)

        return score


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> QualityModel:
    """Fitted on at most ``max_train`` labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", crc_fold("doc_id", HELD_MOD) != HELD_REST, max_train)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in batch["text"]], "y": batch["y"]})

    rows = sample.select("text", "y").mapInPandas(work, "x array<double>, y int").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    return QualityModel(fit_forest(x, rows["y"].to_numpy(np.float64)))


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; see ``score_documents``."""
    return score_documents(docs, fit_quality(docs, labels, max_train), (HELD_MOD, HELD_REST), THRESHOLD)


def good_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model accepts, all columns as they are."""

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scorer()(texts.fillna("").tolist()) >= threshold)

    return docs.filter(accepted(F.col("text")))
