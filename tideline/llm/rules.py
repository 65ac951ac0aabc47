"""Quality rules: fixed base rules, then a decision list learned by sequential covering.

Statistics are counted per whole text; the list is a plain Spark conditional expression over them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import WORD, text_of
from tideline.llm.samples import MAX_TRAIN, labelled_sample

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str) -> tuple[int, ...]:
    """The base counts of a whole text, in the order of ``COUNTS``."""
    words = _WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif _WORD.search(line):
            seen.add(line)
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0  # words before it are counted
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + WINDOW - max(end, i)
                end = i + WINDOW
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), again, repeated


def with_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, counts) per row; a null text has no words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([counts(t) for t in batch["text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="text").assign(**dict(zip(COUNTS, found.T)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInPandas(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# The measures a rule may test: name, Spark expression over the counts.
MEASURES = {
    "symbols per 100 letters": "100D * n_symbols / greatest(word_chars, 1)",
    "symbols per word": "1D * n_symbols / greatest(n_words, 1)",
    "letters per word": "1D * word_chars / greatest(n_words, 1)",
    "repeated words in 100": "100D * n_repeat_words / greatest(n_words, 1)",
    "repeated lines per 100 words": "100D * n_dup_lines / greatest(n_words, 1)",
    "words": "1D * n_words",
}


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        values = x[:, names.index(self.measure)]
        return values > self.threshold if self.above else values <= self.threshold

    def sql(self) -> str:
        return f"{MEASURES[self.measure]} {'>' if self.above else '<='} {self.threshold!r}D"

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Test, ...]


def covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for test in rule:
        hit &= test.holds(x, names)
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> Rule:
    """Tests are added by FOIL's gain until no good document is covered."""
    rule: list[Test] = []
    hit = np.ones(len(x), dtype=bool)
    while len(rule) < longest and (bad[hit] == 0).any() and bad[hit].any():
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            values = x[hit, j]
            cuts = np.unique(np.quantile(values, np.arange(1, 100) / 100))
            # Midpoints between neighbouring values, rounded, read better than the values.
            for cut in np.unique([float(f"{c:.4g}") for c in (cuts[1:] + cuts[:-1]) / 2]):
                for above in (True, False):
                    own = values > cut if above else values <= cut
                    p1, n1 = (bad[hit] & own).sum(), (~bad[hit] & own).sum()
                    if p1:
                        new = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if new > gain:
                            best, gain = Test(name, above, float(cut)), new
        if best is None:
            break
        rule.append(best)
        hit &= best.holds(x, names)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The beginning of the rule that is worth most on documents it was not grown on."""

    def worth(k: int) -> float:
        hit = covers(rule[:k], x, names)
        p, n = bad[hit].sum(), (~bad[hit]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]


def learn_list(
    x: np.ndarray, bad: np.ndarray, grow: np.ndarray, names: list[str],
    precision: float = 0.97, least: int = 3, longest: int = 3, most: int = 8,
) -> list[Rule]:
    """Ordered rules that reject. A rule is kept if on the pruning rows at least ``precision`` of
    what it covers is bad; its documents then leave both parts, and the next one is grown."""
    rules: list[Rule] = []
    open_ = np.ones(len(x), dtype=bool)
    while len(rules) < most and bad[open_ & grow].sum() >= least:
        rule = _grow(x[open_ & grow], bad[open_ & grow], names, longest)
        if not rule:
            break
        rule = _prune(rule, x[open_ & ~grow], bad[open_ & ~grow], names)
        hit = covers(rule, x, names) & open_
        judged = bad[hit & ~grow]
        if len(judged) < least or judged.mean() < precision or bad[hit & grow].mean() < precision:
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> list[Rule]:
    """A decision list from at most ``max_train`` labelled documents that pass the base rules:
    two thirds of them to grow rules, one third to prune and judge them."""
    sample = labelled_sample(docs, labels, "quality", None, max_train)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([counts(t) for t in batch["text"]], dtype=np.int64).reshape(-1, len(COUNTS))
            yield pd.DataFrame({**dict(zip(COUNTS, found.T)), "y": batch["y"], "part": batch["part"]})

    counted = sample.mapInPandas(work, ", ".join(f"{c} long" for c in COUNTS) + ", y int, part int").filter(~base_failed())
    names = list(MEASURES)
    rows = counted.selectExpr(*(f"{sql} as `{name}`" for name, sql in MEASURES.items()), "y", "part").toPandas()
    x = rows[names].to_numpy(np.float64).reshape(-1, len(names))
    return learn_list(x, rows["y"].to_numpy() == 0, (rows["part"] % 3 != 0).to_numpy(), names)


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, else kept."""
    if not rules:
        return F.lit(True)
    cases = " ".join(f"WHEN {' AND '.join(f'({t.sql()})' for t in rule)} THEN false" for rule in rules)
    return F.expr(f"CASE {cases} ELSE true END")


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, counts, base_failed, kept) per row.

    A null or empty text has no words and fails. Repeated rows and null ids are judged like any.
    """
    judged = with_counts(docs).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def quality_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return apply_rules(docs, fit_rules(docs, labels, max_train))


def kept_documents(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` the rules keep, all columns as they are."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        found = np.array([counts(t) for t in texts.fillna("")], dtype=np.int64).reshape(-1, len(COUNTS))
        return pd.DataFrame(found, columns=list(COUNTS))

    # The list speaks of counts by name, and the input may have columns of those names.
    own = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_row"), counted(F.col("text")).alias("_counts"))
    flat = packed.select("_row", "_counts.*").filter(~base_failed() & verdict(rules))
    return flat.select(*(F.col("_row")[c].alias(c) for c in own))
