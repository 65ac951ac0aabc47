"""Toxicity: boosted trees over dense lexical features, calibrated by isotonic regression.

A lexicon of insults is given; more terms (words and word beginnings) are learned from one part
of the labelled sample, the trees from another, the calibration from a third.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.boosting import Forest, Isotonic, fit_forest, fit_isotonic
from tideline.llm.common import crc_fold, text_of
from tideline.llm.samples import MAX_TRAIN, labelled_sample

THRESHOLD = 0.3
HELD_MOD, HELD_REST = 4, 2

# Fixed word lists.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb fool fools trash garbage scum loser losers pathetic "
    "worthless disgusting clown clowns ugly filthy vile imbecile cretin pig pigs rat vermin hate hateful kill die "
    "imbécile crétin stupide ordure idiote débile dumm dummkopf trottel abschaum widerlich idiota estúpido "
    "imbécil basura asqueroso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself ur u du dein deine dich dir sie ihr euch tu toi te ton ta tes vous votre vos "
    "usted ustedes ti tú vosotros".split()
)
# Signs written for letters.
LEET = str.maketrans("@4310$5!7", "aaeiossit")

_WORD = re.compile(r"[^\W\d_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+[@$!0134*#.\-]+[^\W\d_]+(?:[@$!0134*#]+[^\W\d_]*)*")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
PREFIXES = range(3, 8)
NEAR = 5
FEATURES = (
    "log_words", "insults", "weight", "log_hits", "log_kinds", "strongest", "near_you", "you", "capitals",
    "caps_words", "exclamations", "questions", "marks", "obfuscated", "hidden_insults", "stretched", "hit_share_of_kinds",
)


def terms(word: str) -> Iterator[str]:
    """A word and its beginnings; those end in ``*``."""
    yield word
    for n in PREFIXES:
        if n < len(word):
            yield word[:n] + "*"


class Features:
    """Dense features of whole texts under a lexicon of weighted terms."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The largest weight among a word's terms, 0 without any."""
        found = self.known.get(word)
        if found is None:
            found = max((self.lexicon.get(t, 0.0) for t in terms(word)), default=0.0)
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found
        return found

    def row(self, text: str) -> list[float]:
        words = _WORD.findall(text.lower())
        counts = Counter(words)
        n, chars = max(1, len(words)), max(1, len(text))
        weights = {w: x for w in counts if (x := self.weight(w)) > 0}
        hits = sum(counts[w] for w in weights)
        insults = sum(counts[w] for w in counts.keys() & INSULTS)
        near = 0
        if (weights or insults) and not SECOND_PERSON.isdisjoint(counts):
            you = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
            bad = np.array([i for i, w in enumerate(words) if w in weights or w in INSULTS])
            right = np.searchsorted(you, bad)
            gap = np.minimum(
                np.abs(you[np.minimum(right, len(you) - 1)] - bad), np.abs(you[np.maximum(right - 1, 0)] - bad)
            )
            near = int((gap <= NEAR).sum())
        odd = _OBFUSCATED.findall(text)
        plain = [re.sub(r"[^\w]|_", "", x.lower().translate(LEET)) for x in odd]
        hidden = sum(p in INSULTS or p in self.lexicon for p in plain)
        upper = sum(map(len, re.findall("[A-Z]+", text)))
        return [
            np.log1p(len(words)), 100 * insults / n, 100 * sum(counts[w] * x for w, x in weights.items()) / n,
            np.log1p(hits), np.log1p(len(weights)), max(weights.values(), default=0.0), 100 * near / n,
            100 * sum(counts[w] for w in counts.keys() & SECOND_PERSON) / n, upper / chars,
            len(_CAPS.findall(text)) / n, 100 * text.count("!") / chars, 100 * text.count("?") / chars,
            100 * sum(text.count(c) for c in "#$%&*|<>@") / chars, len(odd) / n, np.log1p(hidden),
            len(_STRETCHED.findall(text)) / n, len(weights) / max(1, len(counts)),
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    forest: Forest
    isotonic: Isotonic

    def scorer(self):
        features = Features(self.lexicon)
        return lambda texts: np.clip(self.isotonic(self.forest.score(features.matrix(texts))), 0.0, 1.0)


def _term_counts(sample: DataFrame, wanted: frozenset[str] | None = None) -> DataFrame:
    """(term, n): documents that have the term, summed up within tasks first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                own = {t for w in set(_WORD.findall(text.lower())) for t in terms(w)}
                found.update(own if wanted is None else own & wanted)
        # A frame without rows has no string column for Arrow, so a task that found nothing gives none.
        if found:
            yield pd.DataFrame({"term": list(found), "n": list(found.values())})

    return sample.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(sample: DataFrame, least_share: float = 0.01, least: int = 3, odds: float = 6.0) -> dict[str, float]:
    """Terms much commoner in toxic documents, with the logarithm of the odds' lower bound.

    A term must occur in ``least`` and ``least_share`` of the toxic documents, which bounds what
    reaches the driver by the toxic texts' mean number of terms over that share.
    """
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    floor = max(least, int(least_share * bad))
    seen = {r["term"]: r["n"] for r in _term_counts(sample.filter("y = 1")).filter(F.col("n") >= floor).collect()}
    wanted = frozenset(seen)
    clean = {r["term"]: r["n"] for r in _term_counts(sample.filter("y = 0"), wanted).collect()}
    lexicon = {}
    for term, n in seen.items():
        m = clean.get(term, 0)
        ratio = np.log((n + 0.5) / (bad + 1)) - np.log((m + 0.5) / (good + 1))
        bound = ratio - 1.64 * np.sqrt(1 / (n + 0.5) + 1 / (m + 0.5) * (m > 0))
        if bound > np.log(odds) and m * bad * 4 < n * good:
            lexicon[term] = float(bound)
    return lexicon


def _features_of(sample: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": list(features.matrix(batch["text"].tolist())), "y": batch["y"], "part": batch["part"]})

    rows = sample.mapInPandas(work, "x array<double>, y int, part int").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return x, rows["y"].to_numpy(np.float64), rows["part"].to_numpy()


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    """Fitted on at most ``max_train`` labelled rows outside the held-out fold: five tenths of
    them for the lexicon, three for the trees, two for the calibration."""
    sample = labelled_sample(docs, labels, "toxic", crc_fold("doc_id", HELD_MOD) != HELD_REST, max_train)
    lexicon = learn_lexicon(sample.filter("part < 5"))
    x, y, part = _features_of(sample.filter("part >= 5"), Features(lexicon))
    forest = fit_forest(x[part < 8], y[part < 8], trees=60, depth=3)
    return ToxicityModel(lexicon, forest, fit_isotonic(forest.score(x[part >= 8]), y[part >= 8]))


def score_documents(docs: DataFrame, model, held: tuple[int, int], threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row, from the text alone; a null text is empty.

    A null doc_id is not held out. Repeated rows are scored alike; no rows give none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = model.scorer()
        for batch in batches:
            found = score(batch["text"].tolist())
            batch["score"], batch["predicted"] = found, (found >= threshold).astype(np.int32)
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch.drop(columns="text")

    held_out = F.coalesce(crc_fold("doc_id", held[0]) == held[1], F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, text_of().alias("text"))
    return rows.mapInPandas(work, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return score_documents(docs, fit_toxicity(docs, labels, max_train), (HELD_MOD, HELD_REST))
