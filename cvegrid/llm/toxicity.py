"""Toxic passages: maximal-scoring segments over words' log-odds, judged by extreme-value statistics.

A word's score is its log-odds of standing in toxic against clean documents, with a Dirichlet prior from all documents,
and zero where its counts may be chance by a likelihood ratio; a small drift makes ordinary text score below zero. One linear scan finds all
maximal-scoring segments of a text. A segment's score is measured against what chance makes of a clean text as long,
and the best one of a text, so standardized, gives the text's probability.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import Memo, session, stored, words, worker_state

#: Bound of the labelled sample, documents of each label.
SAMPLE = 10_000
#: Documents' worth of the prior; least evidence that counts, in standard errors, and least log-odds; score of every word
#: besides.
PRIOR, ERRORS, LEAST, DRIFT = 20.0, 3.5, 2.0, 0.25
#: Weight of clean against toxic documents in the calibration.
CLEAN = 4.0
#: Segments expected by chance in a text, under which a segment is significant.
SIGNIFICANT = 0.05
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters(word: bytes) -> bytes:
    """What counts as the word: its letters, lowered; empty if there are none."""
    found = _NO_LETTER.sub("", word.decode("utf-8", "surrogatepass").lower()).encode("utf-8", "surrogatepass")
    return word if found == word else found


def _letters() -> Memo:
    return worker_state(("toxicity",), lambda: Memo(letters))


def distinct(text: str) -> set[bytes]:
    """The words of a text."""
    found = set(map(_letters().__getitem__, words(text)))
    found.discard(b"")
    return found


def segments(scores: np.ndarray, positive: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, as (first, end, score): Ruzzo and Tompa's scan.

    ``positive`` are the places of scores above zero; what lies between is summed up.
    """
    if not len(positive):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    held: list[list] = []  # first, end, sum before, sum after
    for at in positive.tolist():
        new = [at, at + 1, float(total[at]), float(total[at + 1])]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= new[2]:
                j -= 1
            if j < 0 or held[j][3] >= new[3]:
                held.append(new)
                break
            new = [held[j][0], new[1], held[j][2], new[3]]
            del held[j:]
    return [(a, b, after - before) for a, b, before, after in held]


@dataclass
class Model:
    scores: dict[bytes, float]  # of the words that have one
    rate: float  # of the extreme-value distribution
    places: float  # chance segments start in so many of a text's words
    slope: float
    offset: float
    name: str = field(default_factory=lambda: uuid.uuid4().hex)  # of the scores

    def word_score(self, word: bytes) -> float:
        return self.scores.get(letters(word), 0.0)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        known, found = worker_state(("toxicity", self.name), lambda: Memo(self.word_score)), words(text)
        score = np.fromiter(map(known.__getitem__, found), np.float64, len(found)) - DRIFT
        return len(score), segments(score, np.flatnonzero(score > 0))

    def evidence(self, n: int, best: float) -> float:
        """Minus the logarithm of the chance that a clean text of ``n`` words has a segment as good as its ``best``."""
        if best <= 0:
            return 0.0
        expected = self.places * n * np.exp(-min(self.rate * best, 600.0))
        return float(min(-np.log(-np.expm1(-expected)), 40.0))

    def probability(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.slope * evidence + self.offset))))

    def score(self, n: int, found: list) -> float:
        return self.probability(self.evidence(n, max((s for _, _, s in found), default=0.0)))

    def passages(self, n: int, found: list) -> list[dict]:
        """The significant segments: words ``first`` to ``end`` (exclusive), and how many such chance makes."""
        out = []
        for a, b, s in found:
            expected = float(self.places * n * np.exp(-self.rate * s))
            if expected < SIGNIFICANT:
                out.append({"first": a, "end": b, "score": float(s), "expected": expected})
        return out


def likelihood_ratio(toxic: np.ndarray, clean: np.ndarray, documents: tuple[int, int]) -> np.ndarray:
    """Twice the log-likelihood ratio of counts in toxic and clean documents against one rate in both."""
    t, c = (max(x, 1) for x in documents)
    both = np.maximum(toxic + clean, 1)
    return 2 * sum(
        n * np.log(np.where(n > 0, n, 1) * (t + c) / (both * size)) * (n > 0) for n, size in ((toxic, t), (clean, c)))


def least_evidence(n_words: int) -> float:
    """What must be exceeded: ``ERRORS`` standard errors, and what the best of so many words reaches by chance."""
    return max(ERRORS**2, 2 * np.log(max(n_words, 1)))


def log_odds(everything: np.ndarray, toxic: np.ndarray, clean: np.ndarray, documents: tuple[int, int, int]) -> np.ndarray:
    """Log-odds with the corpus as Dirichlet prior; zero where they are small.

    The prior has one more occurrence of each word, dealt to the classes by their sizes: however rare a word is, few
    occurrences in one class and none in the other do not give it the score of many.
    """
    n, t, c = (max(x, 1) for x in documents)
    prior = PRIOR * (everything + 0.01) / n
    odds = np.log((toxic + prior + t / (t + c)) / (t + PRIOR)) - np.log((clean + prior + c / (t + c)) / (c + PRIOR))
    return np.where(np.abs(odds) > LEAST, odds, 0.0)


def extreme_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(rate * score)] = 1 over a clean text's words."""
    low, high = 1e-3, 1e-3
    grows = lambda rate: float(shares @ np.exp(np.minimum(rate * scores, 700.0))) > 1
    while not grows(high) and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if grows(middle) else (middle, high)
    return high


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset by damped Newton steps, held by a weak prior, label 0 weighing ``CLEAN`` times label 1."""
    if len(x) == 0 or y.min() == y.max():
        return 1.0, -3.0
    weight = np.where(y == 1, 1 / y.mean(), CLEAN / (1 - y.mean())) / (CLEAN + 1)
    design, prior = np.stack([x, np.ones_like(x)], 1), np.array([1.0, -3.0])

    def loss(beta: np.ndarray) -> float:
        return float(weight @ np.logaddexp(0, -(2 * y - 1) * (design @ beta)) + ((beta - prior) ** 2).sum() / 2)

    beta = prior
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - (beta - prior)
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.eye(2)
        step = np.linalg.solve(curve, slope)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
    return max(float(beta[0]), 0.0), float(beta[1])


def _word_counts(sample: DataFrame) -> DataFrame:
    """``(word, toxic, clean)``: labelled documents of each kind that hold the word."""

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for label, text in zip(batch["label"], batch["text"]):
                totals[label].update(distinct(text))
            for label, total in totals.items():
                n = np.fromiter(total.values(), np.int64, len(total))
                yield pd.DataFrame({"word": list(total), "toxic": n * label, "clean": n * (1 - label)})

    return (
        sample.select("label", "text").mapInPandas(add_up, "word binary, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def _everywhere(texts: DataFrame, wanted: list[bytes]) -> tuple[np.ndarray, int, int]:
    """Over all documents: how many hold each word, the words of all (each once a document), the number of documents."""
    shipped = texts.sparkSession.sparkContext.broadcast({word: i for i, word in enumerate(wanted)})

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = shipped.value
        total, size, n = np.zeros(len(number), np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                found = distinct(text)
                size, n = size + len(found), n + 1
                for word in number.keys() & found:
                    total[number[word]] += 1
        used = np.flatnonzero(total)
        yield pd.DataFrame({"word": [*used, -1, -2], "n": [*total[used], size, n]})

    rows = texts.select("text").mapInPandas(add_up, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {row["word"]: row["n"] for row in rows}
    return np.array([counts.get(i, 0) for i in range(len(wanted))], float), counts.get(-1, 0), counts.get(-2, 0)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> Model:
    """Log-odds and calibration from a bounded sample of labelled documents, with counts over all as prior.

    Words are counted each for itself. The sample says which ones have evidence; those are counted in all documents, and
    they alone are sent to tasks.

    ``usable`` is a condition on ``doc_id`` in ``labels``. Null ids and labels take no part; a document is toxic if any
    of its labels says so; copies of a text count once. Without labels of both kinds nothing scores.
    """
    session(docs.sparkSession)
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("hash", F.xxhash64("doc_id"))
    )
    chosen = known.where("label = 1").orderBy("hash", "doc_id").limit(rows).unionByName(
        known.where("label = 0").orderBy("hash", "doc_id").limit(rows))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = stored(
        texts.join(F.broadcast(chosen), "doc_id").groupBy(F.sha2("text", 256).alias("copy"), "label").agg(F.first("text").alias("text")),
        "toxicity",
    )
    held = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = held.get(1, 0), held.get(0, 0)
    counted = stored(_word_counts(sample), "words")
    whole = counted.agg(F.count("*").alias("words"), F.sum("clean").alias("clean")).first()
    least = least_evidence(whole["words"]) if n_toxic and n_clean else np.inf

    def certain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            toxic, clean = batch["toxic"].to_numpy(float), batch["clean"].to_numpy(float)
            yield batch[likelihood_ratio(toxic, clean, (n_toxic, n_clean)) > least]

    chosen_words = counted.mapInPandas(certain, counted.schema).orderBy("word").toPandas()
    toxic, clean = chosen_words["toxic"].to_numpy(float), chosen_words["clean"].to_numpy(float)
    everything, size, n = _everywhere(texts, chosen_words["word"].map(bytes).tolist())
    scores = log_odds(everything, toxic, clean, (n, n_toxic, n_clean))
    # by chance: the words of clean documents, and of all by the prior; the last place is for all words without score
    shares = np.append(clean + PRIOR * everything / max(n, 1), 0.0)
    shares[-1] = max((whole["clean"] or 0) + PRIOR * size / max(n, 1) - shares.sum(), 1e-9)
    by_word = {bytes(word): float(score) for word, score in zip(chosen_words["word"], scores) if score}
    model = Model(by_word, extreme_rate(np.append(scores, 0.0) - DRIFT, shares / shares.sum()), 1.0, 1.0, -3.0)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scans = [shipped.value.scan(t) for t in batch["text"]]
            yield pd.DataFrame({
                "label": batch["label"], "n": [n for n, _ in scans],
                "best": [max((s for _, _, s in found), default=0.0) for _, found in scans],
                "chance": [sum(s >= 2 / shipped.value.rate for _, _, s in found) for _, found in scans],
            })

    seen = sample.select("label", "text").mapInPandas(measured, "label int, n long, best double, chance long").toPandas()
    if len(seen):
        normal = seen[seen["label"] == 0]
        places = (1 + normal["chance"].sum()) / (max(normal["n"].sum(), 1) * np.exp(-2.0))
        model.places = float(np.clip(places, 1e-7, 1.0))
        evidence = [model.evidence(n, best) for n, best in zip(seen["n"], seen["best"])]
        model.slope, model.offset = logistic(np.array(evidence), seen["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into``: ``score`` (0 to 1) of each whole text, and its significant ``passages`` by word numbers.

    Null text counts as empty and scores like a text without toxic words. Rows are scored each for itself; other columns
    pass unchanged, one called ``into`` is replaced.
    """
    session(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("score double, passages array<struct<first:int,end:int,score:double,expected:double>>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for batch in batches:
            scans = [known.scan(t) for t in batch]
            yield pd.DataFrame({
                "score": [known.score(n, found) for n, found in scans],
                "passages": [known.passages(n, found) for n, found in scans],
            })

    return docs.withColumn(into, scored(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
