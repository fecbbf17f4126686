"""Toxic passages as maximum-scoring segments of words.

* Words and word beginnings (4 to 6 letters) get log-odds of toxic against clean
  documents, with a Dirichlet prior proportional to their share in both.
* A word scores as its most specific known unit, less a drift, so that text
  without toxic words scores below zero on average.
* One linear scan finds all maximal segments with a positive score.
* Extreme-value statistics of such scans (score ``S`` in ``n`` words is expected
  ``K n exp(-lambda S)`` times by chance) decide which segments are significant,
  and the sum of their normalised scores is calibrated to a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import Memo, decode, slices, stored, text_bytes
from legajo.llm.fitting import fit_logistic, labelled_sample, logistic

LETTERS = regex.compile(r"[\p{L}\p{M}]+")
PREFIXES = (6, 5, 4)
#: What every word loses, so that chance segments stay short.
DRIFT = 1.0
#: Words whose score a task remembers; most words are rare, so more would save little.
MEMO = 50_000


def units(word: str) -> list[str]:
    """A word and its longer beginnings, most specific first."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    weights: dict[str, float]
    decay: float = 1.0
    scale: float = 0.1
    calibration: tuple[float, ...] = (1.0, 0.0)
    expected: float = 0.05  # chance segments per document that count as significant

    def word_score(self, token: str) -> float:
        """Score of a white-space token: its most toxic run of letters."""
        found = [
            next((self.weights[u] for u in units(word) if u in self.weights), 0.0)
            for word in LETTERS.findall(token)
        ]
        return max(found, default=0.0) - DRIFT

    def segments(self, scores: np.ndarray) -> list[tuple[int, int, float]]:
        """(first word, last word, normalised score) of every significant segment."""
        if not len(scores):
            return []
        chance = math.log(max(self.scale * len(scores), 1e-9))
        found = []
        for first, last, score in maximal_segments(scores):
            bits = self.decay * score - chance
            if bits > -math.log(self.expected):
                found.append((first, last, float(bits)))
        return found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return logistic(np.log1p(evidence)[:, None], np.asarray(self.calibration))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in one linear pass."""
    sums = np.cumsum(scores, dtype=np.float64)
    open_: list[list] = []  # first, last, sum before, sum behind, earlier segment starting lower
    for i in np.flatnonzero(scores > 0).tolist():
        first, before, behind = i, float(sums[i] - scores[i]), float(sums[i])
        at = len(open_) - 1
        while True:
            while at >= 0 and open_[at][2] >= before:
                at = open_[at][4]
            if at < 0 or open_[at][3] >= behind:
                open_.append([first, i, before, behind, at])
                break
            first, before = open_[at][0], open_[at][2]
            earlier = open_[at][4]
            del open_[at:]
            at = earlier
    return [(a, b, behind - before) for a, b, before, behind, _ in open_]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.memo = model, Memo(model.word_score, MEMO)

    def scores(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        return np.fromiter(map(self.memo.__getitem__, tokens), np.float64, len(tokens))


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, toxic, clean): documents of each class that hold the unit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 5_000):
            held = (Counter(), Counter())
            for label, data in zip(
                batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                words = set(LETTERS.findall(decode(data).lower()))
                held[label == 1].update({u for w in words for u in units(w)})
            names = list(held[0] | held[1])
            yield pa.RecordBatch.from_pydict(
                {
                    "unit": pa.array(names, pa.string()),
                    "toxic": pa.array([held[1][n] for n in names], pa.int64()),
                    "clean": pa.array([held[0][n] for n in names], pa.int64()),
                }
            )

    return (
        sample.mapInArrow(counted, "unit string, toxic bigint, clean bigint")
        .groupBy("unit")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    max_rows: int = 20_000,
    max_units: int = 50_000,
    folds: int = 5,
    held_out: int = 0,
    prior: float = 20.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold.

    The model holds the ``max_units`` units of the largest absolute z-score, so
    its size is bounded.  Without labelled rows, or with one class only, every
    document gets the share of toxic rows (0.5 without rows) as its score.
    """
    sample = stored(
        labelled_sample(
            docs, labels, label_col, max_rows, folds, held_out, id_col=id_col, text_col=text_col
        ),
        "toxicity-sample",
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n1 or not n0:
        share = 0.5 if n1 == n0 else min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6)
        return Model({}, calibration=(0.0, math.log(share / (1 - share))))
    a1 = F.lit(prior) * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    toxic, clean = F.col("toxic") + a1, F.col("clean") + a1
    # half a document more without the unit: it may be in all of a class
    delta = F.log(toxic / (n1 + prior - toxic + 0.5)) - F.log(clean / (n0 + prior - clean + 0.5))
    rows = (
        unit_counts(sample)
        .filter("toxic + clean >= 2")
        .select("unit", delta.alias("weight"), (delta / F.sqrt(1 / toxic + 1 / clean)).alias("z"))
        .orderBy(F.abs("z").desc(), "unit")
        .limit(max_units)
        .collect()
    )
    model = Model({r["unit"]: r["weight"] for r in rows if abs(r["z"]) >= 1.96})

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            out = []
            for data in batch.column("text").to_pylist():
                scores = scorer.scores(decode(data))
                found = [s for _, _, s in maximal_segments(scores)]
                whole = Counter(np.rint(scores).astype(int).tolist())
                out.append((len(scores), found, list(whole), list(whole.values())))
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch.column("label"),
                    "n": pa.array([o[0] for o in out], pa.int64()),
                    "found": pa.array([o[1] for o in out], pa.list_(pa.float64())),
                    "value": pa.array([o[2] for o in out], pa.list_(pa.int64())),
                    "times": pa.array([o[3] for o in out], pa.list_(pa.int64())),
                }
            )

    seen = stored(
        sample.select("label", "text").mapInArrow(
            scanned,
            "label int, n bigint, found array<double>, value array<bigint>, times array<bigint>",
        ),
        "toxicity-scans",
    )
    clean_rows = seen.filter("label <> 1")
    values = {
        r["value"]: r["times"]
        for r in clean_rows.select(F.explode(F.arrays_zip("value", "times")).alias("v"))
        .groupBy(F.col("v.value").alias("value"))
        .agg(F.sum("v.times").alias("times"))
        .collect()
    }
    model.decay = decay_rate(values)
    top = clean_rows.select(F.explode("found").alias("s")).filter("s >= 2").count()
    words = max(1, sum(values.values()))
    model.scale = (top + 0.5) / (words * math.exp(-2 * model.decay))
    evidence, label = [], []
    for r in seen.select("label", "n", "found").toLocalIterator():  # at most max_rows rows
        chance = math.log(max(model.scale * r["n"], 1e-9))
        bits = [model.decay * s - chance for s in r["found"]]
        evidence.append(sum(b for b in bits if b > -math.log(model.expected)))
        label.append(float(r["label"] == 1))
    x = np.log1p(np.asarray(evidence))[:, None]
    model.calibration = tuple(fit_logistic(x, np.asarray(label), ridge=0.1))
    return model


def decay_rate(values: dict[int, int]) -> float:
    """Lambda of the scores: the positive root of sum p(s) exp(lambda s) = 1.

    One occurrence is added to each whole score from 1 to 8, so that a root
    exists where clean text never scores above zero.
    """
    counts = Counter(values)
    counts.update(dict.fromkeys(range(1, 9), 1))
    s = np.asarray(list(counts), float)
    p = np.asarray(list(counts.values()), float)
    p /= p.sum()
    low, high = 1e-4, 5.0
    if (p * s).sum() >= 0:
        return 0.1
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(mid * s)).sum() > 1 else (mid, high)
    return low


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, score (0 to 1), passages.

    ``passages`` lists every significant segment as first and last word (counted
    from zero between white space) and normalised score.  Null and empty texts
    have none and get the score of a text without toxic words.  Null and repeated
    ids are scored row by row.  Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    passage = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            found = [
                model.segments(scorer.scores(decode(t))) for t in batch.column(1).to_pylist()
            ]
            evidence = np.asarray([sum(s for _, _, s in f) for f in found], float)
            rows = [[{"first": a, "last": b, "score": s} for a, b, s in f] for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(model.probability(evidence), pa.float64()),
                    pa.array(rows, pa.list_(passage)),
                ],
                names=["id", "score", "passages"],
            )

    return (
        docs.select(id_col, text_bytes(text_col).alias("text"))
        .mapInArrow(
            scored,
            f"id {id_type}, score double, "
            "passages array<struct<first:int,last:int,score:double>>",
        )
        .withColumnRenamed("id", id_col)
    )


def keep_clean(
    docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text"
) -> DataFrame:
    """The rows of docs that score below the threshold, all columns as they were."""
    place = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches):
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            sums = [sum(s for _, _, s in model.segments(scorer.scores(decode(t)))) for t in texts]
            yield batch.filter(pa.array(model.probability(np.asarray(sums, float)) < threshold))

    return docs.mapInArrow(clean, docs.schema)
