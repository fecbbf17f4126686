"""Language spans: scripts narrow the candidates, Viterbi labels the words.

Words score by letter trigrams and as a whole, per language.  The letters of a
word give its script; only languages that were seen in that script compete for
it.  Viterbi finds the labelling of all words of a document that scores best when
every change of language costs a penalty.  Documents of one batch run side by
side, so each step over the words is one array operation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legajo.llm.common import decode, fold, stored, text_bytes

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

# First and last code point of the ranges of the scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
OUTSIDE = -30.0  # what a word loses in a language never seen in its script


def script_of(word: str) -> str:
    point = ord(word[0])
    return next((name for name, low, high in SCRIPTS if low <= point <= high), "other")


def features(word: str) -> list[str]:
    """The word itself and its trigrams between borders."""
    edged = f"^{word}$"
    return [f"={word}", *(edged[i : i + 3] for i in range(len(edged) - 2))]


@dataclass
class Model:
    languages: list[str]
    features: dict[str, int]  # rows of the weights; unknown features have the last row
    weights: np.ndarray  # log-probability per feature and language
    scripts: dict[str, list[bool]] = field(default_factory=dict)
    penalty: float = 12.0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Scores of words, the best language of each at zero."""
        rows: list[int] = []
        starts, whole = [], []
        unknown = len(self.features)
        known = self.features.get
        for word in words:
            starts.append(len(rows))
            edged = f"^{word}$"
            rows.extend([known(edged[i : i + 3], unknown) for i in range(len(edged) - 2)])
            whole.append(known(f"={word}", -1))
        total = np.add.reduceat(self.weights[rows], starts, axis=0)
        place = np.asarray(whole)
        own = self.weights[place[place >= 0]]
        total[place >= 0] += own - own.mean(1, keepdims=True)
        allowed = {
            name: np.where(seen, 0.0, OUTSIDE) if any(seen) else 0.0
            for name, seen in self.scripts.items()
        }
        for i, name in enumerate(map(script_of, words)):
            if name in allowed:
                total[i] += allowed[name]
        return total - total.max(1, keepdims=True)


class WordTable:
    """Rows of scores and letter counts of white-space tokens, numbered as they come."""

    LIMIT = 500_000

    def __init__(self, model: Model):
        self.model = model
        self.empty()

    def empty(self) -> None:
        class Rows(dict):
            def __missing__(self, token):
                number = self[token] = len(self)
                return number

        self.rows = Rows()
        self.scores = np.empty((0, len(self.model.languages)), np.float32)
        self.letters = np.empty(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        tokens = text.lower().split()
        return np.fromiter(map(self.rows.__getitem__, tokens), np.int64, len(tokens))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores and letters of all tokens so far; a token without letters scores zero."""
        fresh = list(islice(self.rows, len(self.letters), None))
        found = [[t] if t.isalpha() else LETTERS.findall(t) for t in fresh]
        words = [w for f in found for w in f]
        counts = np.asarray([len(f) for f in found], np.int64)
        owner = np.repeat(np.arange(len(fresh)), counts)
        scores = np.zeros((len(fresh), len(self.model.languages)), np.float32)
        if words:
            np.add.at(scores, owner, self.model.word_scores(words).astype(np.float32))
        letters = np.bincount(owner, [len(w) for w in words], len(fresh)).astype(np.int64)
        self.scores = np.concatenate([self.scores, scores])
        self.letters = np.concatenate([self.letters, letters])
        return self.scores, self.letters


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word of documents side by side: (document, word)."""
    n, words, width = scores.shape
    order = np.argsort(-lengths, kind="stable")  # longest first: those still running are in front
    running = np.searchsorted(-lengths[order], -np.arange(words), side="left")
    steps = np.ascontiguousarray(scores[order].transpose(1, 0, 2))
    held = steps[0].copy()
    stay = np.ones((words, n, width), bool)
    best = np.zeros((words, n), np.int16)
    for t in range(1, words):
        a = running[t]
        front = held[:a]
        best[t, :a] = front.argmax(1)
        change = front.max(1, keepdims=True) - penalty
        np.greater_equal(front, change, out=stay[t, :a])
        np.maximum(front, change, out=front)
        front += steps[t, :a]
    labels = np.empty((words, n), np.int16)
    at, rows = held.argmax(1), np.arange(n)
    for t in range(words - 1, -1, -1):
        labels[t] = at
        if t:
            a = running[t]
            kept = stay[t, rows[:a], at[:a]]
            at[:a] = np.where(kept, at[:a], best[t, :a])
    out = np.empty((n, words), np.int16)
    out[order] = labels.T
    return out


def label_documents(
    numbers: list[np.ndarray], scores: np.ndarray, penalty: float, cells: int = 1 << 20
) -> list[np.ndarray]:
    """Labels of the words of each document; documents of like length run together."""
    out = [np.empty(0, np.int16)] * len(numbers)
    order = sorted((i for i in range(len(numbers)) if len(numbers[i])), key=lambda i: len(numbers[i]))
    while order:
        longest = len(numbers[order[-1]])
        take = max(1, cells // longest)
        group, order = order[-take:], order[:-take]
        lengths = np.asarray([len(numbers[i]) for i in group])
        padded = np.zeros((len(group), longest, scores.shape[1]), np.float32)
        for row, i in enumerate(group):
            padded[row, : len(numbers[i])] = scores[numbers[i]]
        labels = viterbi(padded, lengths, penalty)
        for row, i in enumerate(group):
            out[i] = labels[row, : len(numbers[i])]
    return out


def fit(
    docs: DataFrame,
    lang_col: str = "lang",
    max_rows: int = 3_000,
    max_features: int = 100_000,
    folds: int = 4,
    held_out: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from at most ``max_rows`` documents of each language outside the held-out fold.

    The documents are those with the smallest hash of the id; the model keeps the
    ``max_features`` most frequent features.  Rows without language are left
    out.  Without any row the model knows no language.
    """
    place = Window.partitionBy("lang").orderBy("hash", "id")
    known = docs.filter(F.col(lang_col).isNotNull() & (fold(id_col, folds) != held_out))
    chosen = (
        known.select(
            F.col(lang_col).cast("string").alias("lang"),
            F.col(id_col).alias("id"),
            F.xxhash64(id_col).alias("hash"),
        )
        .withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= max_rows)
        .select("lang", "id")
        .distinct()
    )
    sample = (
        known.select(
            F.col(lang_col).cast("string").alias("lang"),
            F.col(id_col).alias("id"),
            text_bytes(text_col).alias("text"),
        )
        # max_rows ids per language
        .join(F.broadcast(chosen), ["lang", "id"])
        .select("lang", "text")
    )

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            words: dict[str, Counter] = {}
            for lang, data in zip(
                batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                words.setdefault(lang, Counter()).update(LETTERS.findall(decode(data).lower()))
            for lang, held in words.items():
                for word, n in held.items():
                    counts[lang, f"script {script_of(word)}"] += n
                    for feature in features(word):
                        counts[lang, feature] += n
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([k[0] for k in counts], pa.string()),
                    "feature": pa.array([k[1] for k in counts], pa.string()),
                    "n": pa.array(list(counts.values()), pa.int64()),
                }
            )

    counts = stored(
        sample.mapInArrow(counted, "lang string, feature string, n bigint")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n")),
        "language-counts",
    )
    languages = sorted(r["lang"] for r in chosen.select("lang").distinct().collect())
    if not languages:
        return Model([], {}, np.zeros((1, 0)))
    at = {lang: i for i, lang in enumerate(languages)}
    is_script = F.col("feature").startswith("script ")
    scripts: dict[str, list[bool]] = {}
    for r in counts.filter(is_script).collect():  # scripts times languages
        seen = scripts.setdefault(r["feature"].removeprefix("script "), [False] * len(languages))
        seen[at[r["lang"]]] = r["n"] >= 5
    top = (
        counts.filter(~is_script)
        .groupBy("feature")
        .agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by"))
        .orderBy(F.desc("all"), "feature")
        .limit(max_features)
        .collect()
    )
    table = np.zeros((len(top), len(languages)))
    for row, r in enumerate(top):
        for lang, n in r["by"]:
            table[row, at[lang]] = n
    whole = np.asarray([r["feature"].startswith("=") for r in top], bool)
    weights = np.zeros((len(top) + 1, len(languages)))
    for kind in (whole, ~whole):
        sums = table[kind].sum(0) + 0.5 * (kind.sum() + 1)
        weights[:-1][kind] = np.log((table[kind] + 0.5) / sums)
        weights[-1] = np.log(0.5 / sums)  # of the trigrams, which come second
    places = {r["feature"]: row for row, r in enumerate(top)}
    return Model(languages, places, weights, scripts)


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, lang_pred, score, spans.

    ``spans`` lists the stretches of one language as (lang, first word, last
    word), counted from zero between white space.  ``lang_pred`` is the language
    with the most letters (ties: the first by name) and ``score`` its share of
    all letters.  A text that is null or has no letter, and any text where no
    language was learned, is ``und`` with score 0 and no span.  Null and repeated ids are
    labelled row by row.  Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("last", pa.int32())])
    languages = model.languages

    def one(labels: np.ndarray, letters: np.ndarray) -> tuple[str, float, list[dict]]:
        votes = np.bincount(labels, weights=letters, minlength=len(languages))
        if not len(labels) or not votes.sum():
            return "und", 0.0, []
        ends = np.flatnonzero(np.diff(labels)).tolist() + [len(labels) - 1]
        firsts = [0, *(e + 1 for e in ends[:-1])]
        spans = [
            {"lang": languages[labels[a]], "first": a, "last": b}
            for a, b in zip(firsts, ends, strict=True)
        ]
        best = int(votes.argmax())
        return languages[best], float(votes[best] / votes.sum()), spans

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(model)
        for batch in batches:
            if languages:
                numbers = [table.numbers(decode(t)) for t in batch.column(1).to_pylist()]
                scores, letters = table.arrays()
                labels = label_documents(numbers, scores, model.penalty)
                out = [one(a, letters[b]) for a, b in zip(labels, numbers, strict=True)]
                if len(table.rows) > table.LIMIT:
                    table.empty()
            else:
                out = [("und", 0.0, [])] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([o[0] for o in out], pa.string()),
                    pa.array([o[1] for o in out], pa.float64()),
                    pa.array([o[2] for o in out], pa.list_(span)),
                ],
                names=["id", "lang_pred", "score", "spans"],
            )

    return (
        docs.select(id_col, text_bytes(text_col).alias("text"))
        .mapInArrow(
            labelled,
            f"id {id_type}, lang_pred string, score double, "
            "spans array<struct<lang:string,first:int,last:int>>",
        )
        .withColumnRenamed("id", id_col)
    )
