"""Quality by compression: how much better a text packs with good than with bad examples.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces of
bad labelled texts.  A text is compressed whole with both; the difference of the
sizes over their sum, with the packed share of the text beside it (a text that
repeats itself packs to almost nothing with either), is calibrated to a
probability on labelled documents the dictionaries have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from legajo.llm.common import fold, slices, stored, text_bytes
from legajo.llm.fitting import fit_logistic, labelled_sample, logistic


@dataclass
class Model:
    good: bytes
    bad: bytes
    level: int = 3
    calibration: tuple[float, ...] = ()


class Packer:
    """Features of whole texts: normalised size difference and packed shares."""

    def __init__(self, model: Model):
        self.good, self.bad = self.compressor(model.good, model), self.compressor(model.bad, model)

    @staticmethod
    def compressor(data: bytes, model: Model) -> zstandard.ZstdCompressor:
        options = dict(level=model.level, write_content_size=False, write_dict_id=False)
        if not data:
            return zstandard.ZstdCompressor(**options)
        held = zstandard.ZstdCompressionDict(data)
        held.precompute_compress(level=model.level)
        return zstandard.ZstdCompressor(dict_data=held, **options)

    def features(self, texts: list[bytes]) -> np.ndarray:
        good = np.asarray([len(self.good.compress(t or b"")) for t in texts], float)
        bad = np.asarray([len(self.bad.compress(t or b"")) for t in texts], float)
        size = np.asarray([len(t or b"") for t in texts], float) + 16
        difference = 10 * (bad - good) / (bad + good + 16)
        share = np.log((bad + good + 16) / 2 / size)
        # a steep and a flat reading of the difference, and the packed share with a bend
        return np.column_stack(
            [difference, np.tanh(difference), share, np.minimum(share + 1.5, 0), difference * share]
        ).reshape(len(texts), 5)


def train_dictionary(pieces: list[bytes], size: int) -> bytes:
    """A dictionary of the pieces; without enough of them for training, the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    max_rows: int = 20_000,
    max_pieces: int = 4_000,
    piece_bytes: int = 4_096,
    dictionary_bytes: int = 256 << 10,
    folds: int = 5,
    held_out: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Learn from at most ``max_rows`` labelled documents outside the held-out fold.

    Half of them (by another fold of the id) give pieces of ``piece_bytes`` bytes,
    of which each class trains on at most ``max_pieces``: that bounds what reaches
    the driver.  The other half calibrates.  Without labelled rows, or with one
    class only, every document gets the share of good rows (0.5 without rows).
    """
    sample = stored(
        labelled_sample(
            docs, labels, label_col, max_rows, folds, held_out, id_col=id_col, text_col=text_col
        ),
        "quality-sample",
    )
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n1 or not n0:
        share = 0.5 if n1 == n0 else min(max(n1 / (n1 + n0), 1e-6), 1 - 1e-6)
        return Model(b"", b"", calibration=(0.0,) * 5 + (math.log(share / (1 - share)),))
    first_half = fold("id", 7) < 4
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("text"), F.lit(1)), F.lit(piece_bytes))
    pieces = sample.filter(first_half & (F.octet_length("text") > 0)).select(
        "label",
        "id",
        F.posexplode(starts).alias("place", "start"),
        "text",
    ).select("label", "id", "place", F.substring("text", F.col("start"), piece_bytes).alias("piece"))
    model = Model(b"", b"")
    for label, name in ((1, "good"), (0, "bad")):
        rows = (
            pieces.filter(F.col("label") == 1 if label else F.col("label") != 1)
            .orderBy(F.xxhash64("id", "place"), "id", "place")
            .limit(max_pieces)
            .select("piece")
            .collect()
        )
        setattr(model, name, train_dictionary([bytes(r["piece"]) for r in rows], dictionary_bytes))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(model)
        for batch in slices(batches):
            features = packer.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch.column("label"),
                    "features": pa.array(features.tolist(), pa.list_(pa.float64())),
                }
            )

    rows = (
        sample.filter(~first_half)
        .select("label", "text")
        .mapInArrow(measured, "label int, features array<double>")
        .collect()  # at most max_rows rows of six numbers
    )
    x = np.asarray([r["features"] for r in rows], float).reshape(len(rows), 5)
    y = np.asarray([float(r["label"] == 1) for r in rows])
    model.calibration = tuple(fit_logistic(x, y))
    return model


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, score (0 to 1, higher: better), size_difference.

    Every text is compressed whole.  Null and empty texts have no difference and
    get the calibrated score of that.  Null and repeated ids are scored row by
    row.  Other columns are not read.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(model)
        for batch in slices(batches):
            features = packer.features(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(logistic(features, np.asarray(model.calibration)), pa.float64()),
                    pa.array(features[:, 0] / 10, pa.float64()),
                ],
                names=["id", "score", "size_difference"],
            )

    return (
        docs.select(id_col, text_bytes(text_col).alias("text"))
        .mapInArrow(scored, f"id {id_type}, score double, size_difference double")
        .withColumnRenamed("id", id_col)
    )
