"""Quality scores from compression: zstandard dictionaries of good and of bad
text, and a calibrated score from the normalised difference in size."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of what training reads: rows for each dictionary, and rows for the
#: calibration, taken whole in the order of a hash of their ids.
DICTIONARY_ROWS = 300
CALIBRATION_ROWS = 12_000
CUT = 0.3
LEVEL = 3
#: Texts are also looked at in pieces of so many bytes, each beginning half a
#: piece after the one before and the last at the end; the worst one counts.
PIECE = 4096
RIDGE = 1e-2


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    # The window and the tables of earlier places hold the whole dictionary, however long its texts are.
    size = min(max(20, (len(dictionary) + (1 << 20)).bit_length()), 27)
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=size, hash_log=min(size, 24), chain_log=min(size, 24),
                                                            write_content_size=False, write_checksum=False)
    return zstandard.ZstdCompressor(dict_data=raw, compression_params=params)


@dataclass
class Model:
    """Two dictionaries and a logistic calibration of the size features."""

    good: bytes
    bad: bytes
    centre: list[float] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self._live = None

    def __getstate__(self):
        return {**self.__dict__, "_live": None}

    def _sizes(self, data: bytes) -> tuple[int, int, int]:
        if self._live is None:
            self._live = [_compressor(x) for x in (self.good, self.bad, b"")]
        good, bad, plain = self._live
        return len(good.compress(data)), len(bad.compress(data)), len(plain.compress(data))

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Normalised size difference of the whole text and of its worst
        piece, compressed share and length."""
        data = (text or "").encode()
        good, bad, plain = self._sizes(data)
        whole = worst = (bad - good) / plain
        # A text of one piece is that piece; one byte more gives two that are nearly the whole.
        for i in [*range(0, len(data) - PIECE, PIECE // 2), len(data) - PIECE] if len(data) > PIECE else []:
            g, b, p = self._sizes(data[i:i + PIECE])
            worst = min(worst, (b - g) / p)
        return whole, worst, float(np.log(plain / (len(data) + 20))), float(np.log(len(data) + 20))

    def _design(self, x: np.ndarray) -> np.ndarray:
        cols = [x[:, i] for i in range(x.shape[1])]
        full = np.stack(cols + [a * b for a, b in itertools.combinations_with_replacement(cols, 2)], 1)
        if not self.centre:
            self.centre, self.spread = full.mean(0).tolist(), (full.std(0) + 1e-9).tolist()
        z = np.clip((full - np.array(self.centre)) / np.array(self.spread), -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps, each shortened until the
        loss falls (a full step may overshoot); without rows every score is 0.5."""
        if not len(x):
            return
        z = self._design(x)
        w = np.zeros(z.shape[1])

        def loss(v: np.ndarray) -> float:
            m = z @ v
            return float(np.logaddexp(0, m).sum() - y @ m + RIDGE / 2 * v @ v)

        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (p - y) + RIDGE * w
            step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.eye(len(w)) * RIDGE, slope)
            size, now = 1.0, loss(w)
            while loss(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-8:
                size /= 2
            w = w - size * step
            if size * np.abs(step).max() < 1e-6:
                break
        self.weights = w.tolist()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.weights or not len(x):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ np.array(self.weights), -30, 30)))


def held_out(id_col: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0
    (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on a bounded sample of labelled rows outside the held-out fold.

    One half of the rows, by a hash of the id, feeds the dictionaries and the
    other the calibration.  Rows without id, label or text are not learnt from;
    an id labelled twice counts once, with its smaller label.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
             .withColumn("r", F.xxhash64(F.col("id").cast("string"))))
    half = F.pmod("r", F.lit(2)) == 0
    parts = [known.where(half & (F.col("y") == y)).orderBy("r", "id").limit(DICTIONARY_ROWS) for y in (0, 1)]
    parts.append(known.where(~half).orderBy("r", "id").limit(CALIBRATION_ROWS).withColumn("y", F.col("y") + 2))
    chosen = parts[0].union(parts[1]).union(parts[2])  # bounded by the limits above, so it may be broadcast
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
             .join(F.broadcast(chosen), "id"))
    cut = texts.where("y < 2").select("y", "r", "id", F.col("text").alias("cut")).orderBy("r", "id", "cut").limit(4 * DICTIONARY_ROWS).collect()
    bad, good = ("\n".join(x["cut"] for x in cut if x["y"] == y).encode() for y in (0, 1))
    model = Model(good, bad)
    rows = (texts.where("y >= 2").select("r", "id", (F.col("y") - 2).alias("y"),
                                         _features_udf(model)("text").alias("f"))
            .orderBy("r", "id", "f").limit(CALIBRATION_ROWS).collect())
    if rows:
        model.fit(np.array([x["f"] for x in rows]), np.array([x["y"] for x in rows], float))
    return model


def _features_udf(model: Model):
    @F.pandas_udf("array<double>")
    def features(text: pd.Series) -> pd.Series:
        return pd.Series([list(model.features(x)) for x in text])
    return features


def quality_score(model: Model, text: Column) -> Column:
    """Score in 0 to 1, higher for good text; null and empty texts get the
    score that the model gives to an empty text."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([model.features(x) for x in texts]).reshape(len(texts), 4)))
    return score(text)


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns plus ``score`` and ``predicted`` (1 from ``CUT`` up);
    input columns of these names are replaced.  Rows are scored one by one, so
    repeated rows and ids make no difference."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*kept, quality_score(model, F.col(f"`{text_col}`")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
