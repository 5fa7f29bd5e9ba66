"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

The features approximate a Gaussian kernel. Ridge weights solve normal equations that every
partition sums on its own; the scores of the labelled rows are then calibrated by isotonic
regression over a histogram of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .arrow_map import map_rows
from .store import materialize

FEATURES, RIDGE, BINS, SEED = 128, 1e-3, 200, 11

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOPS = np.zeros(256, dtype=bool)
_STOPS[[ord(c) for c in ".,;:!?'\"-()"]] = True
_SYMBOLS = ~(_LETTERS | _DIGITS | _SPACE | _STOPS)
_END = re.compile(rb"[.!?]\s")

STATISTICS = ("log bytes", "letters", "upper case", "digits", "stops", "symbols", "log mean word bytes", "distinct words", "short words", "words with symbols", "repeated lines", "log words a line", "log words a sentence", "longest word", "commonest byte", "byte entropy")


def statistics(text: str | None) -> list[float]:
    """The document statistics of a whole text, in the order of STATISTICS; null counts as empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    shares = counts[counts > 0] / n
    lower = data.lower().split()
    marked = sum(1 for x in set(words) if not x[-1:].isalnum() and x[-1] < 128 and not _STOPS[x[-1]])
    return [
        float(np.log1p(n)) / 10,
        *(float(counts[kind].sum()) / n for kind in (_LETTERS, _UPPER, _DIGITS, _STOPS, _SYMBOLS)),
        float(np.log1p(sizes.mean())) if len(sizes) else 0.0,
        len(set(lower)) / w,
        float((sizes <= 3).mean()) if len(sizes) else 0.0,
        marked / w,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(w / max(1, len(lines)))) / 5,
        float(np.log1p(w / (1 + len(_END.findall(data))))) / 5,
        float(np.log1p(sizes.max())) / 5 if len(sizes) else 0.0,
        float(counts.max()) / n,
        float(-(shares * np.log2(shares)).sum()) / 8,
    ]


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray  # statistics x features
    phase: np.ndarray
    weights: np.ndarray  # features + 1; the last is the intercept
    knots: np.ndarray  # raw scores, ascending
    values: np.ndarray  # calibrated scores at the knots, ascending

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        cos = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)
        return np.hstack([cos, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores, 0 to 1; linear between knots."""
        if not len(self.knots):
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.values)


STATS = ArrayType(DoubleType())


def with_statistics(df: DataFrame, text_col: str = "text", out: str = "stats") -> DataFrame:
    """``df`` with an array column of the statistics in place of the text."""
    fields = [f for f in df.schema.fields if f.name not in (text_col, out)]

    def start() -> Callable:
        def step(rows: dict[str, list]):
            yield {f.name: rows[f.name] for f in fields} | {out: [statistics(t) for t in rows[text_col]]}

        return step

    return map_rows(df, start, StructType([*fields, StructField(out, STATS)]))


def _summed(rows: DataFrame, columns: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows (stats, y) of the matrix that ``columns`` gives for a batch.

    Each partition adds up its own and emits the matrix row by row, a row as one array. Rows are summed
    by their number with map-side aggregation, so the driver gets one matrix however many partitions
    there are, and the shuffle carries at most one array a partition and row.
    """
    schema = StructType([StructField("row", IntegerType()), StructField("part", STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("stats").to_pylist(), dtype=np.float64)
                part = columns(x, np.array(batch.column("y").to_pylist(), dtype=np.float64))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "part": pa.array(list(total), pa.list_(pa.float64()))})

    width = columns(np.zeros((1, len(STATISTICS))), np.zeros(1)).shape[1]
    sums = [F.sum(F.col("part")[k]).alias(str(k)) for k in range(width)]
    found = sorted(rows.mapInArrow(run, schema).groupBy("row").agg(*sums).collect())
    return np.array([r[1:] for r in found]) if found else np.zeros((0, 0))


def isotonic(weights: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weighted least-squares non-decreasing fit, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for w, v in zip(weights, values, strict=True):
        pools.append([w, v, 1])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            w2, v2, n2 = pools.pop()
            w1, v1, n1 = pools[-1]
            pools[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.concatenate([[p[1]] * int(p[2]) for p in pools]) if pools else np.zeros(0)


def train(labelled: DataFrame, stats_col: str = "stats", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE, bins: int = BINS, seed: int = SEED) -> QualityModel:
    """Fit on all rows with statistics and a label of 0 or 1; no sample is drawn.

    ``labelled`` must be stored, as three passes read it. Sums of a bounded size reach the driver.
    With no labelled rows every score is 0.5.
    """
    rows = labelled.filter(F.col(stats_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(stats_col).alias("stats"), F.col(label_col).cast("double").alias("y"))
    n_stats = len(STATISTICS)
    moments = _summed(rows, lambda x, y: np.vstack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], float(len(x)))]))
    rng = np.random.default_rng(seed)
    frequency, phase = rng.normal(0, 1 / np.sqrt(n_stats) * 1.5, (n_stats, features)), rng.uniform(0, 2 * np.pi, features)
    if not moments.size or not moments[2, 0]:
        none = np.zeros(0)
        return QualityModel(np.zeros(n_stats), np.ones(n_stats), frequency, phase, np.zeros(features + 1), none, none)
    n = moments[2, 0]
    mean = moments[0] / n
    scale = np.sqrt(np.maximum(moments[1] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    plain = QualityModel(mean, scale, frequency, phase, np.zeros(features + 1), np.zeros(0), np.zeros(0))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = plain.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = _summed(rows, normal)
    penalty = ridge * n * np.eye(features + 1) / features
    penalty[-1, -1] = 0
    weights = np.linalg.solve(sums[:, :-1] + penalty + 1e-9 * np.eye(features + 1), sums[:, -1])
    fitted = QualityModel(mean, scale, frequency, phase, weights, np.zeros(0), np.zeros(0))

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = np.clip(fitted.raw(x), -1, 2)
        at = np.minimum(((raw + 1) / 3 * bins).astype(int), bins - 1)
        return np.stack([np.bincount(at, weights=v, minlength=bins) for v in (np.ones(len(y)), y, raw)])

    count, ones, raw = _summed(rows, histogram)
    full = count > 0
    values = isotonic(count[full], ones[full] / count[full])
    return QualityModel(mean, scale, frequency, phase, weights, raw[full] / count[full], values)


def score(stats: DataFrame, model: QualityModel, stats_col: str = "stats", out: str = "score") -> DataFrame:
    """Add the calibrated score of every row's statistics, clipped to 0 .. 1."""
    schema = StructType([*(f for f in stats.schema.fields if f.name != stats_col), StructField(out, DoubleType())])

    def start() -> Callable:
        def step(rows: dict[str, list]):
            x = np.array(rows[stats_col], dtype=np.float64).reshape(len(rows[stats_col]), len(STATISTICS))
            yield {n: rows[n] for n in schema.fieldNames() if n != out} | {out: np.clip(model.score(x), 0, 1).tolist()}

        return step

    return map_rows(stats, start, schema)


def classify(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Rows (id, score) of every whole text, learned from the labels of rows where ``usable`` holds.

    Statistics are computed once, over whole texts however long, and stored. Null texts are scored as
    empty ones; a null id is scored and never learned from; rows that repeat an id are each scored, and
    each learns from all labels of that id. An empty table gives no rows; without labels every score is
    0.5. Other columns are never read, so their names can't clash.
    """
    stats = materialize(with_statistics(df.select(id_col, text_col), text_col), "stats")
    known = labels.select(id_col, label_col).filter(F.col(label_col).isNotNull())
    labelled = materialize(stats.filter(usable).join(known, id_col).select("stats", label_col), "labelled")
    return score(stats, train(labelled, label_col=label_col))
