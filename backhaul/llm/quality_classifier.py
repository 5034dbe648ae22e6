"""Quality scores by ridge regression on random Fourier features of document statistics.

Cosines of random projections of the standardised statistics approximate a Gaussian kernel. Each
partition adds up its part of the normal equations, the parts are added in two levels, and the driver
solves one small system. An isotonic fit on labelled documents kept out of the regression turns raw
scores into probabilities. All labelled documents take part, in one pass over their statistics; texts
are read once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backhaul.llm.line_rules import FEATURES, Text
from backhaul.llm.scratch import stored
from backhaul.llm.words import buffers, row_sums, slices

WAVES = 256
WIDTH = 3.0  # of the kernel, in standard deviations of the statistics
RIDGE = 1e-3
THRESHOLD = 0.3
HELD_OUT, CALIBRATION = 0, 1  # remainders of crc32(doc_id as text) modulo 5
_BINS = 400
STATISTICS = [
    "log_words", "word_length", "symbols", "symbol_words", "duplicate_lines", "repeated_words", "log_lines",
    "line_words", "wide", *[f"line_{x}" for x in FEATURES[1:]],
]


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text; line features are weighted by the words of the lines."""
    text = Text(data, offsets)
    words, size = np.maximum(text.n_words, 1), np.maximum(np.diff(offsets), 1)
    lines = np.diff(text.first)
    wide = row_sums(data >= 0x80, offsets) / size
    by_line = [row_sums(text.features[:, k] * text.words_in_line, text.first) / words for k in range(1, len(FEATURES))]
    return np.column_stack(
        [
            np.log1p(text.n_words),
            np.minimum(text.word_chars / words, 30),
            text.n_symbols / size,
            np.minimum(text.n_symbols / words, 5),
            text.n_dup_lines / np.maximum(lines, 1),
            text.n_repeat_words / words,
            np.log1p(lines),
            np.log1p(text.n_words / np.maximum(lines, 1)),
            wide,
            *by_line,
        ]
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, part (the remainder that decides its role) and its statistics as packed floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                x = statistics(*buffers(batch.column(1))).astype("<f4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array([row.tobytes() for row in x], pa.binary())],
                    names=["doc_id", "part", "x"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), remainder(F.col("doc_id")).alias("part"))
    return rows.mapInArrow(run, "doc_id long, part long, x binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x.as_buffer(), "<f4") for x in column], float).reshape(len(column), len(STATISTICS))


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # knots of the calibration
    fitted: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(20)
        project = draw.normal(0, 1 / WIDTH, (x.shape[1], WAVES))
        phase = draw.uniform(0, 2 * math.pi, WAVES)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(x)), math.sqrt(2 / WAVES) * np.cos(z @ project + phase)])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.waves(x) @ self.weights, self.raw, self.fitted)


def _sum_parts(parts: DataFrame) -> np.ndarray | None:
    """Element-wise sum of the arrays that partitions made, in two levels so that neither a task nor
    the driver gets more of them than the root of their number."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<f8") for x in table.column("part"))
        return pa.table({"part": pa.array([total.tobytes()], pa.binary())})

    groups = max(1, math.isqrt(parts.count()))
    level = parts.withColumn("group", F.pmod("task", F.lit(groups))).groupBy("group").applyInArrow(add, "part binary")
    found = [np.frombuffer(r.part, "<f8") for r in level.collect()]
    return sum(found) if found else None


def _parts(rows: DataFrame, make) -> DataFrame:
    """One array per task: the sum of `make(x, y)` over its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(_matrix(batch.column(0)), np.asarray(batch.column(1), float))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.astype("<f8").tobytes()], pa.binary())],
                names=["task", "part"],
            )

    return stored(rows.select("x", "quality").mapInArrow(run, "task int, part binary"), "quality-sums")


def _moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])


def _isotonic(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a rising fit to (mean raw score, positives, n) by pooling neighbours out of order."""
    blocks: list[list[float]] = []
    for raw, good, n in sorted(rows):
        blocks.append([raw * n, good, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(measured: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on all labelled documents outside the held-out part; None if there are none."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).dropna()
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stored(measured.where(F.col("part") != HELD_OUT).join(marked, "doc_id"), "quality-rows")
    fit = rows.where(F.col("part") != CALIBRATION)
    moments = _sum_parts(_parts(fit, _moments))
    if moments is None:
        return None
    n, k = moments[0], len(STATISTICS)
    centre = moments[1 : k + 1] / n
    scale = np.sqrt(np.maximum(moments[k + 1 :] / n - centre**2, 1e-8))
    bare = Model(centre, scale, np.zeros(WAVES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = bare.waves(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sum_parts(_parts(fit, equations))
    d = WAVES + 1
    weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * n * np.eye(d) / d, sums[d * d :])
    model = Model(centre, scale, weights, bare.raw, bare.fitted)

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.waves(x) @ weights
        at = np.clip((raw + 0.5) * _BINS / 2, 0, _BINS - 1).astype(int)
        return np.concatenate([np.bincount(at, v, _BINS) for v in (raw, y, np.ones(len(y)))])

    found = _sum_parts(_parts(rows.where(F.col("part") == CALIBRATION), bins))
    if found is None:
        return model
    raw, good, count = found.reshape(3, _BINS)
    used = count > 0
    knots = _isotonic(list(zip(raw[used] / count[used], good[used], count[used])))
    return Model(centre, scale, weights, *knots)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of doc_id as text, modulo 5, is 0: its label is
    not learned from), score (probability of label 1) and predicted (1 from `threshold` on).

    Null and blank texts are scored by their statistics, which are zeros. Repeated rows and rows
    without an id (read as the empty string, never labelled) each get a row; an id with several
    labels has the lowest. Without labels all scores are 0.5. Other columns are not read.
    """
    measured = stored(measure(docs), "quality-statistics")
    model = train(measured, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2))
            value = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.asarray(batch.column(1)) == HELD_OUT),
                    pa.array(np.clip(value, 0, 1)),
                    pa.array((value >= threshold).astype(np.int32)),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return measured.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
