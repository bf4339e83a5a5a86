"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade > g) = logistic(w . x - t_g): one weight vector over hashed text features for all grades, and ordered thresholds
t_0 < t_1 < ... kept in order as a first value and positive gaps. Features are the square roots of the shares of hashed
byte trigrams and word shapes (length, a word equal to the last, kind of the last character), so texts of any length are
on one scale. Whole texts are read. The weights are learnt in numpy on a bounded sample of labelled rows: ``MAX_TRAIN``
rows in hash order, of which only features come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.shared import staged
from termloom.llm.common import fold, narrow, table

WIDTH, SHAPES = 2048, 256
#: Bound of the training sample.
MAX_TRAIN = 5000
STEPS, RATE, DECAY = 400, 0.05, 1e-4


def features(text: str | None) -> np.ndarray:
    """A float32 vector of WIDTH + SHAPES; zeros for a null or blank text."""
    raw = (text or "").encode("utf-8", "replace")
    out = np.zeros(WIDTH + SHAPES, np.float32)
    words = raw.split()
    if not words:
        return out
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[:WIDTH] = np.sqrt(np.bincount(h >> np.uint32(21), minlength=WIDTH) / len(h))
    size = np.minimum([len(w) for w in words], 63)
    last = np.array([w[-1] for w in words])
    n = len(words)
    shape = np.zeros(SHAPES)
    shape[:64] = np.bincount(size, minlength=64)
    shape[64:192] = np.bincount(np.minimum(last, 127), minlength=128)
    shape[192] = sum(a == c for a, c in zip(words, words[1:]))
    shape[193 + min(int(20 * len(set(words)) / n), 20)] = n / 4
    shape[220 + min(int(n).bit_length(), 20)] = n / 16
    out[WIDTH:] = np.sqrt(shape / n)
    return out


class OrdinalLogit:
    def fit(self, x: np.ndarray, y: np.ndarray, grades: int) -> "OrdinalLogit":
        """``y``: grades 0 to ``grades`` - 1. With fewer than two grades or no rows the weights stay zero."""
        k = max(grades, 2) - 1
        self.w = np.zeros(x.shape[1], np.float64)
        shares = np.array([(np.sum(y > g) + 0.5) / (len(y) + 1) for g in range(k)])
        t = -np.log(shares / (1 - shares))
        first, gaps = t[0], np.log(np.maximum(np.diff(t), 1e-3))
        params = np.r_[self.w, first, gaps]
        m, v = np.zeros_like(params), np.zeros_like(params)
        above = (y[:, None] > np.arange(k)[None, :]).astype(np.float64)
        for step in range(1, STEPS + 1 if len(y) and grades > 1 else 1):
            w, first, gaps = params[: len(self.w)], params[len(self.w)], params[len(self.w) + 1 :]
            t = first + np.r_[0, np.cumsum(np.exp(gaps))]
            p = 1 / (1 + np.exp(-((x @ w)[:, None] - t[None, :])))
            e = (p - above) / len(y)
            dt = -e.sum(0)
            g = np.r_[x.T @ e.sum(1) + DECAY * w, dt.sum(), [dt[i + 1 :].sum() * np.exp(gaps[i]) for i in range(k - 1)]]
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            params -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w = params[: len(self.w)].copy()
        self.t = params[len(self.w)] + np.r_[0, np.cumsum(np.exp(params[len(self.w) + 1 :]))]
        return self

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade > g) for each g, not rising with g."""
        return 1 / (1 + np.exp(-np.clip((x @ self.w)[:, None] - self.t[None, :], -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[OrdinalLogit, list[int]]:
    """The model and its grades, from labelled rows outside fold 0; rows without id or grade are left out.

    Of repeated ids each grade and each text counts, within ``MAX_TRAIN`` rows in all: the bound holds for rows of ``docs``, too.
    """
    marked = narrow(labels, _id=id_col, _y=label_col).where("_id is not null and _y is not null").where(fold("_id") != 0).distinct()
    sample = marked.orderBy(F.xxhash64(F.lit(5), "_id"), "_id", "_y").limit(MAX_TRAIN)
    met = narrow(docs, _doc=id_col, _t=text_col).join(F.broadcast(sample), F.col("_doc") == F.col("_id")).selectExpr("cast(_id as string) i", "cast(_y as int) y", "_t")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()).tobytes() for t in b.column(2)], pa.binary())], ["i", "y", "x"])

    found = staged(met.mapInArrow(vectors, "i string, y int, x binary"), "ordinal-sample")
    first = found.orderBy(F.xxhash64(F.lit(5), "i"), "i", "y", F.xxhash64("x"), "x").limit(MAX_TRAIN)
    rows = [(r["i"], r["y"], bytes(r["x"])) for r in first.collect()]
    grades = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(r[2] for r in rows), np.float32).reshape(-1, WIDTH + SHAPES)
    return OrdinalLogit().fit(x, np.array([grades.index(r[1]) for r in rows], np.int64), len(grades)), grades or [0]


def score(docs: DataFrame, model: OrdinalLogit, grades: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(_id, expected_grade, tail)`` for every row: the mean grade, and the probability of the top grade.

    A null or blank text has no features and gets what the thresholds alone say; repeated rows get a row each.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.diff(grades) if len(grades) > 1 else np.zeros(len(model.t))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p = model.tails(np.array([features(t.as_py()) for t in part.column(1)]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(grades[0] + p @ steps), pa.array(p[:, -1])], ["_id", "expected_grade", "tail"])

    return narrow(docs, _id=id_col, t=text_col).mapInArrow(run, f"_id {kind}, expected_grade double, tail double")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, grades = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, grades).select(
        F.col("_id").alias("doc_id"), (fold("_id") == 0).alias("held_out"), "expected_grade", F.col("tail").alias("tail_probability"), (F.col("tail") >= 0.5).alias("kept")
    )
