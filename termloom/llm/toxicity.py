"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams (3 to 6 code points of ``<word>``, and the whole
word), hashed into a fixed number of rows, so that a misspelt or unseen word still shares vectors with those learnt. The
words of a window are averaged into a linear softmax of two classes. A text is scored by windows of
``WINDOW`` words at half that distance and its score is that of its worst window: a remark in a long text isn't thinned
out by what surrounds it. Training is joint over embeddings and softmax, in numpy, with Adagrad: each pass picks the
worst window of every training text under the present model, as only texts are labelled.

The first ``WHOLE`` passes, which know no windows yet, take each text as one bag.

The model learns on a bounded sample of labelled rows: ``MAX_TRAIN`` toxic and
``MAX_CLEAN`` others, in hash order. Their texts are read whole, as in scoring. The driver holds them as word numbers,
and of each distinct word the numbers of its n-grams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from termloom.functions.shared import staged
from termloom.llm.common import fold, narrow, table

BUCKETS = 1 << 17
DIM = 8
GRAMS = (3, 4, 5, 6)
WINDOW = 16
LONGEST = 200
#: Bounds of the training sample.
MAX_TRAIN, MAX_CLEAN = 1500, 4000
PASSES, WHOLE = 12, 4
BATCH = 64
#: Words whose n-grams are worked out at once.
CHUNK_WORDS = 4096
SEED = 20240607


def words_of(text: str | None) -> list[str]:
    """The distinct words in the order in which they first occur, in lower case without punctuation at their ends.

    A word of punctuation alone stays as it is. A bag holds a word once, so that repeating a word changes nothing. A run
    of more than ``LONGEST`` code points is several words, which overlap so that each n-gram is in one of them.
    """
    words = (w.strip(".,;:!?\"'()[]*#$%&") or w for w in (text or "").lower().split())
    over = max(GRAMS)
    return list(dict.fromkeys(p for w in words for p in ([w] if len(w) <= LONGEST else (w[i : i + LONGEST] for i in range(0, len(w) - over, LONGEST - over)))))


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word number of every n-gram of ``<word>`` and of every whole word."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(code))  # code points to the word's end
    buckets, owners = [], []
    h = np.zeros(len(code), np.uint64)
    mul = np.uint64(0x100000001B3)
    for n in range(1, max(GRAMS) + 1):
        h = (h[: len(code) - n + 1] ^ code[n - 1 :]) * mul if n <= len(code) else h[:0]
        h ^= h >> np.uint64(29)
        if n in GRAMS:
            ok = left[: len(h)] >= n
            buckets.append(((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64))
            owners.append(owner[: len(h)][ok])
    start = np.cumsum(length) - length
    weights = code * ((np.arange(len(code), dtype=np.uint64) - np.repeat(start, length).astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))
    whole = np.add.reduceat(weights, start) if len(words) else np.zeros(0, np.uint64)
    whole ^= whole >> np.uint64(31)
    buckets.append(((whole * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)).astype(np.int64))
    owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


def gram_lists(index: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words, one word after another, and their number for each word."""
    names, buckets, counts = list(index), [], []
    for lo in range(0, len(names), CHUNK_WORDS):
        part = names[lo : lo + CHUNK_WORDS]
        bucket, owner = subwords(part)
        buckets.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
        counts.append(np.bincount(owner, minlength=len(part)))
    return np.concatenate(buckets), np.concatenate(counts)


class SubwordSoftmax:
    """Embeddings ``e`` (buckets x dim), softmax weights ``w`` (dim x 2) and bias ``b``."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
        self.w = np.zeros((DIM, 2), np.float32)
        self.w[:, 1] = rng.normal(0, 0.5, DIM)
        self.b = np.zeros(2, np.float32)

    def fit(self, texts: Iterable[list[str]], labels: list[int], passes: int = PASSES, rate: float = 0.25) -> "SubwordSoftmax":
        """``texts``: the words of each text, which may come one by one. Without two labels or any word: the bias alone."""
        index: dict[str, int] = {}
        ids = [np.array([index.setdefault(w, len(index)) for w in t], np.int32) for t in texts]
        y = np.array(labels, np.int64)
        if not index or len(set(labels)) < 2:
            self.w[:] = 0
            p = (y.sum() + 0.5) / (len(y) + 1)
            self.b[1] = np.log(p / (1 - p))
            return self
        bucket, count = gram_lists(index)
        at = np.r_[0, np.cumsum(count)]
        share = np.bincount(y, minlength=2)
        cost = (len(y) / (2 * np.maximum(share, 1)))[y]
        ge, gw, gb = np.full(BUCKETS, 1e-6, np.float32), np.full(self.w.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        rng = np.random.default_rng(SEED + 1)
        summed = lambda to, x, n: np.stack([np.bincount(to, x[:, d], n) for d in range(DIM)], 1).astype(np.float32)
        for turn in range(passes):
            one = np.add.reduceat(self.table()[0][bucket], at[:-1]) / count
            picks = []
            for k, t in enumerate(ids):
                if not len(t):
                    continue
                if turn < WHOLE:
                    picks.append((k, -1))
                    continue
                s = window_means(one[t])
                picks += [(k, int(i)) for i in s.argsort()[::-1][: 1 if y[k] else 2]]
                if not y[k]:
                    picks.append((k, int(rng.integers(len(s)))))
            rng.shuffle(picks)
            for lo in range(0, len(picks), BATCH):
                part = picks[lo : lo + BATCH]
                which = [k for k, _ in part]
                bags = [ids[k] if i < 0 else ids[k][window_slice(len(ids[k]), i)] for k, i in part]
                size = np.array([len(b) for b in bags], np.int64)
                flat = np.concatenate(bags)
                slots = np.repeat(np.maximum(size, WINDOW), size)  # a shorter bag has empty slots
                rows = np.concatenate([bucket[at[w] : at[w + 1]] for w in flat])
                row_bag = np.repeat(np.repeat(np.arange(len(part)), size), count[flat])
                row_weight = np.repeat(1 / (count[flat] * slots), count[flat]).astype(np.float32)[:, None]
                x = summed(row_bag, self.e[rows] * row_weight, len(part))
                z = x @ self.w + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), y[which]] -= 1
                g = (p * cost[which][:, None]).astype(np.float32)
                dw, db, dx = x.T @ g, g.sum(0), g @ self.w.T
                gw += dw**2
                gb += db**2
                self.w -= rate * dw / np.sqrt(gw)
                self.b -= rate * db / np.sqrt(gb)
                hit, back = np.unique(rows, return_inverse=True)
                de = summed(back, dx[row_bag] * row_weight, len(hit))
                ge[hit] += (de**2).mean(1)
                self.e[hit] -= rate * de / np.sqrt(ge[hit])[:, None]
        return self

    def table(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log odds of label 1, and the bias: all that scoring needs."""
        return self.e @ (self.w[:, 1] - self.w[:, 0]), float(self.b[1] - self.b[0])


def window_slice(n: int, i: int) -> slice:
    return slice(0, n) if n <= WINDOW else slice(min(i * (WINDOW // 2), n - WINDOW), min(i * (WINDOW // 2), n - WINDOW) + WINDOW)


def window_means(values: np.ndarray) -> np.ndarray:
    """The mean of each window; a shorter text is one window with empty slots."""
    n = len(values)
    if n <= WINDOW:
        return np.array([values.sum() / WINDOW])
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    starts = np.minimum(np.arange(0, n - WINDOW // 2, WINDOW // 2), n - WINDOW)
    return (total[starts + WINDOW] - total[starts]) / WINDOW


def score_texts(texts: list[str | None], adds: np.ndarray, bias: float) -> np.ndarray:
    """The probability of label 1 for each text."""
    index: dict[str, int] = {}
    ids = [np.array([index.setdefault(w, len(index)) for w in words_of(t)], np.int64) for t in texts]
    if index:
        bucket, owner = subwords(list(index))
        one = np.bincount(owner, adds[bucket], len(index)) / np.bincount(owner, minlength=len(index))
    z = np.array([bias + (window_means(one[i]).max() if len(i) else 0.0) for i in ids])
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_fold: int = 0) -> SubwordSoftmax:
    """A model of the labelled rows outside fold ``held_fold``; rows without id or label are left out.

    Of repeated ids each label and each text counts, within the sample's bounds, which hold for rows of ``docs``, too.
    """
    marked = narrow(labels, _id=id_col, _y=label_col).where("_id is not null and _y in (0, 1)").where(fold("_id", folds) != held_fold).distinct()
    order = [F.xxhash64(F.lit(3), "_id"), F.col("_id"), F.col("_y")]
    sample = marked.where("_y = 1").orderBy(*order).limit(MAX_TRAIN).unionByName(marked.where("_y = 0").orderBy(*order).limit(MAX_CLEAN))
    text = narrow(docs, _doc=id_col, _t=text_col)
    met = text.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_id", "_y", "_t")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [" ".join(words_of(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int64()), pa.array(out, pa.string())], ["_id", "_y", "_t"])

    kind = dict(met.dtypes)["_id"]
    split = staged(met.mapInArrow(words, f"_id {kind}, _y long, _t string"), "toxicity-sample")
    by_text = [*order, F.xxhash64("_t"), F.col("_t")]
    rows = [tuple(r) for y, most in ((1, MAX_TRAIN), (0, MAX_CLEAN)) for r in split.where(F.col("_y") == y).orderBy(*by_text).limit(most).collect()]
    return SubwordSoftmax().fit((r[2].split() for r in rows), [int(r[1]) for r in rows])


def score(docs: DataFrame, model: SubwordSoftmax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (double): a null or blank text has the score of no words, from the bias alone.

    One pass without a shuffle; every row gets a score, repeated rows the same one; columns pass through as they are.
    """
    adds, bias = model.table()
    held = docs.sparkSession.sparkContext.broadcast((adds.astype(np.float32), bias))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_, b = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = score_texts([t.as_py() for t in part.column(at)], table_, b)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], [*part.schema.names, "_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = score(docs, model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"))
