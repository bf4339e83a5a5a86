"""LM scoring with a hidden Markov language model.

The model. A text is a sequence of tokens and one end. A hidden state moves by a transition matrix; each state emits a
word class, and a class emits a word by its share of the class's training count: P(w | state) = E[state, class(w)] x
P(w | class(w)). The commonest ``TOP`` words are classes of their own; the others are classed by a hash of their last
three characters, which a word never seen in training has, too. So the matrices have a fixed size however many words
there are, while every word's own count enters the score through P(w | class), whose table is joined, never broadcast.
P(w | class) is smoothed like the base with one place for unseen words in each hashed class, so the model is a proper
distribution over token sequences with 'an unseen word of class b' as a symbol.

Training is Baum-Welch: each pass, tasks run forward and backward over all training texts and the expected counts are
added up by key across partitions; only the K x classes sums come to the driver. The first values come from all training
texts, too: each is in one of up to ``STEPS`` slices by hash, and ``STEPS`` steps of stepwise Baum-Welch take the slices in
turn, all equally often, each step blending its slice's counts into those before. Full passes follow until the log
likelihood of all training texts rises by less than ``SETTLED`` of itself, ``PASSES`` at most. Scoring is the scaled
forward recursion over whole texts. It is exact however long the text: texts of like length go through the recursion side
by side, and long ones in stretches of time that hold about ``BLOCK_TOKENS`` tokens, so memory has a bound.

Tokens, counts and classes. Texts are packed into chunks of about ``CHUNK_CHARS`` characters with a vocabulary each;
the chunks' vocabularies (not their tokens) are shuffled to be counted and to fetch the counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from termloom.functions.shared import staged
from termloom.llm.common import fold, narrow, table

STATES = 16
TOP, HASHED = 4096, 4096
CLASSES = TOP + HASHED + 1
END = CLASSES - 1
CHUNK_CHARS = 10_000_000
#: Bits of a chunk's number within its partition, and of a word's within its chunk.
CHUNK_BITS, WORD_BITS = 12, 24
#: Steps before the full passes (a power of two, as are the slices), tokens that a slice has at least if there are several, and the power of a step's number by which its weight falls.
STEPS, SLICE_TOKENS, FORGET = 16, 250_000, 0.6
PASSES, SETTLED = 4, 2e-3
#: Tokens worked on at once.
BLOCK_TOKENS = 100_000
#: Texts of more tokens than this go side by side, whatever their number.
LONG = 2048
#: Tokens of long texts that a task gathers before it works on them.
LONG_TOKENS = 4_000_000
PRIOR = 100.0
SEED = 8101


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """While jobs run within, Arrow batches have at most so many rows, which bounds what a Python worker holds of whole texts. Affects no result."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunked(docs: DataFrame, held: str) -> DataFrame:
    """A row for each chunk: its documents, their token counts, the vocabulary, training counts and token numbers."""
    kind = dict(docs.dtypes)["_id"]
    id_type = to_arrow_type(docs.schema["_id"].dataType)
    schema = f"chunk long, ids array<{kind}>, held array<boolean>, lens array<int>, vocab array<string>, seen array<int>, suffix binary, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        ids, flags, lens, tokens, size = [], [], [], [], 0
        vocab: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            train = np.repeat(~np.array(flags, bool), lens)
            seen = np.bincount(flat[train], minlength=len(vocab))
            words = pa.array(vocab, pa.binary()).cast(pa.string())  # as valid as the texts that they come from
            suffix = np.array([suffix_class(w.decode()) for w in vocab], np.uint16).tobytes()
            if made >= 1 << CHUNK_BITS or len(vocab) >= 1 << WORD_BITS:
                raise OverflowError(f"chunk {made} of a partition with {len(vocab)} words: more partitions are needed")
            number = (TaskContext.get().partitionId() << CHUNK_BITS) + made
            one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
            cols = [pa.array([number]), one(pa.array(ids, id_type)), one(pa.array(flags, pa.bool_())), one(pa.array(lens, pa.int32())), one(words), one(pa.array(seen.astype(np.int32)))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([suffix], pa.binary()), pa.array([planes(flat)], pa.binary())], ["chunk", "ids", "held", "lens", "vocab", "seen", "suffix", "tokens"])

        for batch in batches:
            for i, t, h in zip(*(batch.column(k) for k in range(3))):
                words = (t.as_py() or "").encode("utf-8", "replace").lower().split()
                tokens.append(np.array([vocab.setdefault(w, len(vocab)) for w in words], np.int32))
                ids.append(i.as_py())
                flags.append(bool(h.as_py()))
                lens.append(len(words))
                size += len(t.as_py() or "") + 40
                if size >= CHUNK_CHARS:
                    yield out()
                    made += 1
                    ids, flags, lens, tokens, size, vocab = [], [], [], [], 0, {}
        if ids:
            yield out()

    return docs.select("_id", "_t", held).mapInArrow(run, schema)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^24 as all their low 16 bits and then all their high 8 bits, which are mostly zeros."""
    return numbers.astype(np.uint16).tobytes() + (numbers >> 16).astype(np.uint8).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    n = len(raw) // 3
    return np.frombuffer(raw, np.uint16, n) + (np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.int64) << 16)


def slice_of(chunk: int, texts: int, slices: int) -> np.ndarray:
    """The slice of each text of a chunk, by a hash of their numbers."""
    x = (np.arange(texts, dtype=np.uint64) + (np.uint64(chunk) << np.uint64(24))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def suffix_class(word: str) -> int:
    return TOP + zlib.crc32(word[-3:].encode()) % HASHED


class Hmm:
    def __init__(self, share: np.ndarray, states: int = STATES):
        """``share``: the training share of each class, the prior of every state's emissions."""
        rng = np.random.default_rng(SEED)
        self.share = share / share.sum()
        self.a = np.full((states, states), 0.08 / max(states - 1, 1))
        np.fill_diagonal(self.a, 0.92)
        self.a /= self.a.sum(1, keepdims=True)
        self.pi = np.full(states, 1 / states)
        e = self.share[:, None] * np.exp(rng.normal(0, 0.7, (len(share), states)))
        self.e = e / e.sum(0)

    def take(self, first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> None:
        """New values from expected counts, emissions with ``PRIOR`` counts spread like ``share``."""
        k = len(self.pi)
        self.pi = (first + 1) / (first.sum() + k)
        self.a = (moves + 1) / (moves.sum(1, keepdims=True) + k)
        emits = emits + PRIOR * self.share[:, None]
        self.e = emits / emits.sum(0)

    def _forward(self, g: "Segments", part: tuple[int, int], p: np.ndarray, keep: bool):
        """Through the steps of ``part`` from the prior ``p``: the prior after them and each token's scale; with ``keep`` states and emissions, too."""
        first, last = part
        base = g.start[first]
        em = self.e[g.cls[base : g.start[last]]]
        scale = np.empty(len(em))
        alpha = em.copy() if keep else em
        for t in range(first, last):
            here = slice(g.start[t] - base, g.start[t + 1] - base)
            x = alpha[here]
            x *= p
            np.sum(x, 1, out=scale[here])
            x /= scale[here, None]
            p = x[: g.active[t + 1]] @ self.a
        return p, scale, alpha, em

    def log_likelihoods(self, seqs: list[np.ndarray]) -> np.ndarray:
        """Natural logarithms; sequences of classes, each with its end, none empty."""
        g = Segments(seqs, BLOCK_TOKENS)
        p, total = np.broadcast_to(self.pi, (len(seqs), len(self.pi))), np.zeros(len(seqs))
        for part in g.parts:
            p, scale, *_ = self._forward(g, part, p, False)
            total += np.bincount(g.rows(part), np.log(scale), len(seqs))
        out = np.empty(len(seqs))
        out[g.order] = total
        return out

    def expected(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of first states, moves and emissions, and the log likelihood."""
        k = len(self.pi)
        g = Segments(seqs, BLOCK_TOKENS)
        priors = [np.broadcast_to(self.pi, (len(seqs), k))]
        for part in g.parts[:-1]:
            priors.append(self._forward(g, part, priors[-1], False)[0])
        moves, emits, total, first = np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0, None
        after = None  # of the part that follows: what its first step's rows pass back
        for part, p in zip(reversed(g.parts), reversed(priors)):
            lo, hi = part
            base = g.start[lo]
            _, scale, alpha, em = self._forward(g, part, p, True)
            total += float(np.log(scale).sum())
            em /= scale[:, None]  # what follows is scaled so that states times messages add up to one
            beta = np.ones_like(alpha)
            if after is not None:  # the last step here goes on in the part that follows
                end = g.start[hi - 1] - base
                moves += alpha[end : end + len(after)].T @ after
                beta[end : end + len(after)] = after @ self.a.T
            for t in range(hi - 1, lo, -1):
                here = slice(g.start[t] - base, g.start[t + 1] - base)
                x = em[here]
                x *= beta[here]
                to = g.start[t - 1] - base
                np.matmul(x, self.a.T, out=beta[to : to + len(x)])
            here = slice(0, g.active[lo])
            em[here] *= beta[here]
            if hi - lo > 1:
                moves += alpha[g.before(part)].T @ em[g.active[lo] :]
            after = em[here].copy()
            alpha *= beta
            cls = g.cls[base : g.start[hi]]
            for s in range(k):
                emits[:, s] += np.bincount(cls, alpha[:, s], CLASSES)
            first = alpha[here].sum(0)
        return first, moves * self.a, emits, total


class Segments:
    """Sequences side by side, the longest first, so that those that go on at a step are the first ``active`` ones.

    Tokens are held step by step: those of step t from ``start[t]``. ``parts``: runs of steps with about ``most`` tokens.
    """

    def __init__(self, seqs: list[np.ndarray], most: int):
        n = np.array([len(s) for s in seqs], np.int64)
        self.order = np.argsort(-n, kind="stable")
        steps = int(n.max())
        self.active = np.zeros(steps + 1, np.int64)
        self.active[:steps] = len(n) - np.cumsum(np.bincount(n, minlength=steps + 1))[:steps]
        self.start = np.r_[0, np.cumsum(self.active)]
        self.cls = np.empty(int(n.sum()), np.uint16)
        for row, k in enumerate(self.order):
            self.cls[self.start[: n[k]] + row] = seqs[k]
        cuts = [0]
        while cuts[-1] < steps:
            cuts.append(max(cuts[-1] + 1, min(steps, int(np.searchsorted(self.start, self.start[cuts[-1]] + most, "right")) - 1)))
        self.parts = list(zip(cuts, cuts[1:]))

    def _place(self, part: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = part
        size = self.active[lo:hi]
        begins = self.start[lo:hi] - self.start[lo]
        return np.arange(size.sum()) - np.repeat(begins, size), size

    def rows(self, part: tuple[int, int]) -> np.ndarray:
        """The row of each token."""
        return self._place(part)[0]

    def before(self, part: tuple[int, int]) -> np.ndarray:
        """For each token of the second and later steps where its row's token of the step before is."""
        row, size = self._place(part)
        begins = self.start[part[0] : part[1]] - self.start[part[0]]
        return row[size[0] :] + np.repeat(begins[:-1], size[1:])


def _sequences(tokens: bytes, lens: list[int], keep: list[bool]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Numbers and classes of the kept texts with their ends, texts of like length together: all long ones, then blocks of about ``BLOCK_TOKENS``."""
    flat = np.frombuffer(tokens, np.uint16)
    n = np.asarray(lens, np.int64)
    ends = np.cumsum(n)
    kept = np.flatnonzero(np.asarray(keep, bool))
    kept = kept[np.argsort(-n[kept], kind="stable")]
    long = int((n[kept] > LONG).sum())
    block = np.r_[np.zeros(long, np.int64), 1 + np.cumsum(n[kept[long:]] + 1) // BLOCK_TOKENS]
    for at in np.split(kept, np.flatnonzero(np.diff(block)) + 1):
        if len(at):
            yield at, [np.append(flat[ends[i] - n[i] : ends[i]], np.uint16(END)) for i in at]


class HiddenMarkovScorer:
    """Learns from rows of ``docs`` whose ``held`` is false and scores all rows. See the module's text."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1):
        spark = docs.sparkSession
        own = narrow(docs, _id=id_col, _t=text_col).withColumn("_held", fold("_id", folds) == held_fold)
        with batches_of(spark, 1000):
            chunks = staged(chunked(own, "_held"), "lm-chunks")
        words = chunks.select("chunk", F.expr("posexplode(arrays_zip(vocab, seen))").alias("at", "x")).select("chunk", "at", F.col("x.vocab").alias("word"), F.col("x.seen").alias("seen"))
        counts = staged(words.where("seen > 0").groupBy("word").agg(F.sum("seen").alias("c")), "lm-counts")
        texts = chunks.select(F.explode("held").alias("h")).where("not h").count()
        sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v, self.texts = int(sums["n"]) + texts, int(sums["v"]) + (texts > 0), texts
        top = {r["word"]: i for i, r in enumerate(counts.orderBy(F.desc("c"), "word").limit(TOP).collect())}
        suffix = F.expr(f"cast({TOP} + crc32(encode(right(word, 3), 'utf-8')) % {HASHED} as int)")
        top_rows = spark.createDataFrame(list(top.items()), "tw string, ti int")
        by_class = counts.join(F.broadcast(top_rows), F.col("word") == F.col("tw"), "left").groupBy(F.coalesce("ti", suffix).alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in by_class:
            self.class_n[r["cls"]], self.class_v[r["cls"]] = r["c"], r["v"]
        self.class_n[END] = texts
        unused = np.arange(CLASSES) < TOP
        unused &= self.class_n == 0
        self.hmm = Hmm(np.where(unused, 1e-6, self.class_n + 0.5))
        # what a chunk can't know by itself: counts that differ from its own, and words with a class of their own
        ranked = counts.join(F.broadcast(top_rows), F.col("word") == F.col("tw"), "left").select("word", "c", "ti")
        packed = words.select("word", "seen", F.expr(f"shiftleft(chunk, {WORD_BITS}) | at").alias("slot"))
        asked = packed.join(ranked, "word").where("c <> seen or ti is not null")
        value = F.expr(f"named_struct('at', cast(slot & {(1 << WORD_BITS) - 1} as int), 'c', c, 'ti', cast(coalesce(ti, -1) as smallint))")
        known = asked.select(F.expr(f"shiftright(slot, {WORD_BITS})").alias("chunk"), value.alias("k")).groupBy("chunk").agg(F.collect_list("k").alias("known"))
        # a row a chunk on either side, of bounded size: rows of megabytes are better hashed than sorted
        met = chunks.select("chunk", "ids", "held", "lens", "seen", "suffix", "tokens").join(known.hint("shuffle_hash"), "chunk", "left")
        self.encoded = staged(self._encoded(met), "lm-encoded")
        self._train()

    def _encoded(self, met: DataFrame) -> DataFrame:
        schema = f"chunk long, ids {dict(met.dtypes)['ids']}, held array<boolean>, lens array<int>, n_known array<int>, base array<double>, within array<double>, tokens binary"
        class_n, class_v, n, v, texts = self.class_n, self.class_v, self.n, self.v, self.texts
        at = {c: i for i, c in enumerate(met.columns)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = np.log10(n + 0.5 * (v + 1))
            end_base = np.log10(texts + 0.5) - size
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1)
                    c = row.column(at["seen"]).flatten().to_numpy().astype(np.float64)
                    cls = np.frombuffer(row.column(at["suffix"])[0].as_py(), np.uint16).astype(np.int64)
                    known = row.column(at["known"]).flatten()
                    if len(known):
                        place, own = known.field("at").to_numpy(), known.field("ti").to_numpy().astype(np.int64)
                        c[place] = known.field("c").to_numpy()
                        cls[place] = np.where(own >= 0, own, cls[place])
                    base = np.log10(c + 0.5) - size
                    within = np.log10(c + 0.5) - np.log10(class_n[cls] + 0.5 * (class_v[cls] + 1))
                    within[cls < TOP] = 0  # the only word of its class
                    flat = from_planes(row.column(at["tokens"])[0].as_py())
                    lens = np.array(row.column(at["lens"])[0].as_py(), np.int64)
                    ends = np.cumsum(lens)
                    sums = [np.r_[0, np.cumsum(x)] for x in ((c > 0)[flat], base[flat], within[flat])]
                    per = [s[ends] - s[ends - lens] for s in sums]
                    known_n = per[0].astype(np.int32) + np.int32(texts > 0)
                    cols = [pa.array([x]) for x in (known_n, per[1] + end_base, per[2])]
                    cols.append(pa.array([cls[flat].astype(np.uint16).tobytes()], pa.binary()))
                    yield pa.RecordBatch.from_arrays([row.column(at[x]) for x in ("chunk", "ids", "held", "lens")] + cols, ["chunk", "ids", "held", "lens", "n_known", "base", "within", "tokens"])

        return met.mapInArrow(run, schema)

    def _train(self) -> None:
        slices = 1
        while slices < STEPS and self.n >= 2 * slices * SLICE_TOKENS:
            slices *= 2
        #: Texts counted by each step before the full passes.
        self.started: list[int] = []
        blend = 0
        for step in range(STEPS if self.texts else 0):
            sums, _ = self._sums(step % slices, slices)
            self.started.append(round(sums[0].sum()))
            if self.started[-1]:  # few texts can leave a slice empty
                weight = 1 if np.isscalar(blend) else (step + 1) ** -FORGET
                k = len(self.hmm.pi)
                blend = blend * (1 - weight) + sums * (weight * self.n / sums[1 + k :].sum())
                self.hmm.take(blend[0], blend[1 : 1 + k], blend[1 + k :])
        self.log_likelihood: list[float] = []
        while self.texts and len(self.log_likelihood) < PASSES:
            sums, log = self._sums()
            k = len(self.hmm.pi)
            self.log_likelihood.append(log)
            self.hmm.take(sums[0], sums[1 : 1 + k], sums[1 + k :])
            if len(self.log_likelihood) > 1 and self.log_likelihood[-1] - self.log_likelihood[-2] < SETTLED * abs(self.log_likelihood[-2]):
                break

    def _sums(self, which: int = 0, slices: int = 1) -> tuple[np.ndarray, float]:
        """Expected counts of first states (one row), moves and emissions (a row a class) over a slice of the training texts, and its log likelihood."""
        k = len(self.hmm.pi)
        got = self._counts(which, slices).groupBy("at").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(k))).toArrow()  # a row a class
        at = got.column("at").to_numpy()
        n = np.stack([got.column(f"n{s}").to_numpy() for s in range(k)], 1)
        sums = np.zeros((1 + k + CLASSES, k))
        sums[at[at >= 0]] = n[at >= 0]
        return sums, float(n[at < 0, 0].sum())

    def _counts(self, which: int, slices: int) -> DataFrame:
        """Rows of :meth:`_sums`, added up within each task; at -1 the log likelihood."""
        hmm = self.hmm
        k = len(hmm.pi)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, log, long, size = 0, 0.0, [], 0

            def add(seqs: list[np.ndarray]) -> None:
                nonlocal total, log
                first, moves, emits, more = hmm.expected(seqs)
                total, log = total + np.concatenate([first[None], moves, emits]), log + more

            for batch in batches:
                for chunk, held, lens, tokens in zip(*batch.columns):
                    keep = ~np.array(held.as_py(), bool) & (slice_of(chunk.as_py(), len(held), slices) == which)
                    for _, seqs in _sequences(tokens.as_py(), lens.as_py(), keep) if keep.any() else ():
                        if len(seqs[0]) <= LONG + 1:
                            add(seqs)
                            continue
                        long, size = long + seqs, size + sum(map(len, seqs))  # long texts of several chunks go side by side
                        if size >= LONG_TOKENS:
                            add(long)
                            long, size = [], 0
            if long:
                add(long)
            if not np.isscalar(total):
                at = np.flatnonzero(total.any(1))
                rows = np.concatenate([np.full((1, k), log), total[at]])
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at], pa.int64()), *(pa.array(rows[:, s]) for s in range(k))], ["at", *(f"n{s}" for s in range(k))])

        rows = self.encoded.select("chunk", "held", "lens", "tokens")
        if slices > 1:  # a task has little to do and sends as much as ever
            rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
        return rows.mapInArrow(run, ", ".join(["at long", *(f"n{s} double" for s in range(k))]))

    def scores(self) -> DataFrame:
        """``(_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

        A null or blank text is the end alone. A null id counts as fold 0. Repeated rows get a row each and count as
        often as they are there. With nothing to learn from, the counts are zero and the matrices their first values.
        An empty table gives no rows.
        """
        hmm, n = self.hmm, self.n
        kind = dict(self.encoded.dtypes)["ids"][6:-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, held, lens, known, base, within, tokens in zip(*batch.columns):
                    size = lens.as_py()
                    log = np.empty(len(size))
                    for at, seqs in _sequences(tokens.as_py(), size, [True] * len(size)):
                        log[at] = hmm.log_likelihoods(seqs) / np.log(10)
                    cols = [
                        ids.values, held.values, pa.array(np.array(size) + 1, pa.int64()), known.values.cast(pa.int64()), pa.array(np.full(len(size), n), pa.int64()),
                        base.values, pa.array(log + within.values.to_numpy(zero_copy_only=False)),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        cols = self.encoded.select("ids", "held", "lens", "n_known", "base", "within", "tokens")
        return cols.mapInArrow(run, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HiddenMarkovScorer(table(spark, sf_dir, "documents")).scores().withColumnRenamed("_id", "doc_id")
