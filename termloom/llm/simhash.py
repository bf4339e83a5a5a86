"""SimHash near-dedup with Golay-code fuzzy keys.

A 64-bit fingerprint is parted into segments of 23, 23 and 18 bits (the last with five zero bits in front). The perfect
binary Golay code has a codeword within 3 bits of every 23-bit word. Two words one bit apart either decode to the same
codeword, or both lie 3 bits from their own codeword and 4 from the other's: so the codeword of one is always among
the *nearby* codewords (at most 6: the nearest and, for words 3 bits from it, the five at 4 bits) of the other.

Three differing bits fall on three segments in one of two ways, which the key families cover without a gap:

* some segment has none, and another at most one: families (i, j) key segment i's bits with j's codeword index;
* every segment has exactly one: a family keys the codewords of the first two segments, with the parity of each
  segment, which one differing bit always turns.

A fingerprint is stored under its 7 own keys and asks under its nearby ones (60 at most, 54 in the mean). Rows of a
key meet in partitions sorted by key; pairs are verified by their differing bits, and a partition returns links to one
root for each group it saw rather than all pairs, so that output is linear in its input and no link between different
fingerprints is lost. Equal fingerprints are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from termloom.functions.components import connected_components
from termloom.functions.shared import shuffle_width, staged
from termloom.llm.common import narrow, table

#: The generator polynomial of the [23, 12, 7] Golay code.
GENERATOR = 0xAE3
#: First bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
BATCH_ROWS = 200_000
SMALL_RUN, LARGE_RUN = 48, 4096


def _syndromes(words: np.ndarray) -> np.ndarray:
    out = np.zeros(words.shape, np.int64)
    row = 1
    for bit in range(23):
        out ^= np.where(words >> bit & 1, row, 0)
        row <<= 1
        if row >> 11 & 1:
            row ^= GENERATOR
    return out


class Golay:
    """Decoding tables: the leader of each syndrome (weight at most 3) and its five patterns of weight 4."""

    def __init__(self) -> None:
        patterns = lambda w: np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64)
        self.leader = np.zeros(2048, np.int64)
        for w in range(1, 4):
            p = patterns(w)
            self.leader[_syndromes(p)] = p
        four = patterns(4)
        s = _syndromes(four)
        order = np.argsort(s, kind="stable")
        self.further = np.full((2048, 5), -1, np.int64)
        four, s = four[order], s[order]
        place = np.arange(len(s)) - np.searchsorted(s, s)
        heavy = np.bitwise_count(self.leader[s]) == 3
        self.further[s[heavy], place[heavy]] = four[heavy]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """The 12-bit index of the nearest codeword."""
        return (words ^ self.leader[_syndromes(words)]) >> 11

    def nearby(self, words: np.ndarray) -> np.ndarray:
        """Six columns of indices, -1 where there are fewer."""
        s = _syndromes(words)
        out = np.full((len(words), 6), -1, np.int64)
        out[:, 0] = (words ^ self.leader[s]) >> 11
        more = self.further[s]
        out[:, 1:] = np.where(more >= 0, (words[:, None] ^ more) >> 11, -1)
        return out


def _parts(fps: np.ndarray) -> list[np.ndarray]:
    return [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


_PAIRS = [(i, j) for i in range(3) for j in range(3) if i != j]


def keys(fps: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fingerprint, stored) of all keys of ``fps`` (uint64): stored ones and those to ask under."""
    seg = _parts(fps)
    own, near = [code.nearest(s) for s in seg], [code.nearby(s) for s in seg]
    parity = sum((np.bitwise_count(s).astype(np.int64) & 1) << i for i, s in enumerate(seg))
    out: list[tuple[np.ndarray, np.ndarray, bool]] = []
    for family, (i, j) in enumerate(_PAIRS):
        tag = (family << 40) + (seg[i] << 12)
        out.append((tag + own[j], fps, True))
        for c in range(6):
            ok = near[j][:, c] >= 0
            out.append(((tag + near[j][:, c])[ok], fps[ok], False))
    tag = 6 << 40
    out.append((tag + (parity << 24) + (own[0] << 12) + own[1], fps, True))
    for a in range(6):
        for b in range(6):
            ok = (near[0][:, a] >= 0) & (near[1][:, b] >= 0)
            out.append(((tag + ((parity ^ 7) << 24) + (near[0][:, a] << 12) + near[1][:, b])[ok], fps[ok], False))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]), np.concatenate([np.full(len(x[0]), x[2]) for x in out])


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: each linked value and the smallest value that it reaches, where the two differ."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def alike(fps: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of distinct fingerprints that hold every two of them three bits apart at most: all, or where these are many, those with an equal quarter."""
    if len(fps) <= LARGE_RUN:
        yield fps
        return
    for at in range(0, 64, 16):  # three bits leave one of four quarters as it is
        quarter = fps >> np.uint64(at) & np.uint64(0xFFFF)
        order = np.argsort(quarter, kind="stable")
        for run in np.split(fps[order], np.flatnonzero(np.diff(quarter[order])) + 1):
            if len(run) > 1:
                yield run


def linked(key: np.ndarray, fps: np.ndarray, stored: np.ndarray, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the verified links between rows of equal key; ``key`` is sorted."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
    size = np.diff(np.r_[start, len(key)])
    has = np.add.reduceat(stored.astype(np.int64), start) if len(start) else size
    use = (has > 0) & (size > 1)
    found_a, found_b = [], []
    small = np.repeat(use & (size <= SMALL_RUN), size)
    key_s, fps_s = key[small], fps[small]
    for d in range(1, int(size[use & (size <= SMALL_RUN)].max(initial=1))):
        same = key_s[d:] == key_s[:-d]
        if not same.any():
            break
        p, q = fps_s[:-d][same], fps_s[d:][same]
        ok = (np.bitwise_count(p ^ q) <= bits) & (p != q)
        found_a.append(p[ok])
        found_b.append(q[ok])
    for k in np.flatnonzero(use & (size > SMALL_RUN)):
        for group in alike(np.unique(fps[start[k] : start[k] + size[k]])):
            for at in range(0, len(group), 1024):
                block = group[at : at + 1024]
                for to in range(at, len(group), 1024):
                    i, j = np.nonzero(np.bitwise_count(block[:, None] ^ group[None, to : to + 1024]) <= bits)
                    a, b = roots(block[i], group[to + j])
                    found_a.append(a)
                    found_b.append(b)
    if not found_a or not sum(map(len, found_a)):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return roots(np.concatenate(found_a), np.concatenate(found_b))


_LANES = np.array([sum((v >> b & 1) << (8 * b) for b in range(8)) for v in range(256)], np.uint64)


def fingerprint_of(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of 64-bit hashes: a bit is set if it is in over half of them."""
    n = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    flat = np.ascontiguousarray(np.concatenate([hashes[i] for i in full])).view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(n[full])
    begins = ends - n[full]
    runs = [np.arange(b, e, 255) for b, e in zip(begins, ends)]
    owner = np.repeat(np.arange(len(full)), [len(r) for r in runs])
    starts = np.concatenate(runs)
    for byte in range(8):
        lanes = np.add.reduceat(_LANES[flat[:, byte]], starts)  # at most 255 a lane
        sums = np.zeros((len(full), 8), np.int64)
        np.add.at(sums, owner, lanes.view(np.uint8).reshape(-1, 8))
        for b in range(8):
            out[full] |= np.where(2 * sums[:, b] > n[full], np.uint64(1) << np.uint64(8 * byte + b), np.uint64(0))
    return out


def shingle_hashes(text: str, size: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles; fewer words than ``size``: of the whole sequence; none: nothing."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    return np.array([digest(b" ".join(w), 42) for w in zip(*(words[i:] for i in range(size)))], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(_id, fp)`` for every row; a null or blank text has the fingerprint zero."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 500):
                fp = fingerprint_of([shingle_hashes(t.as_py() or "", shingle) for t in texts[at : at + 500]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + 500], pa.array(fp.view(np.int64))], ["_id", "fp"])

    return narrow(docs, _id=id_col, t=text_col).selectExpr("_id", "cast(t as string) t").mapInArrow(run, f"_id {kind}, fp long")


def fingerprint_links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints ``classes (fp)`` wherever chains of ``bits`` <= 3 do."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys find up to three differing bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                k, f, s = keys(fps[at : at + 2000], code)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f.view(np.int64)), pa.array(s)], ["key", "fp", "stored"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            a, b = linked(*part, bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f, s = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((k, f.view(np.uint64), s))
            rows += len(k)
            if rows >= BATCH_ROWS and k[-1] != held[0][0][0]:  # a key that fills more than a batch is put together once
                whole = tuple(np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last key may go on
                yield out(tuple(x[:cut] for x in whole))
                held, rows = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if rows:
            yield out(tuple(np.concatenate(x) for x in zip(*held)))

    rows = classes.select("fp").mapInArrow(spread, "key long, fp long, stored boolean")
    dealt = rows.repartition(shuffle_width(classes.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id that chains of links reach. Null and blank texts have the fingerprint zero and
    link like others. A null id gets a row; it is never a component's id unless the component holds no other (then
    null). Repeated rows get a row each. An empty table gives no rows. Texts are read whole.
    """
    fps = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = staged(fps.groupBy("fp").agg(F.min("_id").alias("least")), "simhash-classes")
    comp = connected_components(fingerprint_links(classes, bits))
    named = classes.join(comp, classes["fp"] == comp["node"], "left").select(
        classes["fp"].alias("cfp"), "least", F.coalesce("root", classes["fp"]).alias("root")
    )
    least = staged(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")  # written, so that a hot root's join can be split
    by_fp = named.join(least, "root").select("cfp", "component_id")
    return fps.join(by_fp, fps["fp"] == by_fp["cfp"]).select(
        F.col("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``docs`` with one of each component: that with the smallest id, null ids last, of equal ids any one.

    Rows are told apart by themselves, so ids may repeat over texts of several components, or over rows that are equal.
    Columns pass through whatever their names. Null and blank texts are copies of one another.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("_")).alias("_row")
    own = docs.select(F.monotonically_increasing_id().alias("_n"), F.col(f"`{id_col}`").alias("_i"), F.col(f"`{text_col}`").alias("_t"), row)
    own = staged(own, "simhash-rows")  # numbers stay as written
    found = simhash_components(own.withColumn("_key", F.struct(F.col("_i").isNull().alias("none"), F.col("_i").alias("id"), F.col("_n").alias("n"))), "_key", "_t", shingle, bits)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id.n").alias("_n"))
    return own.join(gone, "_n", "left_anti").select(*[(F.col("_t") if c == text_col else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
