"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in hash order, form blocks. A source of weight w gets its j-th block between its release time
floor(j / w) and its deadline ceil((j + 1) / w); in each slot the released block with the earliest deadline goes first.
At any slot a source then has had within one block of its share. Weights are rounded to whole numbers a with the sum
``period`` (largest remainders, one at least), so the schedule repeats itself every ``period`` slots: one period is
worked out on the driver, whatever the number of rows, and every block's slot follows by arithmetic.

The schedule ends with the slot in which the last source has given each of its rows once. Sources that reach their end
before that begin again (a new epoch): no row is dropped, and shares hold over the whole output. Ranks within a source
come from a range partition by source, hash and id, whose partitions cut a hot source into many; only counts by source
and partition are added up.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from termloom.functions.shared import shuffle_width, staged
from termloom.llm.common import narrow, table

#: Slots in a period, where sources are fewer than a quarter of that.
PERIOD = 4096
BLOCK = 8
#: The driver plans a period of at least four slots for each source; more sources than this are an error.
MAX_SOURCES = 1 << 16
#: Epochs of a row that are made at once.
SPREAD = 4096
#: Target weights are the sources' sizes to this power, where none are given.
TEMPER = 0.8


def whole_weights(weights: dict, period: int) -> dict:
    """Whole numbers of sum ``period``, at least 1 each, nearest to ``weights`` by largest remainders; no more weights than ``period``."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda k: (k is not None, k))
    exact = {k: weights[k] / total * period for k in names}
    out = {k: max(1, int(exact[k])) for k in names}
    order = sorted(names, key=lambda k: -(exact[k] - int(exact[k])))
    for k in order[: max(0, period - sum(out.values()))]:
        out[k] += 1
    over = sum(out.values()) - period
    high = [(exact[k] - out[k], -out[k], i) for i, k in enumerate(names) if out[k] > 1]
    heapq.heapify(high)
    for _ in range(over):  # those raised to 1 stay; the others give back, the furthest above its weight first
        _, _, i = heapq.heappop(high)
        k = names[i]
        out[k] -= 1
        if out[k] > 1:
            heapq.heappush(high, (exact[k] - out[k], -out[k], i))
    return out


def pfair_period(shares: dict) -> dict:
    """The slots of one period for each source: unit blocks, windows [floor(jQ/a), ceil((j+1)Q/a)), earliest deadline first."""
    period = sum(shares.values())
    releases: list[list] = [[] for _ in range(period)]
    for order, (k, a) in enumerate(shares.items()):
        for j in range(a):
            releases[j * period // a].append((-(-(j + 1) * period // a), order, j, k))
    ready: list = []
    slots: dict = {k: [] for k in shares}
    for slot in range(period):
        for item in releases[slot]:
            heapq.heappush(ready, item)
        deadline, _, _, k = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        slots[k].append(slot)
    return slots


def _scheduled(rows: DataFrame, weights: dict | None, block: int, temper: float) -> tuple[DataFrame, int]:
    """``rows (_id, _source, ..)``, each as often as it is taken, with epoch, block, slot and position; and their number."""
    spark = rows.sparkSession
    parts = shuffle_width(spark)
    order = [F.col("_source").asc_nulls_first(), F.col("_h"), F.col("_id")]
    numbered = staged(
        rows.withColumn("_h", F.xxhash64("_id", "_source"))
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_m", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_m", 33)),
        "mix-order",
    )
    counts = numbered.groupBy("_source", "_part").agg(F.count("*").alias("n"), F.min("_m").alias("first"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")), "mix-offsets")
    sizes = {r["_source"]: r["n"] for r in offsets.groupBy("_source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()}  # one row a source
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: name coarser ones")
    target = {k: n**temper for k, n in sizes.items()} if weights is None else {k: max(weights.get(k, 0.0), 1e-12) for k in sizes}
    shares = whole_weights(target, max(PERIOD, 4 * len(sizes))) if sizes else {}
    period = max(sum(shares.values()), 1)
    slots = pfair_period(shares)
    at = lambda k, j: j // shares[k] * period + slots[k][j % shares[k]]
    end = max((at(k, (n - 1) // block) for k, n in sizes.items()), default=-1) + 1
    had = lambda k: end // period * shares[k] + sum(s < end % period for s in slots[k])  # noqa: E731  blocks before the end
    source_kind = dict(rows.dtypes)["_source"]
    plan = spark.createDataFrame(
        [(k, n, shares[k], had(k) * block, slots[k]) for k, n in sizes.items()],
        f"_ps {source_kind}, size long, share long, takes long, slots array<int>",
    )  # a row a source, with ``period`` slots in all
    base = offsets.select(F.col("_source").alias("_os"), F.col("_part").alias("_op"), "base")
    ranked = (
        numbered.join(F.broadcast(base), F.col("_source").eqNullSafe(F.col("_os")) & (F.col("_part") == F.col("_op")))
        .join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_ps")))
        .withColumn("_rank", F.col("_m") + F.col("base"))
    )  # base: at most a row for each partition and source, since a partition boundary adds one
    last = "greatest(0L, (takes - 1 - _rank) div size)"  # of the epochs; a row of a small source may have very many
    epochs = ranked.withColumn("_many", F.explode(F.expr(f"sequence(0L, {last} div {SPREAD})"))).withColumn(
        "epoch", F.explode(F.expr(f"sequence(_many * {SPREAD}, least({last}, _many * {SPREAD} + {SPREAD - 1}))"))
    )
    blocked = epochs.withColumn("_g", F.expr("epoch * size + _rank")).where("_g < takes").withColumn("block", F.expr(f"_g div {block}"))
    slotted = blocked.withColumn("slot", F.expr(f"(block div share) * {period} + slots[int(block % share)]"))
    return slotted.withColumn("position", F.expr(f"slot * {block} + _g % {block}")), end * block


def mix(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, temper: float = TEMPER) -> DataFrame:
    """The schedule: ``(_id, _source, epoch, block, slot, position)``, a row for each time that a row of ``docs`` is taken.

    ``position`` numbers the output without a gap: slot x block + place in the block. ``weights``: of the sources; those it
    lacks get none of the others' share but the least one, and so do weights below one slot of a period (no source is
    dropped). A null source is a source like any; null ids and repeated rows are rows like any
    (ties in the order of hash and id may fall either way between equal rows); an empty table gives no rows. More than
    ``MAX_SOURCES`` sources are an error, since the driver plans the period.
    """
    out, _ = _scheduled(narrow(docs, _id=id_col, _source=source_col), weights, block, temper)
    return out.select("_id", "_source", F.col("epoch").cast("int").alias("epoch"), "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, temper: float = TEMPER) -> DataFrame:
    """The rows of ``docs``, each as often as the schedule takes it, in the schedule's order, with its columns as they are.

    Rows come in partitions that follow one another in the schedule, each in its order, so that a written table's files
    hold the sources interleaved. Rows are told apart by themselves: equal ids, sources or whole rows make no difference.
    Columns pass through whatever their names. Nulls and empty tables: see :func:`mix`.
    """
    own = docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("_source"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    )
    out, total = _scheduled(own, weights, block, temper)
    parts = shuffle_width(docs.sparkSession)
    dealt = out.select("position", "_row").repartitionById(parts, F.expr(f"cast(position * {parts} div {max(total, 1)} as int)"))
    return dealt.sortWithinPartitions("position").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "epoch", "block", "slot", "position")
