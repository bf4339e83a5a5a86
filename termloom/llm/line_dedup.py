"""Line dedup: lines that many documents share stay only in the largest document id that holds them.

All of it is DataFrame operations. The line digests (two independent 64-bit hashes of the normalised line, 128 bits)
are written once to the shared folder. Keys that would overfill a range partition are found on a 1/64 sample of the
documents (at most ``2 x partitions`` keys can exceed the threshold, so that list has a proven bound and is broadcast);
they are counted exactly by pre-aggregation and never sorted. All other digests are range-partitioned with a secondary
sort by document and position, and each partition streams over its sorted runs: the first row of a run is in the
document that keeps the line. What comes out is not text but a bitmap of dropped positions for each document, in 64-bit
words. Splitting hot keys changes only where they are counted, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from termloom.functions.shared import shuffle_width, staged
from termloom.llm.common import BLANKS, LOWER, UPPER, narrow, table

SAMPLE = 64


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, _id=id_col, _t=text_col).withColumn("_t", F.coalesce("_t", F.lit(""))).withColumn("_th", F.xxhash64("_t"))


def line_drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``(_id, _th, words, n_dropped)``: a bitmap for each document that loses lines.

    ``words[k]`` holds bits for the lines 64k to 64k+63, set where the line is dropped; the array ends with the last
    word that has a bit. ``_th`` hashes the text, so that rows which share an id but not a text keep apart. A null id
    counts as one document below all others; a null or empty text is one empty line and loses nothing; repeated rows
    get the same bitmap and count as one document; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lines = (
        _rows(docs, id_col, text_col)
        .select("_id", "_th", F.posexplode(F.split("_t", "\n", -1)).alias("pos", "line"))
        .where(F.octet_length("line") >= min_chars)
        .select("_id", "_th", "pos", line_key(F.col("line")).alias("k"))
        .where(F.length("k") >= min_chars)
        .select("_id", "_th", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"))
    )
    lines = staged(lines, "line-digests")
    parts = shuffle_width(spark)
    sample = lines.where(F.pmod(F.xxhash64(F.lit(7), "_id"), F.lit(SAMPLE)) == 0)
    hot_rows = max(8, sample.count() // (2 * parts))
    hot = F.broadcast(staged(sample.groupBy("h1", "h2").count().where(F.col("count") > hot_rows).select("h1", "h2"), "line-hot"))

    totals = (
        lines.join(hot, ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.max("_id").alias("top"))
        .where(F.col("n") >= min_docs)
    )
    from_hot = lines.join(F.broadcast(totals), ["h1", "h2"]).select("_id", "_th", "pos", "top")

    run = Window.partitionBy("h1", "h2")
    order = F.col("_id").desc_nulls_last()
    from_cold = (
        lines.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange(parts, "h1", "h2")
        .sortWithinPartitions("h1", "h2", order, "pos")
        .withColumn("rank", F.dense_rank().over(run.orderBy(order)))
        .withColumn("top", F.first("_id").over(run.orderBy(order)))
        .withColumn("n", F.max("rank").over(run))
        .where(F.col("n") >= min_docs)
        .select("_id", "_th", "pos", "top")
    )
    dropped = from_hot.unionByName(from_cold).where(~F.col("_id").eqNullSafe(F.col("top")))
    words = (
        dropped.repartition(parts, "_id", "_th")
        .groupBy("_id", "_th", F.floor(F.col("pos") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
        .groupBy("_id", "_th")
        .agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("s"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))
    )
    dense = F.expr("flatten(transform(s, (x, i) -> concat(array_repeat(0L, x.w - coalesce(get(s, i - 1).w, -1) - 1), array(x.bits))))")
    return words.select("_id", "_th", dense.alias("words"), "n_dropped")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text_col`` reduced to the kept lines, plus ``_n_lines`` and ``_n_dropped`` (long).

    Every row stays, with an empty text if it keeps no line. Nulls, empty texts and repeated rows: see
    :func:`line_drops`. Other columns pass through, whatever their names, save those two.
    """
    drops = line_drops(docs, id_col, text_col, min_chars, min_docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]  # held in one column, where no name can clash
    left = docs.select(F.struct(*others, F.lit(0).alias("_")).alias("_row"), F.col(f"`{id_col}`").alias("_key"), text.alias("_n_text")).withColumn("_n_hash", F.xxhash64("_n_text"))
    hit = left.join(drops, F.col("_key").eqNullSafe(drops["_id"]) & (left["_n_hash"] == drops["_th"]), "left")
    lines = F.split("_n_text", "\n", -1)
    kept = F.expr(
        "array_join(filter(split(_n_text, '\\n', -1), (x, i) -> coalesce(shiftright(get(words, int(i div 64)), i % 64) & 1L, 0L) = 0L), '\\n')"
    )
    new_text = F.when(F.col("words").isNull(), F.col("_n_text")).otherwise(kept)
    cols = [(new_text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c)) for c in docs.columns]
    return hit.select(
        *cols,
        F.size(lines).cast("long").alias("_n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("_n_dropped"),
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), v AS (
  SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id < f.top AS drops
  FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(CASE WHEN drops THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT drops), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""
